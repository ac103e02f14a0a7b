"""Running groups of an array of sizes: folds whose state restarts, which no window frame expresses."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fitting_groups(sizes: list[int], most: int) -> list[int]:
    """The group number of each size: a new group before a size that would take the group over `most`."""
    groups, group, held = [], 0, 0
    for n in sizes:
        if held and held + n > most:
            group, held = group + 1, 0
        groups.append(group)
        held += n
    return groups


def reaching_groups(sizes: list[int], most: int) -> list[int]:
    """The group number of each size: a new group once the last holds `most` or more."""
    groups, group, held = [], 0, 0
    for n in sizes:
        if held >= most:
            group, held = group + 1, 0
        groups.append(group)
        held += n
    return groups


def reaching_runs(sizes: Column, most: int) -> Column:
    """(first, n) of each run of equal reaching_groups of an array column; null stays null."""

    def runs(x: np.ndarray | None) -> list[dict] | None:
        if x is None:
            return None
        groups = reaching_groups(x.tolist(), most)
        firsts = np.flatnonzero(np.diff(groups, prepend=-1)).tolist()
        return [{"first": first, "n": end - first} for first, end in zip(firsts, [*firsts[1:], len(groups)], strict=True)]

    @F.pandas_udf("array<struct<first:int,n:int>>")
    def run(column: pd.Series) -> pd.Series:
        return column.map(runs)

    return run(sizes)
