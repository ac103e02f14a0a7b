"""Placement by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size: an offset and a step
from two hashes of its name.  Shards take turns; each claims the first slot of its order that is free.  A
shard of weight w gets w turns for each turn of weight 1.  Placing a row is one hash and one look-up, and
when a shard leaves, nearly all the slots of the others stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, named

SLOTS = 65_537
MOST_SLOTS = 1_000_003


def is_prime(n: int) -> bool:
    return n > 1 and all(n % i for i in range(2, int(n**0.5) + 1))


def preference(name: str, slots: int) -> tuple[int, int]:
    digest = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1


def fill(shards: Sequence[str] | Mapping[str, int], slots: int = SLOTS) -> list[int]:
    """The shard number (in sorted order of names) of each slot."""
    weights = dict(shards) if isinstance(shards, Mapping) else dict.fromkeys(shards, 1)
    names = sorted(weights)
    if not names or any(w < 1 for w in weights.values()):
        raise ValueError("at least one shard, and whole positive weights")
    if not is_prime(slots) or not sum(weights.values()) <= slots <= MOST_SLOTS:
        raise ValueError(f"slots must be a prime from the sum of weights to {MOST_SLOTS}")
    at, step = zip(*[preference(n, slots) for n in names], strict=True)
    at, table, free = list(at), [-1] * slots, slots
    while free:
        for shard, name in enumerate(names):
            for _ in range(weights[name]):
                if not free:
                    break
                while table[at[shard]] >= 0:
                    at[shard] = (at[shard] + step[shard]) % slots
                table[at[shard]] = shard
                free -= 1
    return table


def place(docs: DataFrame, shards: Sequence[str] | Mapping[str, int], key_col: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """docs with `slot` and `shard`, in place of columns of these names; row by row, without a shuffle.

    slot: the first 60 bits of the MD5 of the key as text, modulo the table's size.  A null key counts as the
    empty text.  Rows with equal keys share a shard, so a key should name a row, not a group of rows.  The
    table has at most 1,000,003 rows, whatever the data, and is broadcast."""
    spark = docs.sparkSession
    table = fill(shards, slots)
    names = sorted(shards)
    at, own, of = (fresh(docs, c) for c in ("__at", "__slot", "__shard"))
    rows = spark.createDataFrame([(i, names[s]) for i, s in enumerate(table)], f"`{own}` long, `{of}` string")
    digest = F.md5(F.coalesce(named(key_col).cast("string"), F.lit("")).cast("binary"))
    slot = F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots))
    kept = [named(c) for c in docs.columns if c not in ("slot", "shard")]
    marked = docs.select(*kept, slot.alias(at))
    return marked.join(F.broadcast(rows), F.col(at) == F.col(own), "left").select(*kept, F.col(at).alias("slot"), F.col(of).alias("shard"))
