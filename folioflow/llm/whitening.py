"""Whitening of embeddings: covariance by Chan's pairwise merging.

1. Entries become whole numbers, floor(256 * c); each distinct vector of them counts once (the fit list, written once).
2. Every partition of the fit list works out its count, its exact sums, its mean and its scatter about that mean,
   block by block; a tree of merges joins two such states at a time: with d the difference of the means, the scatter
   of both is the sum of the scatters plus d d' n m / (n + m).  No product is ever taken of values that aren't
   centred.  A state has dims * (dims + 2) numbers, whatever the number of rows.
3. The eigenvectors of the covariance are found on the driver.
4. A second pass over the fit list whitens it and merges the covariance of the result in the same way: its largest
   distance from the identity is reported beside every row.
5. A last pass over the table whitens every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import named, remove, scratch_folder

SCALE = 256
COMPONENTS = 4
#: Rows that a task centres at a time.
BLOCK_ROWS = 4096
#: Entries at or beyond it are no whole numbers of 64 bits any more.
LARGEST = 2.0**62
#: Eigenvalues under this share of their sum are nothing but rounding.
LEAST_SHARE = 1e-12


@dataclass
class State:
    """Of some rows: their number, exact sums, mean, and scatter about the mean."""

    n: int
    sums: list[int]
    mean: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of(rows: np.ndarray) -> State:
        """rows: whole numbers or doubles; sums are kept of the former only."""
        whole = rows.dtype == np.int64
        x = rows.astype(np.float64)
        mean = x.mean(0)
        x -= mean
        return State(len(x), exact_sums(rows) if whole else [], mean, x.T @ x)

    def merged(self, other: State) -> State:
        if not other.n or not self.n:
            return self if self.n else other
        n, d = self.n + other.n, other.mean - self.mean
        return State(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], self.mean + d * (other.n / n), self.scatter + other.scatter + np.outer(d, d) * (self.n / n * other.n))

    def covariance(self) -> np.ndarray:
        return self.scatter / self.n


def exact_sums(rows: np.ndarray) -> list[int]:
    """Column sums without overflow: the upper and the lower 32 bits are added up apart."""
    return [(int(a) << 32) + int(b) for a, b in zip((rows >> 32).sum(0), (rows & 0xFFFFFFFF).sum(0), strict=True)]


@dataclass
class Whitening:
    n: int
    sums: list[int]
    components: np.ndarray  # a column each, by falling eigenvalue
    values: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whiten(self, rows: np.ndarray) -> np.ndarray:
        """rows on the components; NaN on those without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.values > LEAST_SHARE * self.trace, np.sqrt(self.values), np.nan)
            return (rows - self.mean) @ self.components / scale

    def deviations(self, rows: np.ndarray) -> pa.Array:
        """The sum over dimensions of (n * x - S) ** 2 of each row, exact; null where it doesn't fit 64 bits."""
        most = max(int(np.abs(rows).max(initial=0)), *(-(-abs(s) // self.n) for s in self.sums)) + 1
        if (2 * most * self.n) ** 2 * rows.shape[1] < 2**63:
            return pa.array(((rows * self.n - np.array(self.sums, np.int64)) ** 2).sum(1))
        exact = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in rows.tolist()]
        return pa.array([v if v < 2**63 else None for v in exact], pa.int64())


def whole_numbers(vector: Column) -> Column:
    """floor(256 * c) of each entry as long; null where the vector is null or empty, or an entry null, not finite or beyond 2 ** 62."""
    scaled = F.transform(vector, lambda c: c.cast("double") * SCALE)
    good = F.forall(scaled, lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)))  # NaN is above all numbers
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & good, F.transform(scaled, lambda c: F.floor(c)))


def block_of(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(pa.compute.list_flatten(column)).astype(np.int64).reshape(-1, dims)


def merged_state(rows: DataFrame, dims: int, through: Whitening | None = None) -> State:
    """The state of the vectors x of rows, or of what they are whitened to, merged in a tree."""

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = State(0, [], np.zeros(0), np.zeros((0, 0)))
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK_ROWS):
                x = block_of(batch.column(0).slice(k, BLOCK_ROWS), dims)
                state = state.merged(State.of(x if through is None else through.whiten(x)))
        if state.n:
            yield pa.RecordBatch.from_arrays([pa.array([state.n]), pa.array([[str(s) for s in state.sums]]), pa.array([state.mean.tobytes()]), pa.array([state.scatter.tobytes()])], ["n", "sums", "mean", "scatter"])

    def read(row) -> State:
        mean = np.frombuffer(row["mean"])
        return State(row["n"], [int(s) for s in row["sums"]], mean, np.frombuffer(row["scatter"]).reshape(len(mean), len(mean)))

    found = rows.select("x").mapInArrow(W.lean(states), "n long, sums array<string>, mean binary, scatter binary")
    return found.rdd.map(read).treeReduce(lambda a, b: a.merged(b), depth=3)


def fit(distinct: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of distinct vectors x of dims whole numbers; checked by a second pass."""
    state = merged_state(distinct, dims)
    values, vectors = np.linalg.eigh(state.covariance())
    values, vectors = np.maximum(values[::-1][:components], 0), vectors[:, ::-1][:, :components]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])  # of both signs that with a positive largest entry
    found = Whitening(state.n, state.sums, vectors, values, float(np.trace(state.covariance())))
    alive = values > LEAST_SHARE * found.trace
    if alive.any():
        whitened = merged_state(distinct, dims, Whitening(found.n, found.sums, vectors[:, alive], values[alive], found.trace))
        found.identity_error = float(np.abs(whitened.covariance() - np.eye(int(alive.sum()))).max())
    return found


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and each of the first components: vec_id, component, n, deviation, whitened, explained, identity_error.

    x are the entries as whole numbers, floor(256 * c); n is the number of distinct x vectors and S their sums.  component:
    numbers from 1 by falling eigenvalue e of the covariance (divisor n); deviation: the sum over dimensions of
    (n * x - S) ** 2, exact, null where it doesn't fit 64 bits; whitened: x - S / n on the component's unit eigenvector, over
    the root of e; explained: e over the sum of all; identity_error: how far the covariance of the whitened fit list is from the
    identity.

    Rows go whose vector is null or empty, or holds a null, an entry that isn't finite or one beyond 2 ** 54; so do those of
    another length than the most frequent (of equally frequent ones the largest).  Repeated rows and rows without an id are
    reported each.  A component without variance has null for whitened, and identity_error is null if none has any;
    explained is null if all rows are alike.  An empty table gives an empty result; other columns are not looked at."""
    spark = table.sparkSession
    id_type = table.schema[id_col].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = table.select(named(id_col).alias("vec_id"), whole_numbers(named(vector_col)).alias("x")).where("x is not null")
    lengths = rows.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dims = lengths["dims"]
    rows = rows.where(F.size("x") == dims)
    folder = scratch_folder(spark)
    try:
        rows.select("x").distinct().write.parquet(folder)
        found = fit(spark.read.parquet(folder), dims, components)
    finally:
        remove(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = found.components.shape[1]
        number = np.arange(1, k + 1, dtype=np.int32)
        share = found.values / found.trace if found.trace > 0 else np.full(k, np.nan)
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                x = block_of(part.column(1), dims)
                take = pa.array(np.repeat(np.arange(len(x)), k))
                whitened = found.whiten(x).ravel()
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(take), pa.array(np.tile(number, len(x))), pa.array(np.full(len(x) * k, found.n)), found.deviations(x).take(take), pa.array(whitened, mask=np.isnan(whitened)),
                    pa.array(np.tile(share, len(x)), mask=np.isnan(np.tile(share, len(x)))), pa.array([found.identity_error] * (len(x) * k), pa.float64()),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(W.lean(run), schema)
