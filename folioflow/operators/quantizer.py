"""Product quantisation: coarse cells, and codes for the parts of what a cell's centre misses.

Both are k-means, trained by Spark: every partition adds up the vectors nearest to each centre, a tree of sums brings
these to the driver, whose state has the size of the model and not of the data.  The sample that the centres are
fitted on is bounded (FIT_ROWS); every row is encoded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows, about, that the centres are fitted on; fewer where the table has fewer.
FIT_ROWS = 131_072
FIT_PARTITION = 16_384
ITERATIONS = 6
CODES = 256
#: Entries that one code stands for.
WIDTH = 4
#: Scores that a task holds at a time.
SCORES = 1 << 21


def matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows as float64, which rows have dims finite values, of which there must be one); the others are zeros."""
    good = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == (dims or -2)
    out = np.zeros((len(column), dims))
    if good.any():
        out[good] = pc.list_flatten(column.filter(pa.array(good))).to_numpy(zero_copy_only=False).reshape(-1, dims)
        finite = np.isfinite(out).all(1)
        out[~finite], good = 0, good & finite
    return out, good


def best_columns(score: np.ndarray, k: int, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest scores of each row, best first; of equal ones the first columns, or those of the least `place`.  Scores of -inf are none."""
    least = np.partition(score, -k, axis=1)[:, -k, None] if score.shape[1] > k else -np.inf
    row, column = np.nonzero((score >= least) & (score > -np.inf))  # the k best and what ties with the last
    order = np.lexsort((column if place is None else place[column], -score[row, column], row))
    row, column = row[order], column[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], column[kept]


def blocks(n: int, width: int) -> Iterator[slice]:
    """Slices of n rows whose scores with `width` centres fit SCORES."""
    step = max(1, SCORES // max(width, 1))
    return (slice(k, k + step) for k in range(0, n, step))


@dataclass(frozen=True)
class Quantizer:
    cells: np.ndarray  # (cells, dims)
    books: np.ndarray  # (parts, codes, width); parts * width may be over dims, the rest is zeros

    @property
    def dims(self) -> int:
        return self.cells.shape[1]

    def near(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each row, nearest first."""
        n = min(n, len(self.cells))
        out = np.empty((len(x), n), dtype=np.int32)
        less = (self.cells**2).sum(1) / 2
        for own in blocks(len(x), len(self.cells)):
            far = less - x[own] @ self.cells.T
            best = np.argpartition(far, n - 1, axis=1)[:, :n] if n < len(self.cells) else np.broadcast_to(np.arange(n), far.shape)
            order = np.argsort(np.take_along_axis(far, best, 1), axis=1, kind="stable")
            out[own] = np.take_along_axis(best, order, 1)
        return out

    def parts(self, x: np.ndarray) -> np.ndarray:
        """(rows, parts, width): rows cut into the parts that codes stand for."""
        n, _, width = self.books.shape
        padded = np.zeros((len(x), n * width))
        padded[:, : x.shape[1]] = x
        return padded.reshape(len(x), n, width)

    def encode(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes of each row, length of what centre and codes together miss)."""
        rest = self.parts(x - self.cells[cell])
        codes = np.stack([nearest(rest[:, m], self.books[m]) for m in range(len(self.books))], 1)
        missed = rest - self.books[np.arange(len(self.books)), codes]
        return codes.astype(np.uint8), np.sqrt((missed**2).sum((1, 2)))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(parts, queries, codes): inner products of each query's parts with what the codes stand for."""
        parts = self.parts(queries)
        return np.stack([(parts[:, m] @ self.books[m].T).astype(np.float32) for m in range(len(self.books))])

    def scores(self, queries: np.ndarray, cell: int, codes: np.ndarray, tables: np.ndarray | None = None) -> np.ndarray:
        """(queries, rows of the cell): inner products with what the codes stand for, by a table for each query and part."""
        out = np.repeat((queries @ self.cells[cell]).astype(np.float32)[:, None], len(codes), 1)
        for m, table in enumerate(self.tables(queries) if tables is None else tables):
            out += table[:, codes[:, m]]
        return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    less = (centres**2).sum(1) / 2
    return np.concatenate([np.argmin(less - x[own] @ centres.T, axis=1) for own in blocks(len(x), len(centres))] or [np.zeros(0, np.int64)])


def k_means(rows: DataFrame, centres: np.ndarray, cut: Callable[[np.ndarray], np.ndarray], iterations: int = ITERATIONS) -> np.ndarray:
    """centres (parts, codes, width) moved to the means of the parts nearest to them; those that nothing is near to stay.

    rows: one column of arrays.  cut: makes (rows, parts, width) of a matrix."""
    dims = rows.select(F.size(rows.columns[0])).first()[0]
    for _ in range(iterations):

        def add(batches: Iterator[pa.RecordBatch], centres=centres) -> Iterator[pa.RecordBatch]:
            n, sums = np.zeros(centres.shape[:2], np.int64), np.zeros(centres.shape)
            for batch in batches:
                x, good = matrix(batch.column(0), dims)
                parts = cut(x[good])
                for m in range(len(centres)):
                    code = nearest(parts[:, m], centres[m])
                    n[m] += np.bincount(code, minlength=centres.shape[1])
                    np.add.at(sums[m], code, parts[:, m])
            yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()]), pa.array([sums.tobytes()])], ["n", "sums"])

        found = rows.mapInArrow(add, "n binary, sums binary").rdd.map(lambda r: (np.frombuffer(r["n"], np.int64), np.frombuffer(r["sums"])))
        n, sums = found.treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))
        n, sums = n.reshape(centres.shape[:2]), sums.reshape(centres.shape)
        centres = np.where(n[..., None] > 0, sums / np.maximum(n, 1)[..., None], centres)
    return centres


def sample(vectors: DataFrame, n: int, most: int = FIT_ROWS) -> DataFrame:
    """About `most` of the n rows of one column of arrays, dealt to few partitions; which ones depends on the values alone."""
    column = vectors.columns[0]
    if n > most:
        vectors = vectors.where(F.pmod(F.xxhash64(column), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    return vectors.repartition(max(1, -(-min(n, most) // FIT_PARTITION)))


def starts(rows: DataFrame, n: int) -> np.ndarray:
    """n distinct rows, or all if there are fewer; which ones depends on the values alone."""
    column = rows.columns[0]
    found = rows.distinct().orderBy(F.xxhash64(F.lit(11), column), column).limit(n).toArrow().column(0).combine_chunks()
    return matrix(found, len(found[0]))[0]


def fit(vectors: DataFrame, n: int, n_cells: int, width: int = WIDTH, fit_rows: int = FIT_ROWS) -> Quantizer | None:
    """A quantizer of the n vectors (one column of arrays of the same length, without nulls); None without rows."""
    rows = sample(vectors, n, fit_rows).persist()
    try:
        if rows.isEmpty():
            return None
        cells = starts(rows, n_cells)
        cells = k_means(rows, cells[None], lambda x: x[:, None])[0]
        dims = cells.shape[1]
        parts = -(-dims // width)
        plain = Quantizer(cells, np.zeros((parts, 1, width)))
        first = starts(rows, CODES)
        rest = lambda x: plain.parts(x - cells[plain.near(x, 1)[:, 0]])
        books = k_means(rows, rest(first).transpose(1, 0, 2).copy(), rest)
        return Quantizer(cells, books)
    finally:
        rows.unpersist()
