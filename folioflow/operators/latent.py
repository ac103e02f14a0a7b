"""A learned embedder: truncated singular value decomposition of the tf-idf matrix, by randomised power iteration.

Words are stemmed and hashed to FEATURES columns, so the model has a size of its own whatever the vocabulary.  The matrix is made
of all texts once and kept, in blocks of the rows of about a MB of text, at three bytes an entry.  A pass multiplies it and its
transpose with a thin block of vectors: every task does so with its own rows and adds up, the sums bring the block (FEATURES x
(dims + OVERSAMPLE)) to the driver, which makes it orthonormal for the next pass.  No row of the matrix goes to the driver.
Passes before the last two only turn the block and have single precision; the last two give rank, values and vectors.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.functions.batches import lean, parts, release, spans, split_tokens
from folioflow.operators.bm25 import runs, terms_of

FEATURES = 1 << 14
DIMS, OVERSAMPLE, PASSES = 128, 24, 7
#: Rows of the matrix that a task multiplies at a time.
SLAB_ROWS = 32
#: Bytes of the tasks' sums that may go to the driver, one by one; more are added up in a tree first.
SUM_BYTES = 512 << 20
#: Bytes of a block, about, that a task multiplies and adds up at a time; wider ones go in pieces of their columns.
PIECE_BYTES = 5 << 20
#: Values of a sum in a row: small enough for the driver's JVM to take and forget them like any row.
SLICE_VALUES = 1 << 15
#: Partitions of the kept matrix for each core; they go to memory, or to disk, one by one.
KEPT_PARTS = 8


def counted(tokens: pa.Array, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count) of a sparse matrix of texts, by row."""
    row, _, code, terms = terms_of(tokens, True)
    of = np.array([zlib.crc32(t.encode()) % features for t in terms.to_pylist()], dtype=np.int64)
    feature = of[code] if len(code) else np.zeros(0, np.int64)
    order, begins, rows, columns = runs(row, feature, features)
    return rows, columns, np.diff(np.append(begins, len(order)))


def entries(tokens: pa.Array, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, 1 + log count) of a sparse matrix of texts, by row."""
    rows, columns, counts = counted(tokens, features)
    return rows, columns, 1 + np.log(counts)


def packed(tokens: pa.Array, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries of each row, features, counts) of the matrix of some texts, in the smallest integers that hold them.

    Short texts come first: slabs of rows of like length share their features better."""
    rows, columns, counts = counted(tokens.take(pc.sort_indices(pc.list_value_length(tokens))), features)
    return np.bincount(rows, minlength=len(tokens)).astype(np.int32), columns.astype(np.min_scalar_type(features - 1)), counts.astype(np.min_scalar_type(counts.max(initial=0)))


def unpacked(sizes: pa.Scalar, feature: pa.Scalar, count: pa.Scalar, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, 1 + log count) of what packed made, from its bytes."""
    rows = np.repeat(np.arange(len(sizes.as_buffer()) // 4), np.frombuffer(sizes.as_buffer(), np.int32))
    columns = np.frombuffer(feature.as_buffer(), np.min_scalar_type(features - 1)).astype(np.int64)
    counts = np.frombuffer(count.as_buffer(), f"u{len(count.as_buffer()) // max(len(rows), 1) or 1}")
    return rows, columns, 1 + np.log(counts.astype(np.float64))


def unit_rows(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    length = np.sqrt(np.bincount(rows, values**2, minlength=n))
    return values / np.maximum(length, 1e-300)[rows]


def slabs(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n: int, features: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, features, full matrix of them) of every SLAB_ROWS rows: of a sparse matrix only the features that these have, for plain matrix products."""
    firsts = np.arange(0, n, SLAB_ROWS)
    for first, lo, hi in zip(firsts.tolist(), np.searchsorted(rows, firsts), np.searchsorted(rows, firsts + SLAB_ROWS), strict=True):
        seen = np.zeros(features, bool)
        seen[columns[lo:hi]] = True
        full = np.zeros((min(SLAB_ROWS, n - first), np.count_nonzero(seen)), values.dtype)
        full[rows[lo:hi] - first, (np.cumsum(seen) - 1)[columns[lo:hi]]] = values[lo:hi]
        yield first, np.flatnonzero(seen), full


@dataclass(frozen=True)
class Latent:
    weights: np.ndarray  # of each feature: how rare it is
    vectors: np.ndarray  # (features, dims)
    values: np.ndarray  # singular values, falling

    @property
    def dims(self) -> int:
        return self.vectors.shape[1]

    def embed(self, tokens: pa.Array) -> np.ndarray:
        """Unit vectors of texts; zeros for those without words that the model knows."""
        rows, columns, values = entries(tokens, len(self.weights))
        out = np.zeros((len(tokens), self.dims))
        for first, have, full in slabs(rows, columns, unit_rows(rows, values * self.weights[columns], len(tokens)), len(tokens), len(self.weights)):
            out[first : first + len(full)] = full @ self.vectors[have]
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=np.zeros_like(out), where=length > 1e-9).astype(np.float32)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.weights.tobytes(), self.vectors.tobytes(), self.values.tobytes())], "weights binary, vectors binary, vals binary").coalesce(1).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Latent:
        weights, vectors, values = (np.frombuffer(x) for x in spark.read.parquet(path).select("weights", "vectors", "vals").first())
        return Latent(weights, vectors.reshape(len(weights), -1), values)


#: (rows, row, feature, 1 + log count) of the matrix of some texts, or (rows, what packed gives); arrays as bytes.
BLOCK = "n int, row binary, feature binary, val binary"


def _blocks(texts: DataFrame, text_col: str, features: int, small: bool = False) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 0):
            tokens = split_tokens(batch.column(0))
            if small:
                arrays = packed(tokens, features)
            else:
                rows, columns, values = entries(tokens, features)
                arrays = (rows.astype(np.int32), columns.astype(np.int32), values)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int32()), *(pa.array([x.tobytes()]) for x in arrays)], ["n", "row", "feature", "val"])

    return texts.select(X.joined_tokens(F.col(text_col)).alias("tokens")).mapInArrow(run, BLOCK)


def _cores(df: DataFrame) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, 1)


def _summed(blocks: DataFrame, features: int, work: Callable[[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray], None], shape: tuple[int, ...], kind: type) -> np.ndarray:
    """The sum of what work(total, rows, row, feature, value) adds to a task's total over the packed blocks.  A core has one total, whatever the table's size."""
    tasks = _cores(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for batch in batches:
            for n, *arrays in zip(*(batch.column(c) for c in range(4)), strict=True):
                work(total, n.as_py(), *unpacked(*arrays, features))
        total = total.ravel()
        for first in range(0, len(total), SLICE_VALUES):
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([total[first : first + SLICE_VALUES].tobytes()])], ["first", "sum"])

    found = blocks.coalesce(tasks).mapInArrow(lean(run), "first long, sum binary")
    if tasks * np.prod(shape) * np.dtype(kind).itemsize <= SUM_BYTES:
        found, total = found.persist(), np.zeros(int(np.prod(shape)))
        try:
            found.count()
            for r in found.toLocalIterator():
                part = np.frombuffer(r["sum"], kind)
                total[r["first"] : r["first"] + len(part)] += part
            return total.reshape(shape)
        finally:
            found.unpersist()
    return found.rdd.mapPartitions(lambda rows: [np.concatenate([np.frombuffer(r["sum"], kind) for r in rows])]).treeReduce(lambda a, b: a + b).reshape(shape).astype(np.float64)


def fit(texts: DataFrame, text_col: str = "text", dims: int = DIMS, features: int = FEATURES, passes: int = PASSES) -> Latent:
    """The model of all texts of a column.  Null and empty texts are rows of zeros; a table without words gives vectors that embed everything to zeros."""
    release()
    blocks = _blocks(texts, text_col, features, small=True).repartition(KEPT_PARTS * _cores(texts)).persist()
    try:

        def count(total: np.ndarray, n: int, row: np.ndarray, feature: np.ndarray, value: np.ndarray) -> None:
            total[:features] += np.bincount(feature, minlength=features)
            total[features] += n

        *df, n = _summed(blocks, features, count, (features + 1,), np.float64)
        weights = np.log((1 + n) / (1 + np.array(df))) + 1

        def gram(block: np.ndarray) -> np.ndarray:
            """The transposed matrix times the matrix times a block, in the block's precision."""
            shared = texts.sparkSession.sparkContext.broadcast(block)

            def work(total: np.ndarray, n: int, row: np.ndarray, feature: np.ndarray, value: np.ndarray) -> None:
                block = shared.value
                for _, have, full in slabs(row, feature, unit_rows(row, value * weights[feature], n).astype(block.dtype), n, features):
                    total[have] += full.T @ (full @ block[have])

            try:
                return _summed(blocks, features, work, block.shape, block.dtype.type)
            finally:
                shared.destroy()
                # The sums that came by are the JVM's largest garbage: without this the driver grows by them to its full heap.
                texts.sparkSession._jvm.System.gc()

        thin = min(dims + OVERSAMPLE, features)
        block = np.linalg.qr(np.random.default_rng(97).normal(size=(features, thin)))[0]
        last, product = block, np.zeros_like(block)
        for left in range(passes if n else 0, 0, -1):
            exact = block.astype(np.float32 if left > 2 else np.float64)
            product = np.hstack([gram(np.ascontiguousarray(piece)) for piece in np.array_split(exact, -(-exact.nbytes // PIECE_BYTES), axis=1)])
            last = block
            block = np.linalg.qr(product)[0] if left > 1 else None
            release()
        # Within the last block: the eigenvectors of its small Gram matrix.
        small = last.T @ product if n else np.zeros((thin, thin))
        squares, turned = np.linalg.eigh((small + small.T) / 2)
        squares, turned = np.maximum(squares[::-1][:dims], 0), turned[:, ::-1][:, :dims]
        vectors = last @ turned * (squares > 1e-12 * max(squares[0], 1e-300))
        return Latent(weights, np.ascontiguousarray(vectors), np.sqrt(squares))
    finally:
        blocks.unpersist()


class LatentEmbedder:
    """The model as an embedder (folioflow.operators.vector.Embedder)."""

    def __init__(self, model: Latent):
        self.model, self.dims = model, model.dims

    def passages(self, text: Column) -> Column:
        model = self.model

        @F.arrow_udf("array<float>")
        def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                for row, end in spans(batch):
                    found = model.embed(split_tokens(batch.slice(row, end - row)))
                    yield pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, max(found.shape[1], 1), dtype=np.int32)), pa.array(found.ravel()))
                del batch
                release()

        return embed(X.joined_tokens(text))

    queries = passages
