"""Embedders and exact cosine search."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.functions.batches import parts, release, spans
from folioflow.operators.quantizer import best_columns, matrix

#: Queries, and entries of them, that may go to the vectors; more meet them in a grid of blocks of this size.
QUERY_BLOCK, QUERY_VALUES = 4096, 1 << 20
#: Vectors in a block of the grid.
VECTOR_BLOCK = 65_536
#: Texts that the hashing embedder counts at a time.
EMBEDDED_ROWS = 1000
#: Products of queries and vectors that a task holds at a time.
COMPARED = 1 << 19


class Embedder(Protocol):
    """Turns a text column into array<float> of unit length (or zeros)."""

    dims: int

    def passages(self, text: Column) -> Column: ...

    def queries(self, text: Column) -> Column: ...


class HashingEmbedder:
    """A bag of words in `dims` buckets: the first 8 hex digits of a token's MD5, modulo dims; of unit length.

    Needs no model and gives the same vectors everywhere.  Buckets are native expressions, only the histogram is Arrow."""

    def __init__(self, dims: int = 256):
        self.dims = dims

    def buckets(self, text: Column) -> Column:
        tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(X.QUERY_TOKEN), F.lit(0))
        return F.transform(tokens, lambda t: (F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("long") % self.dims).cast("int"))

    def passages(self, text: Column) -> Column:
        dims = self.dims

        @F.arrow_udf("array<float>")
        def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            # One histogram for all texts of a part: (text, bucket) pairs are counted at once.
            for batch in batches:
                for row, end in spans(batch):
                    for k in range(row, end, EMBEDDED_ROWS):
                        own = batch.slice(k, min(EMBEDDED_ROWS, end - k))
                        pair = pa.compute.list_parent_indices(own).to_numpy() * dims + pa.compute.list_flatten(own).to_numpy()
                        counts = np.bincount(pair, minlength=len(own) * dims).reshape(-1, dims).astype(np.float64)
                        norm = np.sqrt((counts * counts).sum(1, keepdims=True))
                        found = np.divide(counts, norm, out=np.zeros_like(counts), where=norm > 0).astype(np.float32)
                        yield pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, dims, dtype=np.int32)), pa.array(found.ravel()))
                del batch
                release()

        return embed(self.buckets(text))

    queries = passages


class ArrowEmbedder:
    """For models: `load` returns a function from a list of texts to a float matrix; it is called once in a worker.

    prefix goes before queries only."""

    def __init__(self, load, dims: int, prefix: str = "", batch: int = 16):
        self.load, self.dims, self.prefix, self.batch = load, dims, prefix, batch

    def passages(self, text: Column) -> Column:
        load, batch = self.load, self.batch

        @F.pandas_udf("array<float>")
        def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in parts:
                rows: list[np.ndarray] = []
                for k in range(0, len(texts), batch):
                    m = np.asarray(model(texts[k : k + batch].fillna("").tolist()), dtype=np.float32)
                    norm = np.linalg.norm(m, axis=1, keepdims=True)
                    rows += list(np.divide(m, norm, out=np.zeros_like(m), where=norm > 0))
                yield pd.Series(rows, index=texts.index)

        return embed(text)

    def queries(self, text: Column) -> Column:
        return self.passages(F.concat(F.lit(self.prefix), text))


def dot(a: Column, b: Column) -> Column:
    """For few rows; searches multiply matrices."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def best_of(score: np.ndarray, ids: pa.Array, names: pa.Array, k: int, id_col: str) -> pa.RecordBatch:
    """(query_id, id, score): the k best of each row of scores; of equal ones the first.  ids: those of the columns, sorted."""
    query, row = best_columns(score, k)
    return pa.RecordBatch.from_arrays([names.take(pa.array(query)), ids.take(pa.array(row)), pa.array(score[query, row])], ["query_id", id_col, "score"])


def compared(asked: np.ndarray, names: pa.Array, have: np.ndarray, ids: pa.Array, k: int, id_col: str, digits: int) -> Iterator[pa.RecordBatch]:
    """The best k rows for each query, COMPARED products at a time."""
    order = pa.compute.sort_indices(ids)
    have, ids = have[order.to_numpy()], ids.take(order)
    width = max(1, COMPARED // max(len(have), 1))
    for lo in range(0, len(asked) if len(have) else 0, width):
        score = np.round(asked[lo : lo + width] @ have.T, digits)
        yield best_of(score, ids, names.slice(lo, len(score)), k, id_col)


def ranked(found: DataFrame, k: int, id_col: str) -> DataFrame:
    """The k best of each query with `rank`.  Spark keeps k rows for each query and task before anything is shuffled."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(id_col))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def by_length(queries: pa.Table) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """(length, vectors, names) of the queries of each length."""
    column, names = queries.column("embedding").combine_chunks(), queries.column("query_id").combine_chunks()
    for dims in sorted(set(pa.compute.list_value_length(column).to_pylist())):
        wanted, good = matrix(column, dims)
        yield dims, wanted[good], names.filter(pa.array(good))


def _to_every_batch(vectors: DataFrame, rows: pa.Table, k: int, id_col: str, digits: int, schema: str) -> DataFrame:
    """A block of queries goes with the code to every batch of vectors, which isn't shuffled."""
    asked = list(by_length(rows))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            for dims, wanted, names in asked:
                have, good = matrix(batch.column(1), dims)
                yield from compared(wanted, names, have[good], batch.column(0).filter(pa.array(good)), k, id_col, digits)

    return vectors.mapInArrow(best, schema)


def in_blocks(n: int, each: int, *columns: str) -> tuple[Column, int]:
    """(number of a row's block, how many blocks there are): rows dealt by the hash of columns to blocks of about `each`."""
    count = max(1, -(-n // each))
    return F.pmod(F.xxhash64(*columns), F.lit(count)).cast("int"), count


def _grid(vectors: DataFrame, queries: DataFrame, n: int, k: int, id_col: str, digits: int, schema: str) -> DataFrame:
    """Blocks of queries and blocks of vectors meet in the cells of a grid, each one matrix product; nothing goes to the driver."""
    query_block, n_query_blocks = in_blocks(n, QUERY_BLOCK, "query_id")
    vector_block, n_vector_blocks = in_blocks(vectors.count(), VECTOR_BLOCK, id_col)
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = vectors.withColumn("v", vector_block).withColumn("q", every(n_query_blocks))
    right = queries.withColumn("q", query_block).withColumn("v", every(n_vector_blocks))

    def cell(have: pa.Table, asked: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": asked.column("query_id").slice(0, 0), id_col: have.column(0).slice(0, 0), "score": pa.array([], pa.float64())})
        if not (have.num_rows and asked.num_rows):
            return empty
        found = []
        for dims, wanted, names in by_length(asked):
            rows, good = matrix(have.column(1).combine_chunks(), dims)
            found += compared(wanted, names, rows[good], have.column(0).combine_chunks().filter(pa.array(good)), k, id_col, digits)
        return pa.Table.from_batches(found) if found else empty

    return left.groupBy("q", "v").cogroup(right.groupBy("q", "v")).applyInArrow(cell, schema)


def top(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "chunk_id", vector_col: str = "embedding", digits: int = 6) -> DataFrame:
    """(query_id, id, score, rank): the k nearest by cosine, for vectors of unit length; ties by id.

    queries: (query_id, embedding), any number.  One block of them (QUERY_BLOCK rows, checked) goes to the vectors, which stay
    where they are; more meet them in a grid of blocks, each cell of which gives its own best k for each query.  What is ranked
    is k rows for a query and cell, never all pairs.  Scores are rounded first, so that ties are the same everywhere.
    Vectors that are null, of another length than the query's or not finite aren't compared."""
    id_type, query_type = (df.schema[c].dataType.simpleString() for df, c in ((vectors, id_col), (queries, "query_id")))
    schema = f"query_id {query_type}, {id_col} {id_type}, score double"
    asked = queries.select("query_id", "embedding").where("embedding is not null")
    have = vectors.select(id_col, vector_col)
    head = asked.limit(QUERY_BLOCK + 1).agg(F.count("*"), F.max(F.size("embedding"))).first()
    if head[0] * (head[1] or 0) <= QUERY_VALUES and head[0] <= QUERY_BLOCK:
        found = _to_every_batch(have, asked.orderBy("query_id").toArrow(), k, id_col, digits, schema)
    else:
        found = _grid(have, asked, asked.count(), k, id_col, digits, schema)
    return ranked(found, k, id_col)


class Search(Protocol):
    """Finds the nearest vectors of each query: (query_id, id, score, rank), ties by id."""

    def top(self, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame: ...


class ExactSearch:
    """Compares every query with every vector."""

    def top(self, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        return top(vectors, queries, k)
