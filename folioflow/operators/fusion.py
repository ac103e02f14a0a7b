"""Search: keyword and semantic lists, fused by reciprocal ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import bm25, vector

RRF_CONSTANT = 60
MODES = ("hybrid", "semantic", "keyword")


def fuse(semantic: DataFrame, keyword: DataFrame, k: int, id_col: str = "chunk_id", constant: int = RRF_CONSTANT) -> DataFrame:
    """(query_id, id, score, semantic_score, keyword_score, rank): the sum of 1 / (constant + rank) over both lists.

    Ties go to the better semantic rank, then to the better keyword rank."""
    nothing = F.lit(None)
    both = semantic.select("query_id", id_col, F.col("rank").alias("s_rank"), nothing.cast("int").alias("k_rank"), F.col("score").alias("s"), nothing.cast("double").alias("k")).unionByName(
        keyword.select("query_id", id_col, nothing.cast("int").alias("s_rank"), F.col("rank").alias("k_rank"), nothing.cast("double").alias("s"), F.col("score").alias("k"))
    )
    part = F.coalesce(1.0 / (constant + F.col("s_rank")), F.lit(0.0)) + F.coalesce(1.0 / (constant + F.col("k_rank")), F.lit(0.0))
    merged = both.groupBy("query_id", id_col).agg(F.round(F.sum(part), 9).alias("score"), F.max("s").alias("semantic_score"), F.max("k").alias("keyword_score"), F.max("s_rank").alias("s_rank"), F.max("k_rank").alias("k_rank"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("s_rank").asc_nulls_last(), F.col("k_rank").asc_nulls_last(), F.col(id_col))
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("s_rank", "k_rank")


def search(chunks: DataFrame, index: bm25.Bm25Index, queries: DataFrame, embedder: vector.Embedder | None = None, k: int = 5, mode: str = "hybrid", doc_ids: list[str] | None = None, pool: int = 20, near: vector.Search | None = None) -> DataFrame:
    """Hits of every query (query_id, query), in the schema of hits.

    chunks: with `embedding` unless the mode is keyword.  doc_ids: an empty list is no filter; the keyword
    statistics stay global.  near: how the nearest vectors are found, exactly unless it says otherwise; under doc_ids always
    exactly, as the filter goes first.  Each list is cut to `pool` before fusion; the text joins the final rows only."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    inside = chunks.where(F.col("doc_id").isin(list(doc_ids))) if doc_ids else chunks
    queries = queries.select(F.col("query_id").cast("string").alias("query_id"), "query")
    null = F.lit(None).cast("double")
    if mode != "keyword":
        if embedder is None:
            raise ValueError(f"mode {mode} needs an embedder")
        asked = queries.select("query_id", embedder.queries(F.col("query")).alias("embedding"))
        close = (vector.ExactSearch() if near is None or doc_ids else near).top(inside, asked, pool)
    if mode != "semantic":
        found = bm25.top(index, queries, pool, inside.select("chunk_id") if doc_ids else None)
    if mode == "keyword":
        hits = found.where(F.col("rank") <= k).withColumn("semantic_score", null).withColumn("keyword_score", F.col("score"))
    elif mode == "semantic":
        hits = close.where(F.col("rank") <= k).withColumn("semantic_score", F.col("score")).withColumn("keyword_score", null)
    else:
        hits = fuse(close, found, k)
    # At most k rows for each query from here on.
    fields = ["chunk_id", "doc_id", "doc_name", "page", "section", "text", *(["embedding"] if mode == "hybrid" else [])]
    rows = chunks.select(*fields).join(F.broadcast(hits) if _few(queries, k) else hits, "chunk_id")
    if mode == "hybrid":
        rows = rows.join(asked.withColumnRenamed("embedding", "asked"), "query_id").withColumn("semantic_score", F.coalesce("semantic_score", F.round(vector.dot(F.col("embedding"), F.col("asked")), 6)))
    return rows.select("query_id", F.col("rank").cast("int").alias("rank"), "chunk_id", "doc_id", "doc_name", "page", "section", "text", X.citation(F.col("doc_name"), F.col("page"), F.col("section")).alias("citation"), "score", "semantic_score", "keyword_score")


def _few(queries: DataFrame, k: int, most: int = 100_000) -> bool:
    return queries.limit(most // max(k, 1) + 1).count() * k <= most
