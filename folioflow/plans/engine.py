"""One object for all operations.  Every read operation takes a batch of queries; one query is a batch of one."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import answering, chunking, evaluation, fusion, vector
from folioflow.plans.store import Store, document_texts
from folioflow.scratch import checkpoint
from folioflow.sources import files

STATUSES = "path string, doc_id string, doc_name string, n_chunks int, status string, error string"


@dataclass
class Settings:
    root: str = field(default_factory=lambda: os.environ.get("FOLIOFLOW_STORE", "folioflow-store"))
    max_words: int = chunking.MAX_WORDS
    overlap_words: int = chunking.OVERLAP_WORDS
    min_words: int = chunking.MIN_WORDS
    pool: int = 20
    min_score: float = answering.MIN_SCORE


class Engine:
    def __init__(self, spark: SparkSession, settings: Settings | None = None, embedder: vector.Embedder | None = None, model: answering.LanguageModel | None = None, parsers: dict[str, files.Parser] | None = None):
        self.spark, self.settings = spark, settings or Settings()
        self.embedder, self.model = embedder or vector.HashingEmbedder(), model or answering.ExtractiveModel()
        self.parsers = files.PARSERS if parsers is None else parsers
        self.store = Store(spark, self.settings.root)

    # ingest

    def ingest(self, path: str) -> DataFrame:
        return self.ingest_files(files.read(self.spark, path))

    def ingest_files(self, found: DataFrame) -> DataFrame:
        """binaryFile rows into the store; returns a row a file: indexed, duplicate, no_text or failed.

        The rows are kept as a log under ingests/.

        Known and repeated contents are recognised by hash before anything is parsed; of equal files the first by path counts."""
        named = files.identified(found)
        # The statuses need identities and counts only; contents stay in the readers.
        first = named.groupBy("doc_id").agg(F.min("path").alias("first_path"))
        known = self.store.documents().select("doc_id", F.lit(True).alias("known"))
        placed = named.select("path", "doc_id", "doc_name").join(first, "doc_id").join(known, "doc_id", "left").withColumn("new", F.col("known").isNull() & (F.col("path") == F.col("first_path")))
        placed = placed.persist()
        parsed = files.parse(named.join(placed.where("new").select("path"), "path", "left_semi"), self.parsers).persist()
        chunks = None
        try:
            chunks = self.chunk(files.segments(parsed))
            chunks = chunks.withColumn("embedding", self.embedder.passages(F.col("text"))).persist()
            counts = chunks.groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))
            errors = parsed.where("error is not null").select("doc_id", "error")
            # Copies of a file that can't be parsed, or with nothing in it, fail as it does.
            status = F.when(F.col("error").isNotNull(), "failed").when(~F.col("new"), "duplicate").when(F.col("n").isNull(), "no_text").otherwise("indexed")
            out = placed.join(errors, "doc_id", "left").join(counts, "doc_id", "left").select("path", "doc_id", "doc_name", F.when(F.col("new"), F.coalesce("n", F.lit(0))).otherwise(0).alias("n_chunks"), status.alias("status"), "error")
            log = f"{self.settings.root}/ingests/{uuid.uuid4().hex}"  # what was found before the store changed
            out.write.parquet(log)
            self.store.add(chunks)
            return self.spark.read.schema(STATUSES).parquet(log).orderBy("path")
        finally:
            if chunks is not None:
                chunks.unpersist()
            parsed.unpersist()
            placed.unpersist()

    def chunk(self, segments: DataFrame) -> DataFrame:
        s = self.settings
        return chunking.chunk_segments(segments, s.max_words, s.overlap_words, s.min_words)

    # catalog

    def documents(self) -> DataFrame:
        return self.store.listing().select("doc_id", "doc_name", "n_chunks", "added_at")

    def delete(self, doc_id: str) -> bool:
        return self.store.delete([doc_id])

    def document_text(self, doc_id: str) -> str:
        return self.store.document_text(doc_id)

    # search and answers

    def queries(self, texts: str | list[str] | DataFrame) -> DataFrame:
        if isinstance(texts, DataFrame):
            return texts.select(F.col("query_id").cast("string").alias("query_id"), "query")
        texts = [texts] if isinstance(texts, str) else texts
        return self.spark.createDataFrame([(str(i), q) for i, q in enumerate(texts)], "query_id string, query string")

    def index_vectors(self) -> None:
        """Builds a vector index of what the store holds; searches with approximate=True use the newest."""
        self.store.index_vectors()

    def search(self, queries: str | list[str] | DataFrame, k: int = 5, mode: str = "hybrid", doc_ids: list[str] | None = None, approximate: bool = False) -> DataFrame:
        """approximate: vectors are found by the index, if one was built; under doc_ids they are compared exactly."""
        near = self.store.near() if approximate else vector.ExactSearch()
        return fusion.search(self.store.chunks(), self.store.index(), self.queries(queries), self.embedder, k, mode, doc_ids, self.settings.pool, near)

    def ask(self, queries: str | list[str] | DataFrame, k: int = 5, min_score: float | None = None) -> DataFrame:
        asked = self.queries(queries)
        return answering.answers(self.search(asked, k), asked, self.model, self.settings.min_score if min_score is None else min_score)

    def extract(self, doc_ids: list[str], doc_type: str) -> DataFrame:
        """(doc_id, record).  Unknown documents, and those without text, have no row."""
        return answering.extract(self._texts(doc_ids), self.model, doc_type)

    def extract_with_status(self, doc_ids: list[str], doc_type: str) -> DataFrame:
        """(doc_id, record, status), a row for each id asked for: extracted, no_text (unknown, or without text) or model_failed."""
        asked = self.spark.createDataFrame([(d,) for d in dict.fromkeys(doc_ids)], "doc_id string")
        found = answering.try_extract(self._texts(doc_ids), self.model, doc_type)
        status = F.when(F.col("failed").isNull(), "no_text").when(F.col("failed"), "model_failed").otherwise("extracted")
        return asked.join(found, "doc_id", "left").select("doc_id", "record", status.alias("status"))

    def _texts(self, doc_ids: list[str]) -> DataFrame:
        return document_texts(self.store.chunks().where(F.col("doc_id").isin(doc_ids)))

    def evaluate(self, items: DataFrame, k: int = 5) -> DataFrame:
        asked = items.select(F.col("id").alias("query_id"), "query")
        hits = checkpoint(self.search(asked, k))  # one search serves the hits and the answers
        return evaluation.outcomes(items, hits, answering.answers(hits, asked, self.model, self.settings.min_score))
