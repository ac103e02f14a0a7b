"""Statuses of arriving documents as streaming state: a content is known by its first document, whenever that comes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folioflow.functions import text as X
from folioflow.operators.chunking import MIN_WORDS

#: The state store that keeps values of arbitrary processors.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATUSES = "content_id string, doc_id long, status string"


class Arrivals(StatefulProcessor):
    """Of each content the smallest document so far.  It is indexed, or no_text; every other is a duplicate, also one that was
    first until a smaller came: a status is only ever taken back to duplicate, so rows that say so win."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "doc_id long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        found = self.first.get()
        known = least = found[0] if found else None
        for row in rows:
            ids, first = row["doc_ids"], min(row["doc_ids"])
            beaten = [least] if least is not None and first < least else []
            least = first if least is None else min(least, first)
            yield Row(content_id=key[0], doc_ids=[*ids, *beaten], first=least, status="indexed" if row["enough"] else "no_text")
        if least != known:
            self.first.update((least,))

    def close(self) -> None:
        pass


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each content of a batch, with its documents: of a content that a third of all have, few rows reach its task."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).group_by("content_id", use_threads=False).aggregate([("doc_id", "list"), ("enough", "max")])
        yield from table.rename_columns(["content_id", "doc_ids", "enough"]).to_batches()


def statuses(documents: DataFrame) -> DataFrame:
    """STATUSES of a stream of documents (doc_id, text).  Rows without an id have no place in the order and are left out; a null text is empty; a
    document that comes again is no copy of itself."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.where("doc_id is not null").select(X.content_id(text.cast("binary")).alias("content_id"), F.col("doc_id").cast("long").alias("doc_id"), X.has_words(text, MIN_WORDS).alias("enough"))
    few = rows.mapInArrow(gathered, "content_id string, doc_ids array<long>, enough boolean")
    # Rows, not pandas frames: contents are many and have few documents, and a frame for each costs more than its state.
    told = few.groupBy("content_id").transformWithState(Arrivals(), "content_id string, doc_ids array<long>, first long, status string", "Append", "None")
    said = told.select("content_id", F.explode("doc_ids").alias("doc_id"), "first", "status")
    return said.select("content_id", "doc_id", F.when(F.col("doc_id") == F.col("first"), F.col("status")).otherwise("duplicate").alias("status"))


def settled(told: DataFrame) -> DataFrame:
    """(doc_id, content_id, status) of all STATUSES rows so far."""
    last = told.groupBy("doc_id", "content_id").agg(F.max(F.col("status") == "duplicate").alias("again"), F.max("status").alias("other"))
    status = F.when(F.col("again"), "duplicate").otherwise(F.col("other"))
    return last.select("doc_id", "content_id", status.alias("status"))


@contextmanager
def state_store(spark: SparkSession):
    """The session with PROVIDER for its streams' state; as it was before at the end."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def track(documents: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """All that has come to a stream of documents since the last call, into the folder `out`; returns what is settled.

    A call that finds nothing new, or that takes up one that broke off, adds nothing twice: offsets and state are the checkpoint's,
    and the sink commits a batch's files once."""
    spark = documents.sparkSession
    with state_store(spark):
        stream = statuses(documents).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
        stream.trigger(availableNow=True).start().awaitTermination()
    return settled(spark.read.schema(STATUSES).parquet(out))
