"""Streamed statuses against one pass over everything, in several batchings and after a restart."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.streaming import arrivals

SCHEMA = "doc_id long, text string"
TEXTS = ["one two three four five six", "short text", None, "", "a b c d e", "another text of more than five words"]


@pytest.mark.parametrize("order", ["rising", "falling", "mixed"])
def test_any_batching_gives_the_same(spark, tmp_path, order):
    rows = [(i, TEXTS[i * 7 % 11 % len(TEXTS)]) for i in range(1, 60)] + [(3, TEXTS[3 * 7 % 11 % len(TEXTS)]), (None, "one two three four five six")]
    expected = {}
    for i, t in rows:
        if i is not None:
            first = min(j for j, u in rows if j is not None and (u or "") == (t or ""))
            expected[i] = "duplicate" if i > first else "no_text" if len((t or "").split()) < 5 else "indexed"
    rows.sort(key=lambda r: (r[0] is None, r[0] if order == "rising" else -(r[0] or 0)))
    if order == "mixed":
        random.Random(5).shuffle(rows)
    landing = tmp_path / "in"
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(landing))
    for part in (rows[:13], rows[13:40]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(landing))
    track = lambda: {r["doc_id"]: r["status"] for r in arrivals.track(stream(), str(tmp_path / "out"), str(tmp_path / "log")).collect()}
    track()
    spark.createDataFrame(rows[40:], SCHEMA).coalesce(1).write.mode("append").parquet(str(landing))
    assert track() == expected
    told = spark.read.schema(arrivals.STATUSES).parquet(str(tmp_path / "out")).count()
    assert track() == expected and spark.read.schema(arrivals.STATUSES).parquet(str(tmp_path / "out")).count() == told


def test_words_are_read_no_further_than_needed(spark):
    texts = ["one two three four five six", "a b c d e", " \t a b c\u001cd　e ", "a b c d", "a b c d ", "  ", "", None, "x" * 200_000, " á \U0001f600 b\nc\n\nd", "e" * 100_000 + " b c d " + "f" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", X.has_words(F.col("t"), 5).alias("a"), (F.size(X.words(F.col("t"))) >= 5).alias("b"), X.has_words(F.col("t"), 1).alias("c"), (F.size(X.words(F.col("t"))) >= 1).alias("d")).collect()
    assert all(r["a"] == r["b"] and r["c"] == r["d"] for r in rows) and sum(r["a"] for r in rows) == 5


def test_a_batch_counts_no_words(spark, tmp_path):
    """A file is one task: what it does with a text must not be a split into all words."""
    spark.createDataFrame(list(enumerate(TEXTS)), SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    told = arrivals.statuses(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
    assert "split(" not in told._jdf.queryExecution().toString()
