"""Outcomes of golden questions and their rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow import schemas
from folioflow.operators.answering import is_no_answer


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of items; should_abstain is false where it is missing."""
    items = spark.read.schema(schemas.EVAL_ITEMS).json(path, multiLine=True)
    return items.withColumn("should_abstain", F.coalesce("should_abstain", F.lit(False)))


def outcomes(items: DataFrame, hits: DataFrame, answers: DataFrame) -> DataFrame:
    """One row an item: retrieval_hit and keywords_found (null where nothing is expected), abstain_correct.

    One search serves both retrieval and answer."""
    expected = F.coalesce("expected_doc", F.lit("")) != ""
    names = hits.groupBy(F.col("query_id").alias("id")).agg(F.collect_set(F.lower("doc_name")).alias("names"))
    said = answers.select(F.col("query_id").alias("id"), "answer", "abstained")
    keywords = F.coalesce("expected_keywords", F.array().cast("array<string>"))
    rows = items.join(names, "id", "left").join(said, "id", "left")
    found = F.coalesce(F.exists("names", lambda n: F.contains(n, F.lower(F.col("expected_doc")))), F.lit(False))
    return rows.select(
        "id", "query", F.when(expected, found).alias("retrieval_hit"),
        F.when(F.size(keywords) > 0, F.forall(keywords, lambda w: F.contains(F.lower(F.col("answer")), F.lower(w)))).alias("keywords_found"),
        (F.col("should_abstain") == is_no_answer(F.col("answer"), F.col("abstained"))).alias("abstain_correct"), "answer",
    )


def mark(outcome: Column) -> Column:
    return F.when(outcome.isNull(), "-").when(outcome, "PASS").otherwise("FAIL")


def rates(results: DataFrame) -> DataFrame:
    """One row a measure: measure, passed, total, rate (`n/a` without items)."""
    one = results.agg(*[x for c in ("retrieval_hit", "keywords_found", "abstain_correct") for x in (F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(f"{c}_passed"), F.count(c).alias(f"{c}_total"))])
    rows = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(f"{c}_passed").alias("passed"), F.col(f"{c}_total").alias("total")) for c in ("retrieval_hit", "keywords_found", "abstain_correct")])
    out = one.select(F.explode(rows).alias("r")).select("r.*")
    return out.withColumn("rate", F.when(F.col("total") == 0, "n/a").otherwise(F.concat(F.col("passed").cast("string"), F.lit("/"), F.col("total").cast("string"))))


def report(results: DataFrame) -> DataFrame:
    return results.select("id", mark(F.col("retrieval_hit")).alias("retrieval"), mark(F.col("keywords_found")).alias("keywords"), F.when(F.col("abstain_correct"), "PASS").otherwise("FAIL").alias("abstain"), "query")
