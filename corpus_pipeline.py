"""A corpus from documents to training sequences: toxicity, exact dedup, near dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all but the last
return the columns of documents.  run() writes each stage's rows as Parquet in the shared checkpoint folder
and gives them to the next, so a lost executor costs the tasks of one stage and nothing is computed twice.  Folders
that no stage reads any more are deleted; the last one, which the result reads, stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import decontaminate, exact_dedup, jaccard_join, packing, toxicity
from folioflow.llm.common import remove, scratch_folder, table


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.  Null and empty texts are scored as texts without terms; repeated rows share a verdict; the
    whole of a very long text counts."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays.  Null equals the empty text; rows that repeat id and text become one; a null id stays only
    where a group has no other."""
    return exact_dedup.keep_one_of_each(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the one with the smallest doc_id stays.  Null and empty texts are near to nothing and stay; rows with
    missing or repeated ids are told apart by their texts."""
    return jaccard_join.keep_one_of_each(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.  Null and empty texts hold none and stay, as do all rows if the benchmark is empty; every window of a very
    long text is asked."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens.  A null or empty text is its end mark alone; repeated rows are packed each; very long texts are cut."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", clean), ("exact_dedup", distinct), ("jaccard_join", unlike), ("decontaminate", unseen), ("packing", packed)]

#: No stage but the second can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder, before = table(spark, sf_dir, "documents"), scratch_folder(spark), None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)  # the stage that read it is written
        before = path
    return docs
