"""Grounded answers with citations, and abstention below a threshold."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import schemas

MIN_SCORE = 0.35

#: The reply without evidence, the reply when the model fails, and what counts as declining.
NO_EVIDENCE = "I don't have enough information in the uploaded documents to answer that."
MODEL_FAILED = "The language model could not be reached; please try again."
DECLINING = ("does not contain", "don't have enough information", "cannot find", "no information", "insufficient information")

INSTRUCTIONS = (
    "Answer the question from the excerpts below and from nothing else. Each excerpt starts with its source in brackets; "
    "name the sources you use. If the excerpts do not hold the answer, say that they do not."
)


class LanguageModel(Protocol):
    def generate_answer(self, query: str, context: list[tuple[str, str]]) -> str: ...

    def extract_structured(self, text: str, doc_type: str) -> str:
        """JSON text of a record of that type."""
        ...


class ExtractiveModel:
    """Needs no network: the sentence of the context that shares most words with the question, with its source."""

    def generate_answer(self, query: str, context: list[tuple[str, str]]) -> str:
        asked = set(re.findall(r"\w+", query.lower()))
        best = max(((len(asked & set(re.findall(r"\w+", s.lower()))), -i, -j, label, s.strip()) for i, (label, text) in enumerate(context) for j, s in enumerate(re.split(r"(?<=[.!?])\s+|\n+", text)) if s.strip()), default=None)
        return f"{best[4]} [{best[3]}]" if best else NO_EVIDENCE

    def extract_structured(self, text: str, doc_type: str) -> str:
        """Lines `field: value` of the text, by the record's field names."""
        import json

        names = re.findall(r"(\w+) (array|string|double)", re.sub(r"array<struct<.*?>>", "array", schemas.RECORDS[doc_type]))
        found: dict[str, object] = {}
        for line in text.splitlines():
            name, colon, value = line.partition(":")
            key = re.sub(r"\W+", "_", name.strip().lower())
            for field, kind in names:
                if colon and key == field and field not in found and value.strip():
                    number = re.sub(r"[^\d.\-]", "", value)
                    found[field] = [v.strip() for v in value.split(",") if v.strip()] if kind == "array" and field != "line_items" else float(number) if kind == "double" and number else value.strip()
        return json.dumps(found)


def prompts(hits: DataFrame, queries: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """(query_id, prompt) for queries with evidence, in native expressions; excerpts in rank order."""
    kept = hits.where(F.coalesce("semantic_score", F.lit(0.0)) >= min_score)
    blocks = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("["), "citation", F.lit("]\n"), "text").alias("block")))).alias("blocks"))
    text = F.concat(F.lit(INSTRUCTIONS + "\n\nExcerpts:\n"), F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n"), F.lit("\n\nQuestion: "), F.col("query"), F.lit("\nAnswer:"))
    return blocks.join(queries.select(F.col("query_id").cast("string").alias("query_id"), "query"), "query_id").select("query_id", text.alias("prompt"))


def is_no_answer(answer: Column, abstained: Column) -> Column:
    said = F.lower(answer)
    declined = F.lit(False)
    for phrase in DECLINING:
        declined = declined | F.contains(said, F.lit(phrase))
    return abstained | declined


def evidence(hits: DataFrame, queries: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """(query_id, query, top_score, context, citations): one row a query; top_score is null without hits."""
    score = F.coalesce("semantic_score", F.lit(0.0))
    relevant = score >= min_score
    found = hits.groupBy("query_id").agg(
        F.max(score).alias("top_score"),
        F.array_sort(F.collect_list(F.when(relevant, F.struct("rank", "citation", "text")))).alias("context"),
        F.array_sort(F.collect_set(F.when(relevant, F.col("citation")))).alias("citations"),
    )
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), "query").join(found, "query_id", "left")
    empty = F.array().cast("array<string>")
    return asked.withColumn("citations", F.coalesce("citations", empty)).withColumn("abstained", F.coalesce(F.size("context"), F.lit(0)) <= 0)


def answers(hits: DataFrame, queries: DataFrame, model: LanguageModel, min_score: float = MIN_SCORE) -> DataFrame:
    """One row a query in the schema of answers.  The model is called for queries with evidence only."""
    ready = evidence(hits, queries, min_score)

    def reply(query: str, context, abstained: bool) -> str:
        if abstained:
            return NO_EVIDENCE
        try:
            return model.generate_answer(query, [(c["citation"], c["text"]) for c in context])
        except Exception:  # a failed call is an answer of its own, not a lost job
            return MODEL_FAILED

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said = [reply(*row) for row in zip(batch["query"], batch["context"], batch["abstained"], strict=True)]
            yield batch.assign(answer=said)[["query_id", "query", "answer", "abstained", "citations", "top_score"]]

    return ready.mapInPandas(ask, schemas.ANSWERS)


def extract(texts: DataFrame, model: LanguageModel, doc_type: str) -> DataFrame:
    """texts (doc_id, text) with `record`: a struct of the type's schema; lists are empty rather than null.

    A failed call, or JSON that doesn't fit, fails the job, as a wrong record must not pass for one."""
    if doc_type not in schemas.RECORDS:
        raise ValueError(f"doc_type must be one of {sorted(schemas.RECORDS)}")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["doc_id"]].assign(json=[model.extract_structured(t, doc_type) for t in batch["text"]])

    said = texts.select("doc_id", "text").mapInPandas(ask, "doc_id string, json string")
    return said.select("doc_id", record_of(F.col("json"), doc_type).alias("record"))


def try_extract(texts: DataFrame, model: LanguageModel, doc_type: str) -> DataFrame:
    """(doc_id, record, failed): as extract(), but a failed call or JSON that doesn't fit marks its own row."""
    if doc_type not in schemas.RECORDS:
        raise ValueError(f"doc_type must be one of {sorted(schemas.RECORDS)}")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said = []
            for text in batch["text"]:
                try:
                    said.append(model.extract_structured(text, doc_type))
                except Exception:  # the other documents go on
                    said.append(None)
            yield batch[["doc_id"]].assign(json=said)

    said = texts.select("doc_id", "text").mapInPandas(ask, "doc_id string, json string")
    # What doesn't fit the schema is put aside as a corrupt record instead of failing the job.
    whole = F.from_json("json", schemas.RECORDS[doc_type] + ", __corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"})
    lines = F.forall(whole["line_items"], lambda i: i["description"].isNotNull()) if doc_type == "invoice" else F.lit(True)
    failed = F.col("json").isNull() | whole["__corrupt"].isNotNull() | ~F.coalesce(lines, F.lit(True))
    marked = said.select("doc_id", F.coalesce(failed, F.lit(True)).alias("failed"), "json")
    return marked.select("doc_id", F.when(~F.col("failed"), record_of(F.col("json"), doc_type)).alias("record"), "failed")


def record_of(json: Column, doc_type: str, mode: str = "FAILFAST") -> Column:
    record = F.from_json(json, schemas.RECORDS[doc_type], {"mode": mode})
    for part in schemas.RECORDS[doc_type].split(", "):
        name, _, kind = part.partition(" ")
        if kind.startswith("array"):
            record = record.withField(name, F.coalesce(record[name], F.array().cast(kind)))
    if doc_type == "invoice":
        whole = F.forall(record["line_items"], lambda i: i["description"].isNotNull())
        record = F.when(whole, record).otherwise(F.raise_error(F.lit("a line item has no description")))
    return record
