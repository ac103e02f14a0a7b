"""The registered queries at the smallest size, and the stages of the pipeline."""

import zlib

import pytest

from folioflow.llm import exact_dedup
from folioflow.llm import queries as Q

from .conftest import low

SF = "/root/testdata/sf0.001"


def value(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for name_ in ("documents", "labels"):
        con.execute(f"create view {name_} as select * from '{SF}/{name_}.parquet'")
    df, rel = Q.queries()[name](spark, SF), con.sql(Q.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    got = sorted((tuple(value(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    assert got == sorted((tuple(value(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_other_queries_return_every_document(spark):
    docs = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    for name in ("op3_repeats", "op4_packing", "op6_sharding", "op7_toxicity", "op10_license_scan"):
        assert {r["doc_id"] for r in Q.queries()[name](spark, SF).select("doc_id").collect()} == docs, name
    for r in Q.queries()["op7_toxicity"](spark, SF).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5)


@pytest.fixture(scope="module")
def pipeline():
    return pytest.importorskip("corpus_pipeline")


def test_stages_on_odd_tables(spark, pipeline, clashing, empty):
    for name, stage in pipeline.STAGES:
        out = stage(spark, clashing, SF)
        if name != "packing":
            assert out.columns == clashing.columns, name
        assert out.count() > 0 and stage(spark, empty, SF).count() == 0, name


def test_pipeline(spark, pipeline):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "decontaminate", "packing"]
    pieces = pipeline.run(spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = {p["doc_id"] for p in pieces}
    texts = [low(docs[i]) for i in kept]
    assert len(texts) == len(set(texts)) and len(kept) > 0.5 * len(docs)
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(i in docs[k] for i in items for k in kept)
    leaky = {d for d, t in docs.items() if any(i in t for i in items)}
    assert leaky and not leaky & kept


def test_exact_stage_keeps_the_largest_id(spark):
    rows = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "c")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in exact_dedup.keep_one_of_each(rows).collect()) == [2, 3]
