"""The vector index against exact search, and exact search in a grid of blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.operators import quantizer, vector, vector_index
from folioflow.operators.vector_index import VectorIndex
from folioflow.plans import queries as plans
from folioflow.plans.engine import Engine, Settings

SCHEMA = "chunk_id int, embedding array<float>"


def unit(m):
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype("float32")


def frame(spark, m, more=()):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + list(more), SCHEMA).repartition(3)


def asked(df, of):
    return df.where(of).select(F.col("chunk_id").alias("query_id"), "embedding")


def found(df):
    return {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in df.collect()}


def recall(got, exact):
    of = lambda x: {(q, i) for (q, _), (i, _) in x.items()}
    return len(of(got) & of(exact)) / len(of(exact))


@pytest.fixture(scope="module")
def clustered(spark):
    """40 clusters of 25, 300 near copies of one vector, and rows that can't be compared."""
    r = np.random.default_rng(3)
    centres = np.concatenate([np.repeat(r.normal(size=(40, 24)), 25, 0), np.repeat(r.normal(size=(1, 24)), 300, 0)])
    m = unit(centres + 0.3 * r.normal(size=centres.shape) * np.repeat([1, 0.01], [1000, 300])[:, None])
    return frame(spark, m, [(5000, None), (5001, [1.0, 2.0]), (5002, [float("nan")] * 24), (5003, [None] * 24), (5004, [])]).cache()


def test_recall_of_the_registered_query(spark):
    sf = "/root/testdata/sf0.01"
    exact = {(r["query_id"], r["vec_id"]): r["score"] for r in plans.cosine_topk(spark, sf).collect()}
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in plans.cosine_index_topk(spark, sf).collect()}
    assert len(got) == len(exact) and len(got.keys() & exact.keys()) >= 0.9 * len(exact)
    assert all(exact[p] == s for p, s in got.items() if p in exact)


def test_index_in_many_cells_and_blocks(spark, clustered, tmp_path, monkeypatch):
    queries, exact = asked(clustered, "chunk_id % 20 = 0"), None
    exact = found(vector.top(clustered, queries, 10))
    monkeypatch.setattr(vector_index, "LIST_BLOCK", 40)
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vector_index, "LEAST_CANDIDATES", 400)
    index = VectorIndex.build(clustered, str(tmp_path / "v"), n_cells=16, recall=0.99, k=10)
    assert index.lists().count() == 1300 and max(index.n_blocks) >= 7 and len(index.model.cells) == 16
    got = found(index.top(None, queries, 10))
    assert recall({k: v for k, v in got.items() if k[0] < 1000}, {k: v for k, v in exact.items() if k[0] < 1000}) >= 0.9
    whole = found(index.top(None, queries, 10, probes=99))
    assert whole == exact  # every cell, and candidates enough for all near copies: nothing is left to chance
    alive = clustered.where("chunk_id % 3 = 0").select("chunk_id")
    some = found(index.top(None, queries, 10, probes=99, alive=alive))
    assert {i for i, _ in some.values()} <= set(range(0, 1300, 3)) and some


def test_a_query_gets_its_best_of_many_cells_at_once(spark, clustered, tmp_path, monkeypatch):
    """What is ranked doesn't grow with the cells that a query probes."""
    monkeypatch.setattr(vector_index, "LEAST_CANDIDATES", 10)
    index, given, ranked = VectorIndex.build(clustered, str(tmp_path / "v"), n_cells=16), [], vector.ranked
    monkeypatch.setattr(vector, "ranked", lambda found, k, name: given.append(found) or ranked(found, k, name))
    assert index.top(None, asked(clustered, "chunk_id % 20 = 0"), 1, probes=99).count() == 65
    assert given[0].count() == 65 * 10
    monkeypatch.setattr(vector_index, "LIST_BLOCK", 20)
    assert vector_index.bundled([10, 5, 100, 3, 0, 17, 1], [1, 1, 5, 1, 1, 1, 1]) == ([0, 0, 1, 6, 6, 6, 7], 8)


def test_few_queries_read_few_cells(spark, clustered, tmp_path, monkeypatch):
    index = VectorIndex.build(clustered, str(tmp_path / "v"), n_cells=16)
    plan = index.top(None, asked(clustered, "chunk_id = 3"), 5, probes=2)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and plan.count("cell") and "IN (" in plan


def test_empty_and_strange_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    index = VectorIndex.build(none, str(tmp_path / "a"))
    some = frame(spark, unit(np.eye(3)))
    assert index.top(None, asked(some, "true"), 3).count() == 0
    index = VectorIndex.build(some, str(tmp_path / "b"))
    assert index.top(None, asked(none, "true"), 3).count() == 0
    assert found(index.top(None, asked(some, "true"), 3)) == found(vector.top(some, asked(some, "true"), 3))
    same = frame(spark, unit(np.ones((9, 3))))
    index = VectorIndex.build(same, str(tmp_path / "c"))
    assert found(index.top(None, asked(same, "chunk_id = 0"), 4)) == {(0, n): (n - 1, 1.0) for n in range(1, 5)}


def test_grid_equals_one_block(spark, clustered, monkeypatch):
    queries = asked(clustered, "chunk_id % 20 = 0 or chunk_id > 4999")
    exact = found(vector.top(clustered, queries, 7))
    monkeypatch.setattr(vector, "QUERY_BLOCK", 15)
    monkeypatch.setattr(vector, "VECTOR_BLOCK", 300)
    assert {k: v for k, v in found(vector.top(clustered, queries, 7)).items() if k[0] < 5000} == {k: v for k, v in exact.items() if k[0] < 5000}
    assert vector.in_blocks(65, 15, "x")[1] == vector.in_blocks(1305, 300, "x")[1] == 5
    plan = vector.top(clustered, queries, 7)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "WindowGroupLimit" in vector.top(clustered, queries, 7)._jdf.queryExecution().executedPlan().toString()


def test_codes_give_inner_products():
    r = np.random.default_rng(1)
    model = quantizer.Quantizer(r.normal(size=(3, 10)), r.normal(size=(3, 8, 4)))
    x, q = r.normal(size=(20, 10)), r.normal(size=(5, 10))
    cell = model.near(x, 1)[:, 0]
    assert (np.argmin(((x[:, None] - model.cells[None]) ** 2).sum(2), 1) == cell).all()
    codes, missed = model.encode(x, cell)
    for c in range(3):
        own = np.flatnonzero(cell == c)
        stood = np.stack([model.cells[c] + model.books[np.arange(3), codes[i]].ravel()[:10] for i in own]) if len(own) else np.zeros((0, 10))
        assert np.allclose(model.scores(q, c, codes[own]), q @ stood.T, atol=1e-5)
        assert (np.linalg.norm(x[own] - stood, axis=1) <= missed[own] + 1e-9).all()


def test_engine_by_index(spark, tmp_path):
    """Adds and deletes after the index was built are seen."""
    engine = Engine(spark, Settings(root=str(tmp_path / "store")))
    text = lambda i: f"alpha{i} beta{i % 5} gamma delta epsilon"
    chunks = lambda of: spark.createDataFrame([(f"d{i}:0000", f"d{i}", f"{i}.pdf", 1, None, 0, text(i), 5, "text") for i in of], "chunk_id string, doc_id string, doc_name string, page int, section string, chunk_index int, text string, word_count int, method string").withColumn("embedding", engine.embedder.passages(F.col("text")))
    engine.store.add(chunks(range(60)))
    hits = lambda approximate: [(r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in engine.search([text(7), text(63), text(12)], 3, "semantic", approximate=approximate).orderBy("query_id", "rank").collect()]
    assert hits(True) == hits(False)  # no index yet
    engine.index_vectors()
    engine.index_vectors()
    assert hits(True) == hits(False)
    engine.store.add(chunks(range(60, 70)))
    engine.delete("d7")
    assert hits(True) == hits(False) and {h[2] for h in hits(True)} >= {"d63", "d12"} and "d7" not in {h[2] for h in hits(True)}
