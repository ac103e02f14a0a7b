"""Stems, BM25, vectors, fusion, answers and evaluation; BM25 also against SQLite's FTS5."""

import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from folioflow import schemas
from folioflow.functions.porter import stem
from folioflow.operators import answering, bm25, evaluation, fusion, vector

CORPUS = [
    "The invoice payment is due within thirty days of the invoice date.",
    "Either party may terminate this agreement with sixty days written notice.",
    "Reference INV-2024-0042 was issued for the consulting work.",
    "Our office is closed on national holidays and weekends.",
]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(f"d1:{i:04d}", "d1", "a.pdf", i + 1, None, i, t, len(t.split()), "text") for i, t in enumerate(CORPUS)] + [("d2:0000", "d2", "b.pdf", 1, None, 0, "Payment terms of another vendor: due at once.", 8, "text")]
    df = spark.createDataFrame(rows, schemas.CHUNKS)
    return df.withColumn("embedding", vector.HashingEmbedder().passages(F.col("text"))).cache()


def ask(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "query_id string, query string")


#: Stems that a full-text index with Porter's algorithm gives.
STEMS = """payment payment days dai invoice invoic issued issu terminate termin closed close holidays holidai parties parti running run caresses caress ponies poni ties ti feed feed agreed agre
plastered plaster conflated conflat sized size hopping hop falling fall filing file happy happi relational relat conditional condit digitizer digit decisiveness decis triplicate triplic electrical electr
revival reviv allowance allow adjustable adjust replacement replac adoption adopt effective effect probate probat rate rate roll roll generalizations gener oscillators oscil ies ie as as ss ss ed ed bed bed sses sse oes oe""".split()


def test_stems():
    assert {w: stem(w) for w in STEMS[::2]} == dict(zip(STEMS[::2], STEMS[1::2], strict=True))
    assert stem("a" * 63 + "s") == "a" * 63 and stem("a" * 64 + "s") == "a" * 64 + "s"


def fts(texts):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    db.executemany("insert into t(rowid, x) values (?, ?)", enumerate(texts, 1))
    return db


def test_stems_equal_a_full_text_index():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist()
    found = sorted({w for t in texts for w in re.findall(r"[a-z]+", t.lower())})
    db = fts(found)
    db.execute("create virtual table v using fts5vocab('t', 'instance')")
    stems = {doc: term for term, doc in db.execute("select term, doc from v")}
    assert [(w, stem(w), stems[i]) for i, w in enumerate(found, 1) if stem(w) != stems[i]] == []


def test_bm25_equals_a_full_text_index(spark):
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist()
    asked = pq.read_table("/root/testdata/sf0.001/benchmark.parquet", columns=["text"]).column(0).to_pylist()[:12] + ["running run", "the of and", "", "___", 'payment" OR ( NEAR', texts[3].split()[0] + "_" + texts[3].split()[1]]
    index = bm25.build_index(spark.createDataFrame(list(enumerate(texts, 1)), "chunk_id int, text string"))
    got = {}
    for r in bm25.scores(index, ask(spark, *asked)).collect():
        got.setdefault(int(r["query_id"]), {})[r["chunk_id"]] = r["score"]
    db = fts(texts)
    from folioflow.functions.text import STOPWORDS

    for i, q in enumerate(asked):
        tokens = list(dict.fromkeys(t for t in re.findall(r"\w+", q.lower()) if t not in STOPWORDS))
        rows = db.execute("select rowid, -bm25(t) from t where t match ?", (" OR ".join(f'"{t}"' for t in tokens),)).fetchall() if tokens else []
        assert set(got.get(i, {})) == {r for r, _ in rows}, q
        assert all(abs(got[i][r] - s) < 1e-9 for r, s in rows), q


def test_persisted_index_gives_the_same(spark, chunks):
    asked = ask(spark, "invoice payment", "a_b agreement_with")
    plain, kept = bm25.build_index(chunks), bm25.build_index(chunks).persist()
    assert sorted(bm25.top(plain, asked).collect()) == sorted(bm25.top(kept, asked).collect())


def search(spark, chunks, *queries, **options):
    rows = fusion.search(chunks, bm25.build_index(chunks), ask(spark, *queries), vector.HashingEmbedder(), **options)
    assert [f"{n} {t}" for n, t in rows.dtypes] == schemas.HITS.replace(", ", ",").split(",")
    return rows.orderBy("query_id", "rank").collect()


def test_modes(spark, chunks):
    top = search(spark, chunks, "INV-2024-0042", mode="keyword")[0]
    assert top["page"] == 3 and top["keyword_score"] > 0 and top["semantic_score"] is None
    top = search(spark, chunks, "terminate agreement written notice", mode="semantic")[0]
    assert top["page"] == 2 and top["keyword_score"] is None
    hits = search(spark, chunks, "invoice payment due days")
    assert hits[0]["page"] == 1 and all(h["semantic_score"] is not None for h in hits) and hits[0]["citation"] == "a.pdf, p. 1"
    with pytest.raises(ValueError):
        search(spark, chunks, "x", mode="other")


def test_filter_and_strange_queries(spark, chunks):
    assert {h["doc_id"] for h in search(spark, chunks, "payment due", doc_ids=["d2"])} == {"d2"}
    assert {h["doc_id"] for h in search(spark, chunks, "payment due", doc_ids=[])} == {"d1", "d2"}
    for q in ('"quoted" OR (NEAR)', "*", "-", ""):
        search(spark, chunks, q)
    assert search(spark, chunks.limit(0), "payment") == []


def test_statistics_stay_global_under_a_filter(spark, chunks):
    index, asked = bm25.build_index(chunks), ask(spark, "payment due")
    whole = {r["chunk_id"]: r["score"] for r in bm25.top(index, asked).collect()}
    part = {r["chunk_id"]: r["score"] for r in bm25.top(index, asked, allowed=chunks.where("doc_id = 'd2'").select("chunk_id")).collect()}
    assert part == {k: v for k, v in whole.items() if k.startswith("d2")}


def test_rrf_scores_and_ties(spark):
    s = spark.createDataFrame([("q", "a", 0.9, 1), ("q", "b", 0.8, 2), ("q", "c", 0.7, 3)], "query_id string, chunk_id string, score double, rank int")
    k = spark.createDataFrame([("q", "a", 5.0, 1), ("q", "d", 4.0, 2), ("q", "e", 3.0, 3)], "query_id string, chunk_id string, score double, rank int")
    got = [(r["chunk_id"], r["score"]) for r in fusion.fuse(s, k, 5).orderBy("rank").collect()]
    assert got == [("a", 0.032786885), ("b", 0.016129032), ("d", 0.016129032), ("c", 0.015873016), ("e", 0.015873016)]


def test_vectors_in_blocks(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(0)
    m = r.normal(size=(50, 8)).astype("float32")
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(99, None)], "chunk_id int, embedding array<float>").repartition(3)
    asked = rows.where("chunk_id < 7").select(F.col("chunk_id").alias("query_id"), "embedding")
    expected = np.round(m[:7].astype(float) @ m.T.astype(float), 6)
    monkeypatch.setattr(vector, "QUERY_BLOCK", 3)
    got = vector.top(rows, asked, 5).collect()
    assert len(got) == 35
    for g in got:
        order = sorted(range(50), key=lambda j: (-expected[g["query_id"], j], j))
        assert order[g["rank"] - 1] == g["chunk_id"]
    assert vector.top(rows, asked.limit(0), 5).count() == 0


def test_arrow_embedder(spark):
    def load():
        return lambda texts: [[len(t), 1.0] for t in texts]

    e = vector.ArrowEmbedder(load, 2, prefix="ask: ", batch=2)
    rows = spark.createDataFrame([("abc",), (None,), ("abcdef",)], "t string")
    got = [r[0] for r in rows.select(e.passages(F.col("t"))).collect()]
    assert abs(got[0][0] - 3 / 10**0.5) < 1e-6 and got[1] == [0.0, 1.0]
    assert abs(rows.select(e.queries(F.col("t"))).first()[0][0] - 8 / 65**0.5) < 1e-6


class Recorder(answering.ExtractiveModel):
    def generate_answer(self, query, context):
        if "fail" in query:
            raise RuntimeError("no network")
        return f"{len(context)} excerpts"


def test_answers(spark, chunks):
    asked = ask(spark, "invoice payment due days", "zzz qqq", "fail: invoice payment due days")
    hits = fusion.search(chunks, bm25.build_index(chunks), asked, vector.HashingEmbedder()).cache()
    got = {r["query_id"]: r for r in answering.answers(hits, asked, Recorder(), 0.05).collect()}
    assert got["0"]["answer"].endswith("excerpts") and got["0"]["citations"] == sorted(got["0"]["citations"]) and not got["0"]["abstained"]
    assert got["1"]["abstained"] and got["1"]["answer"] == answering.NO_EVIDENCE and got["1"]["citations"] == []
    assert got["2"]["answer"] == answering.MODEL_FAILED and got["2"]["citations"]
    high = answering.answers(hits, asked, Recorder(), 0.99).collect()
    assert all(r["abstained"] for r in high) and {r["query_id"]: r["top_score"] for r in high}["0"] > 0.3
    shown = {r["query_id"]: r["prompt"] for r in answering.prompts(hits, asked, 0.05).collect()}
    context = [(h["citation"], h["text"]) for h in hits.where("query_id = '0' and semantic_score >= 0.05").orderBy("rank").collect()]
    excerpts = "\n\n".join(f"[{label}]\n{text}" for label, text in context)
    assert shown["0"] == f"{answering.INSTRUCTIONS}\n\nExcerpts:\n{excerpts}\n\nQuestion: invoice payment due days\nAnswer:"


def test_evaluation(spark):
    items = spark.createDataFrame([("1", "q", "A.pdf", ["30 Days"], False), ("2", "q", "b.pdf", ["x", "z"], False), ("3", "q", None, None, True), ("4", "q", "", [], True)], schemas.EVAL_ITEMS)
    hits = spark.createDataFrame([("1", "a.PDF"), ("2", "a.pdf")], "query_id string, doc_name string")
    answers = spark.createDataFrame([("1", "It is 30 days.", False), ("2", "x only", False), ("3", "I cannot find it", False), ("4", "Paris", False)], "query_id string, answer string, abstained boolean")
    results = evaluation.outcomes(items, hits, answers).cache()
    got = {r["id"]: (r["retrieval_hit"], r["keywords_found"], r["abstain_correct"]) for r in results.collect()}
    assert got == {"1": (True, True, True), "2": (False, False, True), "3": (None, None, True), "4": (None, None, False)}
    assert {r["measure"]: r["rate"] for r in evaluation.rates(results).collect()} == {"retrieval_hit": "1/2", "keywords_found": "1/2", "abstain_correct": "3/4"}
    assert {r["rate"] for r in evaluation.rates(results.limit(0)).collect()} == {"n/a"}


def test_records(spark):
    got = spark.createDataFrame([('{"invoice_number": "A", "total": 3}',)], "j string").select(answering.record_of(F.col("j"), "invoice").alias("r")).first()["r"]
    assert got["invoice_number"] == "A" and got["total"] == 3.0 and got["vendor"] is None and got["line_items"] == []
    assert set(schemas.RECORDS) == {"invoice", "resume", "contract"}
    for bad in ('{"line_items": [{"amount": 1}]}', "{broken"):
        with pytest.raises(Exception, match="description|MALFORMED|malformed"):
            spark.createDataFrame([(bad,)], "j string").select(answering.record_of(F.col("j"), "invoice")).collect()
    texts = spark.createDataFrame([("d", "Vendor: ACME\nTotal: 1,200.50 EUR\nnothing")], "doc_id string, text string")
    assert answering.extract(texts, answering.ExtractiveModel(), "invoice").first()["record"]["total"] == 1200.5
    with pytest.raises(ValueError):
        answering.extract(texts, answering.ExtractiveModel(), "poem")
