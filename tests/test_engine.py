"""The store, the engine, streaming ingest and the driver's contract."""

import os

import pytest
from pyspark.sql import functions as F

from folioflow.operators import evaluation
from folioflow.plans.engine import Engine, Settings
from folioflow.streaming.ingest import ingest_new

from .test_documents import make_docx, make_pdf, words

PAGES = [["Payment of the invoice is due within thirty days of receipt of the goods."], ["Either party may terminate the agreement with sixty days written notice."]]


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.pdf").write_bytes(make_pdf(PAGES))
    (folder / "copy of a.pdf").write_bytes(make_pdf(PAGES))
    (folder / "b.docx").write_bytes(make_docx([("p", "Vendor: ACME", "H1"), ("p", words(12))]))
    (folder / "thin.pdf").write_bytes(make_pdf([["hi"]]))
    (folder / "bad.pdf").write_text("no")
    return folder


def test_life_of_documents(spark, tmp_path, landing):
    engine = Engine(spark, Settings(root=str(tmp_path / "store")))
    assert engine.search("payment").count() == 0 and engine.documents().count() == 0
    status = {r["doc_name"]: (r["status"], r["n_chunks"]) for r in engine.ingest(str(landing)).collect()}
    assert status == {"a.pdf": ("indexed", 2), "copy of a.pdf": ("duplicate", 0), "b.docx": ("indexed", 1), "thin.pdf": ("no_text", 0), "bad.pdf": ("failed", 0)}
    again = {r["doc_name"]: r["status"] for r in engine.ingest(str(landing)).collect()}
    assert again["a.pdf"] == again["b.docx"] == "duplicate" and again["thin.pdf"] == "no_text"
    assert [(r["doc_name"], r["n_chunks"]) for r in engine.documents().orderBy("doc_name").collect()] == [("a.pdf", 2), ("b.docx", 1)]
    top = engine.search(["terminate with written notice", "payment due"], k=1).orderBy("query_id").collect()
    assert [t["page"] for t in top] == [2, 1]
    doc = top[0]["doc_id"]
    assert engine.document_text(doc) == "\n\n".join(p[0] for p in PAGES) and engine.document_text("none") == ""
    said = engine.ask("When is payment of the invoice due?", min_score=0.1).first()
    assert not said["abstained"] and "thirty days" in said["answer"] and "a.pdf, p. 1" in said["citations"]
    other = engine.documents().where("doc_name = 'b.docx'").first()["doc_id"]
    assert engine.extract([other], "invoice").first()["record"]["vendor"] == "ACME"
    engine.settings.min_score = 0.1
    items = spark.createDataFrame([("1", "payment due", "A.PDF", ["thirty"], False)], "id string, query string, expected_doc string, expected_keywords array<string>, should_abstain boolean")
    assert {r["rate"] for r in evaluation.rates(engine.evaluate(items)).collect()} == {"1/1"}
    assert engine.delete(doc) and not engine.delete(doc) and not engine.delete("none")
    assert {h["doc_name"] for h in engine.search("payment notice").collect()} <= {"b.docx"}
    assert {r["doc_name"]: r["status"] for r in engine.ingest(str(landing)).collect()}["a.pdf"] == "indexed"
    assert engine.documents().count() == 2
    small = Engine(spark, Settings(root=str(tmp_path / "compact")))
    engine.store.compact(small.store)
    assert small.documents().count() == 2 and small.search("payment due", k=1).first()["page"] == 1


def test_a_write_without_commit_is_not_seen(spark, tmp_path, landing):
    engine = Engine(spark, Settings(root=str(tmp_path / "store")))
    engine.ingest(str(landing / "b.docx"))
    number = engine.store._committed()[-1]
    os.rename(tmp_path / "store" / "commits" / str(number), tmp_path / "gone")
    assert engine.documents().count() == 0 and engine.store.chunks().count() == 0


def test_writers_claim_numbers_of_their_own(spark, tmp_path, landing):
    engine = Engine(spark, Settings(root=str(tmp_path / "store")))
    first = engine.store._claim()
    assert engine.store._claim() == first + 1
    engine.ingest(str(landing / "b.docx"))
    assert engine.store._committed() == [first + 2] and engine.documents().count() == 1


def stored_like_built(engine, queries, k=5):
    """Postings, statistics and best chunks are those of an index built anew from the live chunks; returns the best."""
    from folioflow.operators import bm25

    stored, built = engine.store.index(), bm25.build_index(engine.store.chunks())
    rows = lambda index: sorted((r["term"], r["chunk_id"], r["dl"], sorted(r["positions"])) for r in index.postings().collect())
    assert rows(stored) == rows(built) and stored.stats.collect() == built.stats.collect()
    assert sorted(map(tuple, stored.frequencies().collect())) == sorted((r["term"], r["df"]) for r in built.term_counts().collect())
    found = lambda index: sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in bm25.top(index, queries, k).collect())
    assert found(stored) == found(built)
    return found(stored)


def test_the_stored_index_is_that_of_the_live_chunks(spark, tmp_path, landing):
    """Ingested in two writes, one document deleted, added again and deleted again."""
    engine = Engine(spark, Settings(root=str(tmp_path / "store")))
    for name in ("a.pdf", "b.docx"):
        engine.ingest(str(landing / name))
    asked = engine.queries(["payment of the invoice", "w3 agreement", "agreement_with thirty_days payment_of_the", ""])
    assert stored_like_built(engine, asked)
    first = engine.documents().where("doc_name = 'a.pdf'").first()["doc_id"]
    assert engine.delete(first)
    stored_like_built(engine, asked)
    engine.ingest(str(landing / "a.pdf"))
    assert stored_like_built(engine, asked)
    assert engine.delete(first)
    stored_like_built(engine, asked)
    plan = engine.store.index().postings(["payment"])._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "EqualTo(term,payment)" in plan.replace(" ", "")
    assert "chunks" not in engine.store.index().stats._jdf.queryExecution().toString()


def test_blocks_and_shards(spark, tmp_path, monkeypatch):
    """Many chunks in small blocks and shards, with skewed terms: the best by block maxima are the best of all."""
    import numpy as np

    from folioflow.operators import bm25, postings

    monkeypatch.setattr(postings, "BLOCK", 4)
    engine = Engine(spark, Settings(root=str(tmp_path / "store")))
    r = np.random.default_rng(3)
    text = lambda: " ".join(f"t{int(x)}" for x in np.minimum(r.zipf(1.3, int(r.integers(1, 60))), 400))
    schema = "chunk_id string, doc_id string, doc_name string, page int, section string, chunk_index int, text string, word_count int, method string"
    rows = [(f"d{i // 3}:{i % 3:04d}", f"d{i // 3}", "x.pdf", 1, None, i % 3, text(), 5, "text") for i in range(600)]
    chunks = spark.createDataFrame(rows, schema).withColumn("embedding", F.lit(None).cast("array<float>"))
    engine.store.add(chunks.where("doc_id < 'd5'"))
    engine.store.add(chunks)
    asked = engine.queries(["t1 t2 t3 t40 t41", "t1", "t7 t300 t301 t302", "t1_t1 t1_t2_t1 t5", "t2 T2 t9_t9", "nothing"])
    stored_like_built(engine, asked, 3)
    assert engine.store.delete([f"d{i}" for i in range(0, 200, 7)])
    stored_like_built(engine, asked, 2000)
    allowed = engine.store.chunks().where("chunk_index = 1").select("chunk_id")
    found = lambda index: sorted(map(tuple, bm25.top(index, asked, 4, allowed).select("query_id", "rank", "chunk_id", "score").collect()))
    assert found(engine.store.index()) == found(bm25.build_index(engine.store.chunks()))
    blocks = engine.store.table("postings").where("term = 't1'")
    assert blocks.count() > 20 and blocks.agg(F.max("n")).first()[0] == 4


def test_bytes_and_bounds():
    import numpy as np

    from folioflow.operators import postings

    r = np.random.default_rng(0)
    values = np.concatenate([r.integers(0, 2**b, 50) for b in (3, 7, 8, 14, 15, 21, 28, 34)] + [np.array([0, 127, 128, 2**35 - 1])])
    data, ends = postings.pack(values)
    assert (postings.unpack(data.tobytes()) == values).all() and ends[-1] == len(data)
    assert len(postings.unpack(b"")) == 0 and len(postings.pack(np.zeros(0, np.int64))[0]) == 0


def test_extraction_says_what_became_of_each_document(spark, tmp_path, landing):
    class Odd:
        def extract_structured(self, text, doc_type):
            if "ACME" in text:
                return '{"vendor": "ACME", "line_items": [{"amount": 1}]}' if doc_type == "invoice" else '{"name": "ACME"}'
            raise OSError("no model")

    engine = Engine(spark, Settings(root=str(tmp_path / "store")), model=Odd())
    engine.ingest(str(landing))
    ids = {r["doc_name"]: r["doc_id"] for r in engine.documents().collect()}
    status = lambda kind: {r["doc_id"]: (r["status"], r["record"] and r["record"][0]) for r in engine.extract_with_status([*ids.values(), "x"], kind).collect()}
    assert status("resume") == {ids["a.pdf"]: ("model_failed", None), ids["b.docx"]: ("extracted", "ACME"), "x": ("no_text", None)}
    assert status("invoice")[ids["b.docx"]][0] == "model_failed"
    with pytest.raises(ValueError):
        engine.extract_with_status(["x"], "poem")


def test_streaming_ingest(spark, tmp_path, landing):
    engine = Engine(spark, Settings(root=str(tmp_path / "store")))
    ingest_new(engine, str(landing), str(tmp_path / "progress"), files_per_batch=2)
    assert engine.documents().count() == 2
    (landing / "c.docx").write_bytes(make_docx([("p", words(20, "new"))]))
    ingest_new(engine, str(landing), str(tmp_path / "progress"), files_per_batch=2)
    assert sorted(r["doc_name"] for r in engine.documents().collect())[-1] == "c.docx" and engine.documents().count() == 3


def test_command_line(spark, tmp_path, landing, capsys):
    from folioflow import cli

    store = ["--store", str(tmp_path / "store")]
    for arguments in (["add", str(landing), "/no/such/path"], ["list"], ["search", "payment", "-k", "1", "--mode", "keyword"], ["ask", "payment due"], ["delete", "x"], ["extract", "x", "invoice"], ["chunk", str(landing / "a.pdf")]):
        assert cli.main([*store, *arguments]) == 0
    out = capsys.readouterr().out
    assert "error: /no/such/path" in out and "a.pdf, p. 1" in out and "x: not in the store" in out and "x: nothing to extract from" in out


SF = "/root/testdata/sf0.001"


def value(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


from folioflow.plans import oracles  # noqa: E402
from folioflow.plans import queries as plans  # noqa: E402


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_equals_its_sql(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    got = sorted((tuple(value(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    assert got
    if name in oracles.oracle_sql():
        rel = duck.sql(oracles.oracle_sql()[name])
        assert sorted(rel.columns) == sorted(df.columns)
        at = [rel.columns.index(c) for c in sorted(rel.columns)]
        assert got == sorted((tuple(value(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id").isin([1, 2])).select("text")
    plan = df._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id" in plan
