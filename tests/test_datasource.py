"""Folders of documents as a data source: partitions, filters, streams and the sink."""

import os
import time

import pytest
from pyspark.sql import functions as F

from folioflow.plans.engine import Engine, Settings
from folioflow.sources import datasource, docx, files

from .test_documents import make_docx, make_pdf, words

BLOCKS = [docx.Block("", "before & <all>"), docx.Block("heading 1", "Scope"), docx.Block("", " two  words\tand a tab "), docx.Block("", "", [["a", "a", "b | c"], ["", " ", "d\ne"]]), docx.Block("", "")]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "deep er").mkdir(parents=True)
    (tmp_path / "in" / "a.pdf").write_bytes(make_pdf([["Enough text on this page"], []]))
    (tmp_path / "in" / "deep er" / "b ü.DOCX").write_bytes(make_docx([("p", "Head", "H1"), ("p", "words here")]))
    (tmp_path / "in" / "c.docx").write_bytes(make_docx([("p", " "), ("t", [["", " "]])]))
    (tmp_path / "in" / "d.txt").write_text("x")
    (tmp_path / "in" / "_hidden.pdf").write_text("x")
    (tmp_path / "in" / "e.pdf").write_bytes(b"")
    return str(tmp_path / "in")


def test_equals_parsing_binary_files(spark, folder):
    got = datasource.read(spark, folder)
    assert got.dtypes[2:] == spark.createDataFrame([], files.PARSED).dtypes
    rows = sorted((tuple(r)[2:] for r in got.collect() if r["doc_name"] != "e.pdf"), key=repr)  # binaryFile leaves files of no bytes out
    binary = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    assert rows == sorted((tuple(r) for r in files.parse(files.identified(binary)).collect()), key=repr)
    assert {r["doc_name"]: r["error"] is None for r in got.collect()} == {"a.pdf": True, "b ü.DOCX": True, "c.docx": False, "d.txt": False, "e.pdf": False}
    with pytest.raises(Exception, match="FileNotFoundError|nowhere"):
        datasource.read(spark, folder + "/nowhere").count()
    assert datasource.read(spark, "file:" + folder + "/a.pdf").count() == 2


def test_filters_choose_files_before_they_are_opened(spark, folder):
    reader = datasource.Reader({"path": folder})
    left = list(reader.pushFilters([datasource.EqualTo(("suffix",), ".docx"), datasource.In(("doc_name",), ("c.docx", "d.txt")), datasource.EqualTo(("page",), 1)]))
    assert [f.attribute for f in left] == [("page",)] and [os.path.basename(p) for part in reader.partitions() for p in part.paths] == ["c.docx"]
    some = datasource.read(spark, folder).where("suffix = '.docx' and doc_name like 'b%'")
    assert {r["doc_name"] for r in some.collect()} == {"b ü.DOCX"}
    assert {r["doc_name"] for r in datasource.read(spark, folder, pattern="*.pdf").collect()} == {"a.pdf", "e.pdf"}


def test_partitions_by_bytes(spark, folder):
    size = {f.base_name: f.size for f in datasource.listed(folder, "*")}
    parts = datasource.Reader({"path": folder, "partitionBytes": "900"}).partitions()
    assert len(parts) > 1 and all(len(p.paths) == 1 or sum(size[os.path.basename(x)] for x in p.paths) <= 900 for p in parts)
    assert sum(len(p.paths) for p in parts) == 5 and datasource.read(spark, folder, partitionBytes=900).rdd.getNumPartitions() == len(parts)


def test_round_trip_through_the_sink(spark, tmp_path):
    content = docx.written(BLOCKS)
    assert [(b.style, b.text, b.cells) for b in docx.blocks(content)] == [tuple(b) for b in BLOCKS]
    rows = spark.createDataFrame([(f"{i}.docx", bytearray(docx.written([docx.Block("heading 1", f"H{i}"), *BLOCKS[2:]]))) for i in range(7)], "name string, content binary").repartition(3)
    datasource.write(rows, str(tmp_path / "out"))
    datasource.write(rows, str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == [f"{i}.docx" for i in range(7)]
    found = datasource.read(spark, str(tmp_path / "out"))
    put = docx.sections(found.select("doc_id", "doc_name", F.col("seg_no").alias("block_no"), "style", F.col("paragraphs")[0].alias("text"), "cells"))
    assert {(r["section"], r["text"]) for r in put.collect()} == {(f"H{i}", f"H{i}\n\ntwo  words\tand a tab\n\na | b | c\n | d e") for i in range(7)}


def test_stream_of_new_files(spark, folder, tmp_path):
    datasource.register(spark)

    def run():
        stream = spark.readStream.format(datasource.NAME).load(folder)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r["doc_name"], r["seg_no"]) for r in spark.read.schema(datasource.SCHEMA).parquet(str(tmp_path / "out")).collect())

    time.sleep(1.2)
    first = run()
    assert {n for n, _ in first} == {"a.pdf", "b ü.DOCX", "c.docx", "d.txt", "e.pdf"}
    assert run() == first
    with open(folder + "/new.docx", "wb") as f:
        f.write(make_docx([("p", words(6))]))
    time.sleep(1.2)
    assert run() == sorted([*first, ("new.docx", 0)])


def test_nothing_in_a_file_is_a_failure(spark, folder, tmp_path):
    """Copies of it fail too; a page without text is no failure."""
    with open(folder + "/copy of c.docx", "wb") as out, open(folder + "/c.docx", "rb") as f:
        out.write(f.read())
    engine = Engine(spark, Settings(root=str(tmp_path / "store")))
    got = {r["doc_name"]: (r["status"], (r["error"] or "")[-13:]) for r in engine.ingest(folder + "/*.*").collect()}
    assert got["c.docx"] == got["copy of c.docx"] == ("failed", "nothing in it") and got["a.pdf"][0] in ("indexed", "no_text") and got["d.txt"][0] == "failed"
