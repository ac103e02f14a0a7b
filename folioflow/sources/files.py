"""Files to segments: read by binaryFile, named by content, parsed where they are read."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import running_lines
from folioflow.sources import docx, pdf

FILES = "path string, modificationTime timestamp, length long, content binary"
PARSED = "doc_id string, doc_name string, seg_no int, page int, section string, paragraphs array<string>, style string, cells array<array<string>>, error string"

#: A parser gives (page or null, section or null, paragraphs) for each segment, or blocks that are still to be put into sections.
Segment = tuple[int | None, str | None, list[str]]
Parser = Callable[[bytes], Iterable[Segment | docx.Block]]


def _pdf(content: bytes) -> list[Segment]:
    return [(i, None, p) for i, p in enumerate(pdf.pages(content), start=1)]


PARSERS: dict[str, Parser] = {".pdf": _pdf, ".docx": docx.blocks}


def read(spark: SparkSession, path: str) -> DataFrame:
    """A file, a folder or a pattern.  A path that isn't there is an error."""
    return spark.read.format("binaryFile").load(path)


def identified(files: DataFrame) -> DataFrame:
    return files.select("path", X.content_id(F.col("content")).alias("doc_id"), X.base_name(F.col("path")).alias("doc_name"), X.suffix(F.col("path")).alias("suffix"), "content")


def rows_of(doc_id: str, name: str, kind: str, content: bytes, parsers: dict[str, Parser]) -> list[tuple]:
    """The PARSED rows of a file: one for each segment or block; a single one with `error` if it can't be parsed or there is nothing in it."""
    try:
        if kind not in parsers:
            raise ValueError(f"unsupported file type: {kind or 'none'}")
        found = list(parsers[kind](content))
        if not any(not isinstance(p, docx.Block) or p.text.strip() or any(c.strip() for row in p.cells or () for c in row) for p in found):
            raise ValueError("nothing in it")
        parts = [(None, None, [p.text], p.style, p.cells) if isinstance(p, docx.Block) else (*p, None, None) for p in found]
        return [(doc_id, name, i, *part, None) for i, part in enumerate(parts)]
    except Exception as error:  # one bad file must not stop the others
        return [(doc_id, name, 0, None, None, [], None, None, f"{name}: {error}")]


def parse(files: DataFrame, parsers: dict[str, Parser] = PARSERS) -> DataFrame:
    """identified() rows to PARSED rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [row for d, n, k, c in zip(batch["doc_id"], batch["doc_name"], batch["suffix"], batch["content"], strict=True) for row in rows_of(d, n, k, bytes(c), parsers)]
            frame = pd.DataFrame(out, columns=["doc_id", "doc_name", "seg_no", "page", "section", "paragraphs", "style", "cells", "error"])
            yield frame.astype({"page": "Int32", "seg_no": "int32"})

    return files.select("doc_id", "doc_name", "suffix", "content").mapInPandas(run, PARSED)


def segments(parsed: DataFrame) -> DataFrame:
    """PARSED rows without errors to segments: blocks are put into sections, running lines of paged files go, text is cleaned, thin pages are flagged."""
    good = parsed.where("error is null")
    columns = ["doc_id", "doc_name", "seg_no", "page", "section", "paragraphs"]
    paged = running_lines.without_running_lines(good.where("page is not null").select(*columns))
    put = docx.sections(good.where("style is not null").select("doc_id", "doc_name", F.col("seg_no").alias("block_no"), "style", F.col("paragraphs")[0].alias("text"), "cells"))
    put = put.select("doc_id", "doc_name", "seg_no", F.lit(None).cast("int").alias("page"), "section", F.array("text").alias("paragraphs"))
    rows = paged.unionByName(good.where("page is null and style is null").select(*columns)).unionByName(put)
    text = X.clean_text(F.array_join("paragraphs", "\n\n"))
    out = rows.select("doc_id", "doc_name", "seg_no", "page", "section", text.alias("text"), F.lit("text").alias("method"))
    return out.withColumn("needs_ocr", F.col("page").isNotNull() & running_lines.needs_ocr(F.col("text")))
