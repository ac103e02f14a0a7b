"""Segments into chunks: windows over long paragraphs, greedy packing of short ones.

A segment is one row, and its chunks are made in that row, where the table is read.  Only their numbers look beyond it: one
exchange by document, in which a running sum of the segments' counts gives each segment its first number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import batches as B
from folioflow.functions import folds
from folioflow.functions import text as X

MAX_WORDS, OVERLAP_WORDS, MIN_WORDS = 180, 30, 5
BLANK_LINE = re.compile(r"\n\s*\n")


def check_sizes(max_words: int, overlap: int) -> None:
    if overlap >= max_words:
        raise ValueError("overlap_words must be smaller than max_words")


def units(text: str, max_words: int, overlap: int) -> Iterator[tuple[int, str]]:
    """(words, text) of each paragraph of at most max_words words, and of the windows over longer ones: each starts
    max_words - overlap words after the last, and the first that reaches the end is the last."""
    for paragraph in BLANK_LINE.split(text):
        words = paragraph.split()
        if len(words) > max_words:
            last = -(-(len(words) - max_words) // (max_words - overlap))
            windows = (words[at : at + max_words] for at in range(0, (last + 1) * (max_words - overlap), max_words - overlap))
            yield from ((len(w), " ".join(w)) for w in windows)
        elif words:
            yield len(words), paragraph.strip()


def packed(text: str, max_words: int, overlap: int, min_words: int) -> list[tuple[int, str]]:
    """(words, text) of the chunks of a segment: as many units as fit, a blank line between them; those under min_words go."""
    found = list(units(text, max_words, overlap))
    of = iter(folds.fitting_groups([n for n, _ in found], max_words))
    chunks = [list(c) for _, c in groupby(found, key=lambda _: next(of))]
    sizes = [sum(n for n, _ in c) for c in chunks]
    return [(n, "\n\n".join(t for _, t in c)) for n, c in zip(sizes, chunks, strict=True) if n >= min_words]


def chunk_segments(segments: DataFrame, max_words: int = MAX_WORDS, overlap_words: int = OVERLAP_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """chunks of segments, which doc_id and seg_no name.  No chunk spans two segments; chunks under min_words go before numbering; numbers restart for each document.

    A null or empty text has no chunks."""
    check_sizes(max_words, overlap_words)
    labels = ["doc_id", "doc_name", "seg_no", "page", "section", "method"]
    rows = segments.select(*labels, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("word_count", pa.int32()), ("text", pa.string())]))
        for batch in B.parts(batches, len(labels)):
            found = [packed(t or "", max_words, overlap_words, min_words) for t in batch.column(len(labels)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(labels)], pa.array(found, kind)], [*labels, "chunks"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    cut = rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in labels) + ", chunks array<struct<word_count:int,text:string>>")
    before = Window.partitionBy("doc_id").orderBy("seg_no").rowsBetween(Window.unboundedPreceding, -1)
    numbered = cut.withColumn("first", F.coalesce(F.sum(F.size("chunks")).over(before), F.lit(0)))
    each = numbered.select(*labels, "first", F.posexplode("chunks").alias("pos", "chunk"))
    index = (F.col("first") + F.col("pos")).cast("int")
    return each.select(X.chunk_id(F.col("doc_id"), index).alias("chunk_id"), "doc_id", "doc_name", "page", "section", index.alias("chunk_index"), "chunk.text", "chunk.word_count", "method")


def stats(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """n_segments, n_chunks and the mean words of a chunk (0 without chunks)."""
    counted = chunks.agg(F.count("*").alias("n_chunks"), F.coalesce(F.avg("word_count"), F.lit(0.0)).alias("mean_words"))
    return segments.agg(F.count("*").alias("n_segments")).crossJoin(counted)  # one row each
