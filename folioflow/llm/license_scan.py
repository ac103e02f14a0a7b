"""License passages by diagonal voting.

Every text is cut into rolling word k-grams.  Those that occur in a template at all (the templates are
part of the program, so their hashes are few and fixed) are joined in Spark to the templates' positions.
Each match votes for a diagonal, its place in the text less its place in the template.  Votes are gathered
by diagonal (a bit for each k-gram of the template), neighbouring diagonals are merged so that a word more or less does not break a passage, and a
span is verified by the share of the template's k-grams that it holds.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W

K = 2
#: Templates over LONG_WORDS words are found by longer grams: pairs of words of a whole license stand in any text.
LONG_WORDS, LONG_K = 64, 5
#: Of a long template, diagonals further apart still are one passage: a word more or less in so many shifts the rest.
WORDS_A_SHIFT = 100


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False  # a phrase that counts wherever its words stand consecutively


#: Phrases and notices to look for, with their labels.
TEMPLATES = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
    Template("apache", "licensed under the apache license version 2 0"),
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("gpl", "this work is licensed under the gnu general public license version 3"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related rights"),
)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def templates_of(spark: SparkSession, path: str) -> tuple[Template, ...]:
    """The text files of a folder as templates; a file's name without its suffix is the label."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("label"), "value").orderBy("label").collect()
    return tuple(Template(r["label"], r["value"]) for r in rows)


def gram_size(n_words: int, k: int) -> int:
    return k if n_words <= LONG_WORDS else max(k, LONG_K)


def template_grams(templates: tuple[Template, ...], k: int) -> list[tuple[int, int, int, int]]:
    """(template number, position, gram hash, grams in the template)."""
    rows = []
    for number, t in enumerate(templates):
        words = W.hash_of(t.text)
        if len(words) < k:
            raise ValueError(f"a template needs {k} words or more: {t.text!r}")
        hashed, _ = W.grams(words, np.array([0, len(words)]), gram_size(len(words), k))
        rows += [(number, i, int(h), len(hashed)) for i, h in enumerate(signed(hashed))]
    return rows


def passages(v: list[dict], based: list[bool], slack: list[int], least: float) -> tuple[list[tuple[int, int, float]], float]:
    """((first, end, share) of each passage kept, in order; the largest share of all) of diagonals sorted by template and place.

    based, slack: of each template whether it is a base phrase, and how far apart the diagonals of a passage may be.

    Every diagonal is tried as the start of a group, so that stray grams before a passage don't split it.  The best
    share goes first, of equal ones the shortest group; what it leaves of an overlapping group is tried again."""

    def share_of(i: int, j: int) -> float:
        got = 0
        for x in v[i:j]:
            got |= x["votes"]
        return got.bit_count() / v[i]["n_grams"]

    ready, score, j = [], 0.0, 0
    for i, x in enumerate(v):
        base, j = based[x["template"]], max(j, i + 1)
        while not base and j < len(v) and v[j]["template"] == x["template"] and v[j]["diagonal"] - x["diagonal"] <= slack[x["template"]]:
            j += 1
        share = share_of(i, j)
        score = max(score, share)
        if share >= (1 if base else least):
            ready.append((-share, j - i, i))
    heapq.heapify(ready)
    used, kept = [False] * len(v), []
    while ready:
        less, size, i = heapq.heappop(ready)
        free = next((n for n in range(size) if used[i + n]), size)
        if free == size:
            kept.append((i, i + size, -less))
            used[i : i + size] = [True] * size
        elif free and (share := share_of(i, i + free)) >= least:
            heapq.heappush(ready, (-share, free, i))
    return sorted(kept), score


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, k: int = K, slack: int = 3, least: float = 0.8) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans: array of (label, start, end, coverage) in words, sorted.  A base template counts each place where
    its words stand consecutively (a diagonal with all its votes); any other counts where diagonals at most
    `slack` apart hold together a share `least` of its k-grams.  Templates may be of any length: those over LONG_WORDS words
    are found by LONG_K-grams, and their diagonals may be a word apart for each WORDS_A_SHIFT of them.  score: the largest coverage, of spans kept or
    not, 0 without any.  Null and empty texts give no words and no labels; repeated rows and null ids are
    reported row by row; other columns are not looked at."""
    spark = docs.sparkSession
    grams = template_grams(templates, k)
    sizes = [len(W.hash_of(t.text)) for t in templates]
    known = {size: np.unique(np.array([g[2] for g in grams if gram_size(sizes[g[0]], k) == size], dtype=np.int64)) for size in sorted({gram_size(n, k) for n in sizes})}
    long = any(n > LONG_WORDS for n in sizes)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyspark

        task, row = pyspark.TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi, data, offsets in W.blocks(batch.column(1)):
                hashed, at = W.word_hashes(data, offsets)
                doc, place, gram = (np.zeros(0, np.int64) for _ in range(3))
                for size, grams_of in known.items():
                    runs, begins = W.grams(hashed, at, size)
                    runs = signed(runs)
                    near = np.minimum(np.searchsorted(grams_of, runs), len(grams_of) - 1)
                    places = np.flatnonzero(grams_of[near] == runs)
                    own = np.searchsorted(begins, places, "right") - 1
                    doc, place, gram = np.concatenate((doc, own)), np.concatenate((place, places - begins[own])), np.concatenate((gram, runs[places]))
                if len(known) > 1:
                    order = np.argsort(doc, kind="stable")
                    doc, place, gram = doc[order], place[order], gram[order]
                per_doc = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=hi - lo)))).astype(np.int32)
                found = pa.StructArray.from_arrays([pa.array(place.astype(np.int64)), pa.array(gram)], ["place", "gram"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(hi - lo, task, np.int64)), pa.array(np.arange(row, row + hi - lo)), batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(per_doc), found)],
                    ["__task", "__row", "doc_id", "n_words", "__hits"],
                )
                row += hi - lo

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"__task long, __row long, doc_id {id_type}, n_words long, __hits array<struct<place:long,gram:long>>"
    rows = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(W.lean(hits), schema)
    positions = spark.createDataFrame(grams, "template int, position int, gram long, n_grams int")
    key = ["__task", "__row", "doc_id", "n_words"]
    votes = (
        rows.select(*key, F.explode_outer("__hits").alias("__hit"))
        .join(F.broadcast(positions), F.col("__hit.gram") == F.col("gram"), "left")
        .groupBy(*key, "template", (F.col("__hit.place") - F.col("position")).alias("diagonal"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, if(n_grams <= {LONG_WORDS - 1}, position, 0))")).alias("votes"), F.max("n_grams").alias("n_grams"), *([F.collect_set(F.expr(f"if(n_grams > {LONG_WORDS - 1}, position, null)")).alias("places")] if long else []))
    )
    fields = ["template", "diagonal", "votes", "n_grams", *(["places"] if long else [])]
    # A text's diagonals are at most its hits; they meet in one row of that text.
    per_doc = votes.groupBy(*key).agg(F.sort_array(F.collect_list(F.when(F.col("template").isNotNull(), F.struct(*fields)))).alias("v"))

    labels = [t.label for t in templates]
    based = [t.base for t in templates]
    apart = [slack if n <= LONG_WORDS else max(slack, n // WORDS_A_SHIFT) for n in sizes]
    ends = [gram_size(n, k) for n in sizes]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n_words, v in zip(batch.column("n_words").to_pylist(), batch.column("v").to_pylist(), strict=True):
                spans, firsts, base_labels, all_labels = [], [], set(), set()
                for x in v if long else ():
                    if x["places"]:
                        x["votes"] = sum(1 << p for p in x["places"])  # a set of any size
                found, score = passages(v, based, apart, least)
                for i, j, share in found:
                    t = v[i]["template"]
                    if based[t]:
                        firsts.append(v[i]["diagonal"])
                        base_labels.add(labels[t])
                    start = min(x["diagonal"] + (x["votes"] & -x["votes"]).bit_length() - 1 for x in v[i:j])
                    end = max(x["diagonal"] + x["votes"].bit_length() - 1 for x in v[i:j]) + ends[t]
                    all_labels.add(labels[t])
                    spans.append({"label": labels[t], "start": start, "end": end, "coverage": share})
                out.append((len(firsts), min(firsts, default=None), max(firsts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(all_labels)), score, sorted(spans, key=lambda s: (s["start"], s["end"], s["label"]))))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), *[pa.array(columns[c], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))))]],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    out = f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,coverage:double>>"
    return per_doc.mapInArrow(settle, out)
