"""Removal of repeated byte strings, by prefix-free parsing.

1. Triggers: in every stretch of `length` bytes the run of CORE bytes with the least rolling hash is a trigger
   (the first of equals), so equal stretches have the same trigger at the same place wherever they stand.
   The triggers cut a text into phrases: the stretches that share a trigger, with all their bytes.
2. Dictionary: phrases are gathered by trigger.  Of equal phrases only the first in corpus order keeps its
   stretches; the others are repeats throughout.  A trigger with one phrase is settled.
3. Corpus order: where a trigger has several phrases, which agree around it and then part, the stretches of
   each are ordered by content and place, and all but the first of equal ones are repeats.

Phrases overlap by what a stretch needs to be whole, so no stretch is lost between two, and none is moved
more than twice.  The stretches of one trigger are ordered by 64-bit hashes and then place, which stands for
the suffix arrays of dictionary and parse: only equality of the first `length` bytes and the order of places
matter here.  Phrases that a third of all texts hold are one entry for each segment of the input.  Triggers
with very many phrases, in one segment (MANY) or among all (CROWD), are dealt out stretch by stretch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import dealt
from .language_model import pack48, unpack48

CORE = 32
SEGMENT_BYTES = 12 << 20
BUCKET_BYTES = 24 << 20
GROUP_BYTES = 4 << 20
MANY = 64
CROWD = 256
PIECE_BYTES = 1 << 20


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return W.hashes(data, starts, ends)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def phrases(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(trigger hash, phrase hash, text, first stretch, number of stretches) of every phrase of the texts."""
    n, none = len(data), np.zeros(0, np.int64)
    if n < length:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    place = np.arange(n - CORE + 1)
    hashed = span_hashes(data, place, place + CORE)
    mask = np.uint64((1 << 32) - 1)  # the same bits of the hash count wherever a stretch stands
    least = sliding_least((hashed & ~mask) | place.astype(np.uint64), length - CORE + 1) & mask
    cut = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cut, np.maximum(offsets[:-1], offsets[1:] - length + 1), 1)
    np.add.at(cut, offsets[1:], -1)
    inside = np.flatnonzero(np.cumsum(cut[: n - length + 1]) == 0)  # stretches that end within their text
    if not len(inside):
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    trigger = least[inside].astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (trigger[1:] != trigger[:-1]) | (inside[1:] != inside[:-1] + 1))))
    first, count = inside[new], np.diff(np.concatenate((new, [len(inside)])))
    text = np.searchsorted(offsets, first, "right") - 1
    # A trigger's hash is the least of many, so it is mixed again before its leading bits choose a bucket.
    return W.mix(hashed[trigger[new]]), W.mix(span_hashes(data, first, first + count - 1 + length) + count.astype(np.uint64)), text, first - offsets[text], count


def pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """phrases() of a block; a text over PIECE_BYTES alone in its block is taken piece by piece, so that memory stays bounded."""
    if len(data) <= PIECE_BYTES or len(offsets) > 2:
        yield phrases(data, offsets, length)
        return
    for a in range(0, len(data) - length + 1, PIECE_BYTES):
        part = data[a : a + PIECE_BYTES + length - 1]
        core, whole, text, place, count = phrases(part, np.array([0, len(part)]), length)
        yield core, whole, text, place + a, count


def first_of_equals(key: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether each row is the first, by document and place, of the rows with its key."""
    order = np.lexsort((place, doc, key))
    out = np.zeros(len(key), dtype=bool)
    sorted_key = key[order]
    out[order[np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))[: len(key)]]] = True
    return out


def equal_counts(key: np.ndarray) -> np.ndarray:
    """How many rows have each row's key."""
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    return counts[inverse] if len(key) else np.zeros(0, np.int64)


def batch_of(columns: list, names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def column_bytes(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()] or [np.zeros(0, kind)])


def parse(docs: DataFrame, length: int, bits: int) -> DataFrame:
    """Phrases by bucket of their trigger, packed in columns; and, in any bucket, phrases that their segment has settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            core, whole, doc, place, count = (np.concatenate(c) for c in zip(*held, strict=True))
            key = core + W.mix(whole)
            settled = np.zeros(len(key), dtype=bool)
            again = np.flatnonzero(equal_counts(key) > 1)
            settled[again] = ~first_of_equals(key[again], doc[again], place[again])
            open_ = np.flatnonzero(~settled)
            many = open_[equal_counts(core[open_]) > MANY]
            marked = np.zeros(len(key), dtype=np.uint8)
            if len(many):
                shown = first_of_equals(core[many], doc[many], place[many])
                marked[many[shown]] = 1
                marked[many[~shown]] = 2  # goes on unsettled, by itself
            aside = settled | (marked == 2)
            to = (core >> np.uint64(64 - bits)).astype(np.uint32)
            to[aside] = (W.mix(doc[aside].astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.uint32)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange((1 << bits) + 1))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                rows = order[cuts[b] : cuts[b + 1]]
                own, other = rows[~aside[rows]], rows[aside[rows]]
                yield batch_of(
                    [[b], [pack48(core[own], bits)], [pack48(whole[own], 0)], [doc[own].tobytes()], [place[own].astype(np.uint32).tobytes()], [count[own].astype(np.uint16).tobytes()], [marked[own].tobytes()],
                     [doc[other].tobytes()], [place[other].astype(np.uint32).tobytes()], [count[other].astype(np.uint16).tobytes()], [settled[other].tobytes()], [core[other][~settled[other]].tobytes()]],
                    ["bucket", "core", "whole", "doc", "place", "count", "marked", "o_doc", "o_place", "o_count", "o_settled", "o_core"], [pa.int32(), *[pa.binary()] * 11],
                )
            held.clear()

        for batch in batches:
            for lo, hi, data, offsets in W.blocks(batch.column(1)):
                ids = np.asarray(batch.column(0).slice(lo, hi - lo))
                for core, whole, text, place, count in pieces(data, offsets, length):
                    held.append((core, whole, ids[text], place, count))
                size += len(data)
                if size >= SEGMENT_BYTES:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return docs.mapInArrow(W.lean(run), "bucket int, core binary, whole binary, doc binary, place binary, count binary, marked binary, o_doc binary, o_place binary, o_count binary, o_settled binary, o_core binary")


def block_of(doc: np.ndarray, n_blocks: int) -> np.ndarray:
    """pmod(xxhash64(doc), n_blocks), as Spark computes it for a long: XXH64 of 8 bytes with seed 42."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    x = np.full(len(doc), (42 + int(p5) + 8) % 2**64, dtype=np.uint64) ^ (turn(doc.astype(np.int64).view(np.uint64) * p2, 31) * p1)
    x = turn(x, 27) * p1 + p4
    x = (x ^ (x >> np.uint64(33))) * p2
    x = (x ^ (x >> np.uint64(29))) * p3
    return (x ^ (x >> np.uint64(32))).view(np.int64) % n_blocks


def by_block(n_blocks: int, doc: np.ndarray, **columns: np.ndarray) -> pa.Table:
    """A row a block of documents, with its values of each column as bytes."""
    block = block_of(doc, n_blocks)
    order = np.argsort(block, kind="stable")
    blocks, at = np.unique(block[order], return_index=True)
    at = np.append(at, len(order))
    packed = {name: [values[order[at[i] : at[i + 1]]].tobytes() for i in range(len(blocks))] for name, values in {"doc": doc, **columns}.items()}
    return pa.table({"block": blocks.astype(np.int64), **{name: pa.array(x, pa.binary()) for name, x in packed.items()}})


def dictionary(bits: int, n_blocks: int):
    def settle(table: pa.Table) -> pa.Table:
        """Runs of stretches: known to be repeats, or to be ordered (core: their trigger; below 0 if it has very many phrases)."""
        core = np.concatenate([unpack48(x) for x in table.column("core").to_pylist()])
        whole = np.concatenate([unpack48(x) for x in table.column("whole").to_pylist()])
        doc, place, count, marked = column_bytes(table, "doc", "i8"), column_bytes(table, "place", "u4"), column_bytes(table, "count", "u2"), column_bytes(table, "marked", "u1")
        some = np.flatnonzero((equal_counts(core) > 1) | (marked > 0))
        core, whole, doc, place, count, marked = (x[some] for x in (core, whole, doc, place, count, marked))
        first = first_of_equals(W.mix(core) + W.mix(whole + np.uint64(77)), doc, place)
        distinct = np.zeros(len(core), dtype=np.int64)
        distinct[first] = equal_counts(core[first])
        is_many = np.isin(core, core[(marked > 0) | (distinct > CROWD)])
        go = ~first | (distinct > 1) | is_many
        # The bucket's number takes part, as its bits were cut off.
        bucket = W.mix(np.full(1, table.column("bucket")[0].as_py(), dtype=np.uint64))
        name = ((W.mix(core) + bucket) >> np.uint64(2)).astype(np.int64)
        name = np.where(is_many, -1 - name, name)
        settled = column_bytes(table, "o_settled", "?")
        o_core = np.zeros(len(settled), dtype=np.int64)
        o_core[~settled] = -1
        cat = lambda a, b: np.concatenate((a, b))
        known = cat(~first[go], settled)
        return by_block(
            n_blocks, cat(doc[go], column_bytes(table, "o_doc", "i8")), place=cat(place[go], column_bytes(table, "o_place", "u4")), count=cat(count[go], column_bytes(table, "o_count", "u2")),
            core=np.where(known, 0, cat(name[go], o_core)), known=known,
        )

    return settle


def begins_of(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)))


def texts_of(table: pa.Table) -> tuple[np.ndarray, pa.ChunkedArray]:
    """The documents of a block by number, and their texts."""
    table = table.sort_by("doc")
    return np.asarray(table.column("doc").combine_chunks()), table.column("text").combine_chunks()


def unsettled(length: int, bits: int):
    def run(runs: pa.Table, texts: pa.Table) -> pa.Table:
        """A block's documents with their runs: hands on the known runs, and the hashes of the others' stretches by trigger (or by hash)."""
        doc, place, count = column_bytes(runs, "doc", "i8"), column_bytes(runs, "place", "u4").astype(np.int64), column_bytes(runs, "count", "u2").astype(np.int64)
        core, known = column_bytes(runs, "core", "i8"), column_bytes(runs, "known", "?")
        order = np.argsort(doc, kind="stable")
        doc, place, count, core, known = (x[order] for x in (doc, place, count, core, known))
        n = np.where(known, 0, count)
        ids, column = texts_of(texts)
        parts = []
        for lo, hi, data, offsets in W.blocks(column):
            a, b = np.searchsorted(doc, ids[lo]), np.searchsorted(doc, ids[hi - 1], "right")
            own = n[a:b]
            text = np.searchsorted(ids[lo:hi], doc[a:b])
            start = np.repeat(offsets[text] + place[a:b] - begins_of(own)[:-1], own) + np.arange(own.sum())
            parts.append(span_hashes(data, start, start + length) if len(start) else np.zeros(0, np.uint64))
        hashed, at = np.concatenate([np.zeros(0, np.uint64), *parts]), begins_of(n)
        loose = (core < 0) & ~known
        each = np.repeat(np.arange(len(doc)), n)  # the run of each hash
        single = loose[each]
        s_doc, s_place, s_hash = doc[each[single]], (place[each] + np.arange(len(each)) - at[each])[single], hashed[single]
        repeat = ~first_of_equals(s_hash, s_doc, s_place)
        shift = np.uint64(64 - bits)
        to_run = (W.mix(np.where(known, doc, core).view(np.uint64)) >> shift).astype(np.int64)
        to_one = (np.where(repeat, W.mix(s_doc.view(np.uint64)), W.mix(s_hash)) >> shift).astype(np.int64)
        r_rows, o_rows = np.flatnonzero(~loose), np.arange(len(s_doc))
        r_rows, o_rows = r_rows[np.argsort(to_run[r_rows], kind="stable")], o_rows[np.argsort(to_one, kind="stable")]
        edges = np.arange((1 << bits) + 1)
        cut_runs, cut_ones = np.searchsorted(to_run[r_rows], edges), np.searchsorted(to_one[o_rows], edges)
        out: dict[str, list] = {c: [] for c in ("bucket", *STRETCHES)}
        for b in np.flatnonzero(np.diff(cut_runs) + np.diff(cut_ones)).tolist():
            r, o = r_rows[cut_runs[b] : cut_runs[b + 1]], o_rows[cut_ones[b] : cut_ones[b + 1]]
            take = np.repeat(at[r] - begins_of(n[r])[:-1], n[r]) + np.arange(n[r].sum())
            values = (doc[r], place[r].astype(np.uint32), count[r].astype(np.uint16), known[r], core[r][~known[r]])
            for c, x in zip(("bucket", *STRETCHES), (b, *[v.tobytes() for v in values], pack48(hashed[take], 0), s_doc[o].tobytes(), s_place[o].astype(np.uint32).tobytes(), s_hash[o].tobytes(), repeat[o].tobytes()), strict=True):
                out[c].append(x)
        return pa.table({"bucket": pa.array(out.pop("bucket"), pa.int32()), **{c: pa.array(x, pa.binary()) for c, x in out.items()}})

    return run


STRETCHES = ("doc", "place", "count", "known", "core", "hashed", "s_doc", "s_place", "s_hash", "s_repeat")


def order_stretches(n_blocks: int):
    def order(table: pa.Table) -> pa.Table:
        """Runs of stretches that are repeats, by block."""
        doc, place, count = column_bytes(table, "doc", "i8"), column_bytes(table, "place", "u4").astype(np.int64), column_bytes(table, "count", "u2").astype(np.int64)
        known = column_bytes(table, "known", "?")
        core = np.zeros(len(doc), dtype=np.int64)
        core[~known] = column_bytes(table, "core", "i8")
        hashed = np.concatenate([unpack48(x) for x in table.column("hashed").to_pylist()])
        n = np.where(known, 0, count)
        each = np.repeat(np.arange(len(doc)), n)
        where = place[each] + np.arange(len(each)) - np.repeat(begins_of(n)[:-1], n)
        repeat = ~first_of_equals(W.mix(core[each].view(np.uint64)) + hashed, doc[each], where)
        s_doc, s_place, s_hash, s_repeat = column_bytes(table, "s_doc", "i8"), column_bytes(table, "s_place", "u4").astype(np.int64), column_bytes(table, "s_hash", "u8"), column_bytes(table, "s_repeat", "?").copy()
        rest = np.flatnonzero(~s_repeat)
        s_repeat[rest] = ~first_of_equals(s_hash[rest], s_doc[rest], s_place[rest])
        # Stretches that follow each other become one run.
        out_doc, out_place = np.concatenate((doc[each[repeat]], s_doc[s_repeat])), np.concatenate((where[repeat], s_place[s_repeat]))
        by = np.lexsort((out_place, out_doc))
        out_doc, out_place = out_doc[by], out_place[by]
        new = np.flatnonzero(np.concatenate(([True], (out_doc[1:] != out_doc[:-1]) | (out_place[1:] != out_place[:-1] + 1)))[: len(by)])
        length = np.diff(np.append(new, len(by)))
        return by_block(n_blocks, np.concatenate((doc[known], out_doc[new])), place=np.concatenate((place[known], out_place[new])).astype(np.uint32), count=np.concatenate((count[known], length)).astype(np.uint32))

    return order


def cut_texts(length: int):
    def run(runs: pa.Table, texts: pa.Table) -> pa.Table:
        doc, place, count = column_bytes(runs, "doc", "i8"), column_bytes(runs, "place", "u4").astype(np.int64), column_bytes(runs, "count", "u4").astype(np.int64)
        order = np.argsort(doc, kind="stable")
        doc, place, count = doc[order], place[order], count[order]
        ids, column = texts_of(texts)
        out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for lo, hi, data, offsets in W.blocks(column):
            a, b = np.searchsorted(doc, ids[lo]), np.searchsorted(doc, ids[hi - 1], "right")
            mark = np.zeros(len(data) + 1, dtype=np.int32)
            start = offsets[np.searchsorted(ids[lo:hi], doc[a:b])] + place[a:b]
            np.add.at(mark, start, 1)
            np.add.at(mark, start + count[a:b] - 1 + length, -1)
            gone = np.cumsum(mark[:-1]) > 0
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            heads = offsets[:-1][offsets[:-1] < len(data)]
            begins[heads] = gone[heads]
            total, spans = begins_of(gone), begins_of(begins)
            raw, keep = data[~gone].tobytes(), offsets - total[offsets]
            kept = [raw[keep[i] : keep[i + 1]] for i in range(hi - lo)]
            for c, x in zip(out, (np.diff(offsets).tolist(), np.diff(total[offsets]).tolist(), np.diff(spans[offsets]).tolist(), [hashlib.sha256(t).hexdigest() for t in kept], kept), strict=True):
                out[c] += x
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.table({"doc": pa.array(ids), **{c: pa.array(x, k) for (c, x), k in zip(out.items(), kinds, strict=True)}})

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay).

    A byte goes if a string of `length` bytes that covers it also starts earlier: in a smaller doc_id, or
    earlier in the same text.  Texts are UTF-8; null is empty; a text under `length` bytes loses nothing.
    Rows that repeat id and text are one document; of rows that repeat an id with other texts, the one with
    the smaller SHA-256 comes first; null ids come last.  Other columns are not looked at."""
    if not CORE < length < CORE + (1 << 16) - 1:
        raise ValueError(f"length must be over {CORE} and under {CORE + (1 << 16) - 1}")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    plain = isinstance(docs.schema[id_col].dataType, T.LongType | T.IntegerType | T.ShortType)
    total, n, n_ids = rows.agg(F.sum(F.octet_length("text")), F.count("*"), F.count("doc")).first()
    if not plain or n_ids < n or not rows.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        # Ids that are no numbers, missing or repeated: documents are numbered in their order.
        named = rows.withColumn("sha", F.sha2("text", 256))
        ordered = named.select("doc", "sha").distinct().orderBy(F.col("doc").asc_nulls_last(), "sha")
        numbered = ordered.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])).toDF(T.StructType([*ordered.schema.fields, T.StructField("number", T.LongType())]))
        numbered = numbered.select(F.col("doc").alias("id"), F.col("sha").alias("of"), "number")
        named = named.join(numbered, named["doc"].eqNullSafe(numbered["id"]) & (named["sha"] == numbered["of"]))
        one = named.groupBy("number").agg(F.first("text").alias("text")).select(F.col("number").alias("doc"), "text")
        found = cut(one, int(total or 0), length)
        return named.select(F.col("doc").alias("doc_id"), "number").join(found, F.col("number") == found["doc"]).drop("number", "doc")
    found = cut(rows.select(F.col("doc").cast("long").alias("doc"), "text"), int(total or 0), length)
    return found.select(F.col("doc").cast(docs.schema[id_col].dataType).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def cut(rows: DataFrame, total: int, length: int) -> DataFrame:
    """rows: (doc long, text string), each doc once and none null."""
    wanted = max(64, total // BUCKET_BYTES)
    bits = min(24, int(wanted - 1).bit_length())
    n_blocks = max(64, total // GROUP_BYTES)
    rows = rows.where("doc is not null")
    texts = dealt(rows.select(F.pmod(F.xxhash64("doc"), F.lit(n_blocks)).alias("block"), "doc", "text"), "block", 2 * total).groupBy("block")
    packed = lambda *columns: ", ".join(f"{c} binary" for c in columns)
    settled = dealt(parse(rows, length, bits), "bucket", 2 * total).groupBy("bucket").applyInArrow(W.lean_group(dictionary(bits, n_blocks)), f"block long, {packed('doc', 'place', 'count', 'core', 'known')}")
    stretches = dealt(settled, "block", 2 * total).groupBy("block").cogroup(texts).applyInArrow(W.lean_group(unsettled(length, bits)), f"bucket int, {packed(*STRETCHES)}")
    repeats = dealt(stretches, "bucket", 2 * total).groupBy("bucket").applyInArrow(W.lean_group(order_stretches(n_blocks)), f"block long, {packed('doc', 'place', 'count')}")
    return dealt(repeats, "block", 2 * total).groupBy("block").cogroup(texts).applyInArrow(W.lean_group(cut_texts(length)), "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
