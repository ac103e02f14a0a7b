"""Postings in compressed blocks, and the best chunks of a shard of them by block maxima.

A shard is a run of SHARD chunk numbers.  Of each term it has blocks of BLOCK chunks at most, in the order of their
numbers: numbers and positions as differences, all in variable bytes.  Beside a block stand its largest count and
smallest length, which bound what it can add to a score, and count and length of its best chunk, which was
there to give it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.batches import LIST_ENTRIES, parts, release, split_tokens
from folioflow.operators.bm25 import B, K1, terms_of

SHARD_BITS = 14
SHARD = 1 << SHARD_BITS
BLOCK = 128
#: Mean length that a block's best chunk is chosen by; it only decides how good the bound is.
USUAL_LENGTH = 150.0

BLOCKS = "term string, shard long, n int, first int, last int, max_tf int, min_dl int, top_tf int, top_dl int, ids binary, tfs binary, dls binary, positions binary"


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(variable bytes of whole numbers under 2 ** 35, where each number's end)."""
    v = values.astype(np.uint64)
    size = 1 + sum((v >= np.uint64(1 << (7 * k))).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(size)
    out = np.zeros(ends[-1] if len(ends) else 0, dtype=np.uint8)
    for k in range(5):
        more = size > k
        out[(ends - size)[more] + k] = ((v[more] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(size[more] > k + 1, 128, 0).astype(np.uint8)
    return out, ends


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    ends = raw < 128
    starts = np.concatenate(([0], np.flatnonzero(ends)[:-1] + 1))
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts)


def gain(tf: np.ndarray, dl: np.ndarray, avgdl: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / (avgdl or 1.0)))


def _pieces(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary values: the variable bytes of values[cuts[i] : cuts[i + 1]]."""
    data, ends = pack(values)
    at = np.concatenate(([0], ends))[cuts].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())])


def _from_previous(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences to the value before; at starts the value itself."""
    out = values.astype(np.int64).copy()
    out[1:] -= values[:-1]
    out[starts] = values[starts]
    return out


@dataclass
class Tokens:
    """The tokens of a part of a shard's chunks: number of the chunk in the shard, place in it, and number among `terms`; 12 bytes a token."""

    number: np.ndarray
    place: np.ndarray
    code: np.ndarray
    terms: pa.Array
    lengths: np.ndarray  # of each chunk

    @staticmethod
    def of(local: np.ndarray, tokens: pa.Array, stems: bool) -> Tokens:
        row, place, code, terms = terms_of(tokens, stems)
        small = np.int32
        return Tokens(local[row].astype(small), place.astype(small), code.astype(small), terms, np.bincount(row, minlength=len(tokens)).astype(small))


def shard_blocks(shard: int, local: np.ndarray, held: list[Tokens], block: int = BLOCK, entries: int | None = None) -> Iterator[pa.RecordBatch]:
    """The blocks of the chunks of a shard; local: their rising numbers in it.  Terms go in their order, so many at a time that they
    have about `entries` tokens."""
    own = pa.concat_arrays([t.terms for t in held]).dictionary_encode()
    order = pc.array_sort_indices(own.dictionary).to_numpy()
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    of_term, first = rank[own.indices.to_numpy()], np.cumsum([0, *(len(t.terms) for t in held)])
    terms = own.dictionary.take(pa.array(order))
    code = np.concatenate([of_term[lo:hi][t.code] for t, lo, hi in zip(held, first[:-1], first[1:], strict=True)])
    number, place = (np.concatenate([getattr(t, c) for t in held]) for c in ("number", "place"))
    length = np.zeros(SHARD, np.int64)
    length[local] = np.concatenate([t.lengths for t in held])
    held.clear()
    # Chunks and places rise already; a stable order by term keeps that.
    by = np.argsort(code, kind="stable")
    counts = np.concatenate(([0], np.cumsum(np.bincount(code, minlength=len(terms)))))
    del code
    lo = 0
    while lo < len(terms):
        hi = max(lo + 1, int(np.searchsorted(counts, counts[lo] + (entries or LIST_ENTRIES), "right")) - 1)
        at = by[counts[lo] : counts[hi]]
        term = np.repeat(np.arange(lo, hi), np.diff(counts[lo : hi + 1]))
        yield _term_blocks(shard, terms, term, number[at].astype(np.int64), place[at].astype(np.int64), length, block)
        lo = hi


def _term_blocks(shard: int, terms: pa.Array, term: np.ndarray, number: np.ndarray, place: np.ndarray, lengths: np.ndarray, block: int) -> pa.RecordBatch:
    """The blocks of tokens in the order of term, chunk and place."""
    n = len(term)
    begins = np.flatnonzero(np.concatenate((np.ones(min(1, n), bool), (term[1:] != term[:-1]) | (number[1:] != number[:-1]))))
    tf = np.diff(np.append(begins, n))
    term, number = term[begins], number[begins]
    nth = np.arange(len(term)) - np.searchsorted(term, term)
    cuts = np.append(np.flatnonzero(nth % block == 0), len(term))
    starts = cuts[:-1]
    if not len(starts):
        return pa.RecordBatch.from_pylist([], schema=SCHEMA)
    size = np.diff(cuts)
    length = lengths[number]
    worth = gain(tf, length, USUAL_LENGTH)
    best = np.lexsort((-worth, np.repeat(np.arange(len(size)), size)))[starts]
    positions = _from_previous(place, begins)
    columns = [
        terms.take(pa.array(term[starts])), pa.array(np.full(len(size), shard)), *[pa.array(c.astype(np.int32)) for c in (size, number[starts], number[cuts[1:] - 1], np.maximum.reduceat(tf, starts), np.minimum.reduceat(length, starts), tf[best], length[best])],
        _pieces(_from_previous(number, starts), cuts), _pieces(tf, cuts), _pieces(length, cuts), _pieces(positions, np.append(begins, n)[cuts]),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=SCHEMA)


_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
SCHEMA = pa.schema([(n, _KINDS[t]) for n, t in (c.split() for c in BLOCKS.split(", "))])


def blocks(chunks: DataFrame, stems: bool, block: int | None = None) -> DataFrame:
    """BLOCKS of chunks (number, tokens) whose numbers rise within a task.  A shard that is cut by two tasks has blocks of both."""

    size = block or BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, chunks = None, [], []
        for batch in parts(batches, 1):
            numbers = batch.column(0).to_numpy()
            own = numbers >> SHARD_BITS
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and own[lo] != shard:
                    yield from shard_blocks(shard, np.concatenate(chunks), held, size)
                    held, chunks = [], []
                shard = int(own[lo])
                chunks.append(numbers[lo:hi] & (SHARD - 1))
                held.append(Tokens.of(chunks[-1], split_tokens(batch.column(1).slice(lo, hi - lo)), stems))
        if held:
            yield from shard_blocks(shard, np.concatenate(chunks), held, size)
        release()

    return chunks.select("number", F.array_join("tokens", " ").alias("tokens")).mapInArrow(run, BLOCKS)


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, seq, number, dl, positions) of blocks, a row a posting."""
    for batch in batches:
        for term, seq, shard, *packed in zip(*[batch.column(c).to_pylist() for c in ("term", "seq", "shard", "ids", "tfs", "dls", "positions")], strict=True):
            ids, tf, dl, step = np.cumsum(unpack(packed[0])), unpack(packed[1]), unpack(packed[2]), unpack(packed[3])
            ends = np.cumsum(tf)
            total = np.cumsum(step)
            before = np.concatenate(([0], total[ends[:-1] - 1]))
            positions = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array((total - np.repeat(before, tf)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array([term] * len(ids)), pa.array(np.full(len(ids), seq, np.int32)), pa.array((shard << SHARD_BITS) + ids), pa.array(dl.astype(np.int32)), positions], ["term", "seq", "number", "dl", "positions"])


class Lists:
    """The blocks of one shard, decoded as they are asked for."""

    def __init__(self, table: pa.Table, dead: np.ndarray):
        columns = {c: table.column(c).to_pylist() for c in ("term", "first", "last", "max_tf", "min_dl", "ids", "tfs", "dls", "positions")}
        self.columns, self.dead = columns, np.sort(dead)
        self.of: dict[str, list[int]] = {}
        for i in np.argsort(table.column("first").to_numpy(), kind="stable").tolist():
            self.of.setdefault(columns["term"][i], []).append(i)
        self.first, self.last = np.array(columns["first"]), np.array(columns["last"])
        self.read: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.phrases: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, tf, dl) of the living."""
        if i not in self.read:
            got = [np.cumsum(unpack(self.columns["ids"][i])), unpack(self.columns["tfs"][i]), unpack(self.columns["dls"][i])]
            alive = ~np.isin(got[0], self.dead)
            self.read[i] = tuple(x[alive] for x in got)
        return self.read[i]

    def most(self, term: str, avgdl: float) -> float:
        """What a chunk of the shard can gain by a term at most."""
        own = self.of.get(term, [])
        return max((float(gain(self.columns["max_tf"][i], self.columns["min_dl"][i], avgdl)) for i in own), default=0.0)

    def whole(self, term: str, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, tf, dl) of a term; of the blocks alone that can hold one of the sorted ids `among`."""
        own = self.of.get(term, [])
        if among is not None:
            own = [i for i in own if np.searchsorted(among, self.first[i]) < np.searchsorted(among, self.last[i], "right")]
        parts = [self.block(i) for i in own]
        return tuple(np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in range(3))

    def starts(self, term: str) -> np.ndarray:
        """Rising id * 2 ** 32 + position of each place of a term."""
        out = [np.zeros(0, np.int64)]
        for i in self.of.get(term, []):
            ids, tf, step = np.cumsum(unpack(self.columns["ids"][i])), unpack(self.columns["tfs"][i]), unpack(self.columns["positions"][i])
            total, ends = np.cumsum(step), np.cumsum(tf)
            out.append((np.repeat(ids, tf) << 32) + total - np.repeat(np.concatenate(([0], total[ends[:-1] - 1])), tf))
        return np.concatenate(out)

    def phrase(self, phrase: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, f, dl) of a phrase: sorted places are intersected."""
        if phrase not in self.phrases:
            terms = phrase.split(" ")
            at = self.starts(terms[0])
            for k, term in enumerate(terms[1:], 1):
                at = np.intersect1d(at, self.starts(term) - k, assume_unique=True)
            ids, f = np.unique(at >> 32, return_counts=True)
            of, _, dl = self.whole(terms[0], ids)
            alive = np.isin(ids, of)
            ids, f = ids[alive], f[alive]
            self.phrases[phrase] = (ids, f, dl[np.searchsorted(of, ids)])
        return self.phrases[phrase]

    def best(self, weights: list[tuple[str, float]], k: int, avgdl: float, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best chunks, and of those that tie with the last, that reach `least`.

        Phrases go by falling bound.  Once the bounds that are left can't lift a new chunk to the threshold, only the blocks that can
        hold a chunk already met are read, and chunks that can't reach it any more are dropped."""
        bounds = sorted(((w * (self.most(p, avgdl) if " " not in p else K1 + 1), p, w) for p, w in weights), reverse=True)
        left = np.concatenate((np.cumsum([b for b, _, _ in bounds][::-1])[::-1], [0.0]))
        ids, score = np.zeros(0, np.int64), np.zeros(0)
        for n, (_, phrase, weight) in enumerate(bounds):
            floor = least - 1e-8  # sums in another order
            if len(score) >= k:
                floor = max(floor, float(np.partition(score, -k)[-k]) - 1e-8)
            closed = left[n] < floor
            if closed:
                able = score + left[n] >= floor
                ids, score = ids[able], score[able]
            if " " in phrase:
                have, f, dl = self.phrase(phrase)
            else:
                have, f, dl = self.whole(phrase, ids if closed else None)
            part = weight * gain(f, dl, avgdl)
            if closed:
                hit = np.isin(have, ids)
                score[np.searchsorted(ids, have[hit])] += part[hit]
            else:
                both = np.union1d(ids, have)
                total = np.zeros(len(both))
                total[np.searchsorted(both, ids)] += score
                total[np.searchsorted(both, have)] += part
                ids, score = both, total
        if len(score) > k:
            kept = np.round(score, 9) >= np.round(np.partition(score, -k)[-k], 9)
            ids, score = ids[kept], score[kept]
        return ids, score
