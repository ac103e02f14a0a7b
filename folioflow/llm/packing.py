"""Lexical retrieval packing.

Documents stream through the partitions they are in; every run of about SHARD_TOKENS tokens is a shard with
its own BM25 inverted index over token ids, so memory and the cost of a retrieval are bounded whatever the
corpus, and nothing is shuffled.  A document's full windows become sequences of their own; what remains of
the longest documents seeds windows, and the index returns the seed's unused neighbours, which fill the
window greedily.  The last gap takes the beginning of the best neighbour, whose rest stays unused.  What a
shard has left over at the end is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

SHARD_TOKENS, SHARD_DOCS = 2_000_000, 8_000
NEIGHBOURS = 16
K1, B = 1.2, 0.75
CACHE_CHUNKS = 2_000_000
BATCH_CHUNKS = 4096
#: Characters that may part texts encoded together; the first that the tokenizer keeps as one token is taken.
MARKS = "|~^"
TEXT_BYTES = 1 << 19

#: Cutting at these bytes never cuts a token: the tokenizer's pattern has no match across white space.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 13, 32]] = True


class Encoder:
    """Token ids of whole texts; each distinct run of non-space bytes is encoded once and then looked up.

    For tokenizers that drop white space and never join what it parts.  New runs are encoded many at a time with a mark
    between them, a character that is one token wherever it stands; runs that hold it are encoded by themselves."""

    def __init__(self, path: str, most: int = CACHE_CHUNKS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        alone = {m: self.ids_of(m) for m in MARKS}
        self.mark = next((m for m, ids in alone.items() if len(ids) == 1 and self.ids_of(f"x {m} y {m} x") == [*self.ids_of("x"), *ids, *self.ids_of("y"), *ids, *self.ids_of("x")]), None)
        self.mark_id = alone[self.mark][0] if self.mark else -1
        self.clear()

    def ids_of(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def clear(self) -> None:
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted hashes, and where their ids are
        self.start, self.size, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 0
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def encode_each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of each text's)."""
        if self.mark and not any(self.mark in t for t in texts):
            ids = np.array(self.ids_of(f" {self.mark} ".join([*texts, ""])), dtype=np.uint32)
            marks = np.flatnonzero(ids == self.mark_id)
            if len(marks) == len(texts):
                return np.delete(ids, marks), np.diff(marks, prepend=-1) - 1
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], dtype=np.uint32), np.array([len(ids) for ids in found])

    def add(self, keys: np.ndarray, texts: list[str]) -> None:
        """keys: sorted, none of them known."""
        first = self.n
        marked = [self.mark is not None and self.mark in t for t in texts]
        order = [i for i, m in enumerate(marked) if not m] + [i for i, m in enumerate(marked) if m]
        n_plain = len(order) - sum(marked)
        edges = sorted({*range(0, n_plain, BATCH_CHUNKS), *range(n_plain, len(order), BATCH_CHUNKS), len(order)})
        for lo, hi in itertools.pairwise(edges):
            ids, sizes = self.encode_each([texts[i] for i in order[lo:hi]])
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
            while self.n + len(sizes) > len(self.start):
                self.start, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size))
            self.ids[self.used : self.used + len(ids)] = ids
            self.start[self.n : self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
            self.size[self.n : self.n + len(sizes)] = sizes
            self.used += len(ids)
            self.n += len(sizes)
        slot = np.empty(len(order), dtype=np.int32)
        slot[order] = np.arange(first, self.n, dtype=np.int32)
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at = np.insert(self.keys, place, keys), np.insert(self.at, place, slot)

    def known(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), dtype=bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin)."""
        inside = ~SPACE[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        key, first, inverse = np.unique(W.hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(key) > self.most:
            self.clear()
        new = np.flatnonzero(~self.known(key))
        if len(new):
            raw = data.tobytes()
            self.add(key[new], [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
        slots = self.at[np.searchsorted(self.keys, key)][inverse]
        size = self.size[slots].astype(np.int64)
        place = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.repeat(self.start[slots] - place[:-1], size) + np.arange(place[-1])]
        return ids, place[np.searchsorted(starts, offsets)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class ShardIndex:
    """BM25 postings over the token ids of one shard's documents."""

    def __init__(self, docs: list[np.ndarray]):
        lengths = np.array([len(d) for d in docs])
        owner = np.repeat(np.arange(len(docs), dtype=np.uint64), lengths)
        pair, tf = np.unique((owner << np.uint64(32)) | np.concatenate(docs), return_counts=True)
        doc, term = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        df = np.bincount(term)
        idf = np.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
        weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / lengths.mean()))).astype(np.float32)
        # A document's terms, and by term the documents; a term in one document alone finds nothing.
        self.term, self.bounds, self.df, self.seed = term, np.searchsorted(doc, np.arange(len(docs) + 1)), df, -1
        by = np.argsort(term, kind="stable")
        self.doc, self.weight, self.at = doc[by], weight[by], np.searchsorted(term[by], np.arange(len(df) + 1))

    def scores(self, seed: int) -> np.ndarray:
        """What each document scores by all terms of the seed; kept for the seed's next retrieval."""
        if self.seed != seed:
            terms = self.term[self.bounds[seed] : self.bounds[seed + 1]]
            terms = terms[self.df[terms] > 1]
            first, n = self.at[terms], self.df[terms]  # the terms' lists, added up at once
            place = np.repeat(first - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(n.sum())
            self.seed, self.score = seed, np.bincount(self.doc[place], weights=self.weight[place], minlength=len(self.bounds) - 1).astype(np.float64)
        return self.score

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share any of the seed's terms, best first, at most NEIGHBOURS."""
        score = self.scores(seed).copy()
        score[~unused] = 0
        found = np.flatnonzero(score)
        if len(found) > NEIGHBOURS:
            found = found[np.argpartition(-score[found], NEIGHBOURS)[:NEIGHBOURS]]
        return found[np.lexsort((found, -score[found]))]


def pack_shard(docs: list[np.ndarray], window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length); every id is in one piece, no sequence is over the window."""
    out, start = [], np.zeros(len(docs), dtype=np.int64)
    left = np.array([len(d) for d in docs], dtype=np.int64)
    for d in np.flatnonzero(left >= window).tolist():
        while left[d] >= window:
            out.append([(d, int(start[d]), window)])
            start[d] += window
            left[d] -= window
    index, unused = ShardIndex(docs), left > 0
    order = np.argsort(-left, kind="stable").tolist()
    tail: list[tuple[int, int, int]] = []

    def take(d: int, most: int) -> int:
        n = min(int(left[d]), most)
        tail.append((d, int(start[d]), n))
        start[d] += n
        left[d] -= n
        unused[d] = left[d] > 0
        return n

    at = 0
    while at < len(order):
        seed = order[at]
        if not unused[seed]:
            at += 1
            continue
        tail, room = [], window
        room -= take(seed, room)
        while room:
            near = index.neighbours(seed, unused)
            if not len(near):
                break
            for d in near.tolist():
                if left[d] <= room:
                    room -= take(d, room)
            if room and (open_ := [d for d in near.tolist() if unused[d]]):
                room -= take(open_[0], room)
        while room and at < len(order):  # no neighbour is left: the next document's beginning
            if unused[order[at]]:
                room -= take(order[at], room)
            else:
                at += 1
        if not room:
            out.append(tail)
            tail = []
    while tail:  # powers of two need no padding
        room, part, rest = 1 << (sum(n for _, _, n in tail).bit_length() - 1), [], []
        for d, s, n in tail:
            m = min(n, room)
            room -= m
            part += [(d, s, m)] * (m > 0)
            rest += [(d, s + m, n - m)] * (n > m)
        out.append(part)
        tail = rest
    return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids on request.

    window: a power of two.  A document is its token ids and end_id; null and empty texts are end_id alone.
    A seed retrieves by all of its terms, NEIGHBOURS documents at a time and again further down the list until its
    window is full or no unused document of the shard shares a term; then the longest unused one goes on.
    Sequences have `window` ids, or a power of two where a shard ends, so none is padded.  sequence_id is the
    partition's number and a count.  Repeated rows and ids are packed row by row; other columns are not looked at."""
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyspark

        sequence = pyspark.TaskContext.get().partitionId() << 32
        own = encoder(tokenizer)
        ids: list[pa.Array] = []
        shard: list[np.ndarray] = []
        tokens = 0

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, ids, shard, tokens
            rows: list[tuple] = []
            for pieces in pack_shard(shard, window):
                offset = 0
                for d, start, n in pieces:
                    part = shard[d][start : start + n]
                    rows.append((d, start, n, zlib.crc32(part.astype("<u4").tobytes()), len(shard[d]), sequence, offset))
                    offset += n
                sequence += 1
            columns = list(zip(*rows, strict=True))
            arrays = [pa.concat_arrays(ids).take(pa.array(columns[0], pa.int64())), *[pa.array(c, pa.int64()) for c in columns[1:]]]
            if with_ids:
                arrays.append(pa.array([shard[r[0]][r[1] : r[1] + r[2]].astype(np.int32) for r in rows], pa.list_(pa.int32())))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names[: len(arrays)])
            ids, shard, tokens = [], [], 0
            W.release()

        for batch in batches:
            for lo, hi, data, offsets in W.blocks(batch.column(1), TEXT_BYTES):
                found, at = own.encode(data, offsets)
                for i in range(hi - lo):
                    doc = np.append(found[at[i] : at[i + 1]], np.uint32(end_id))
                    ids.append(batch.column(0).slice(lo + i, 1))
                    shard.append(doc)
                    tokens += len(doc)
                    if tokens >= SHARD_TOKENS or len(shard) >= SHARD_DOCS:
                        yield from emit()
        if shard:
            yield from emit()

    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(W.lean(run), schema)
