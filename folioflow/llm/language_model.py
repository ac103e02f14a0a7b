"""Stupid-backoff scores of documents under the counts of their own corpus, relationally.

1. Texts are cut into blocks; a block lists its distinct n-grams of each order with their counts.  The lists
   are cut by hash into buckets, and each bucket adds up its part of the count tables: one column of hashes
   and one of counts for each (block, order), so a frequent n-gram is one entry for each block, however often
   and wherever it occurs.  Only cells with n-grams are rows, so rows are never more than a relation of
   (n-gram, block, count) has, however many blocks and buckets there are.
2. A bucket answers every block with the corpus counts of the n-grams it asked about, in the order asked.
3. A block joins the answers to its documents' n-grams and sums by document.

Every n-gram of every document counts, and an occurrence is scored without itself: with c the corpus counts,
S(w | context) = (c(context w) - 1) / (c(context) - 1) if c(context w) > 1, else ALPHA * S(w | shorter context);
of single words (c(w) - 1) / (N - 1), and half an occurrence if that is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import dealt

ORDER, ALPHA = 3, 0.4
BLOCK_BYTES = 10 << 20
BUCKET_ENTRIES = 3_000_000


def block_scores(words: np.ndarray, at: np.ndarray, order: int, counts: list[np.ndarray], n_words: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(sum of log scores of each text, number of words scored by each order).

    counts: for n = 1..order the corpus counts of the block's distinct n-grams, in the order of their hashes."""
    lengths = np.diff(at)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(words)) - at[doc]
    used = np.ones(len(words), dtype=np.int8)
    context = starts = score = np.zeros(0)
    for n in range(1, order + 1):
        runs, begins = W.grams(words, at, n)
        ids, inverse = np.unique(runs, return_inverse=True)
        if len(ids) != len(counts[n - 1]):
            raise RuntimeError("a block was answered for other n-grams than it has")
        whole = counts[n - 1][inverse].astype(np.float64)
        del runs, ids, inverse
        if n == 1:
            score = np.log(np.maximum(whole - 1, 0.5)) - np.log(max(n_words - 1, 1))
        else:
            longer = np.flatnonzero(place >= n - 1)  # where a run of n words ends, in the order of the runs
            before = context[starts[doc[longer]] + place[longer] - (n - 1)]
            seen = whole > 1
            score[longer] = np.where(seen, np.log(np.maximum(whole - 1, 1)) - np.log(np.maximum(before - 1, 1)), score[longer] + np.log(alpha))
            used[longer[seen]] = n
        context, starts = whole, begins
    n_docs = len(lengths)
    return np.bincount(doc, weights=score, minlength=n_docs).astype(np.float64), np.bincount(doc * order + used - 1, minlength=n_docs * order).reshape(n_docs, order)


def text_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """(block number, ids, word hashes, texts' beginnings); the same for the same partition."""
    import pyspark

    block = pyspark.TaskContext.get().partitionId() << 24
    ids, words, lengths, held = [], [], [], 0

    def whole():
        return block, pa.concat_arrays(ids), np.concatenate(words), np.concatenate(([0], np.cumsum(np.concatenate(lengths))))

    for batch in batches:
        for lo, hi, data, offsets in W.blocks(batch.column(1)):
            hashed, at = W.word_hashes(data, offsets)
            ids.append(batch.column(0).slice(lo, hi - lo))
            words.append(hashed)
            lengths.append(np.diff(at))
            held += len(data)
            if held >= BLOCK_BYTES:
                yield whole()
                block, ids, words, lengths, held = block + 1, [], [], [], 0
    if ids:
        yield whole()


def pack48(x: np.ndarray, bits: int) -> bytes:
    """The 48 bits below a bucket's `bits` leading ones."""
    x = (x << np.uint64(bits)) >> np.uint64(16)
    return x.astype(np.uint32).tobytes() + (x >> np.uint64(32)).astype(np.uint16).tobytes()


def unpack48(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return np.frombuffer(data, np.uint32, n).astype(np.uint64) | (np.frombuffer(data, np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(32))


def pack_sorted(x: np.ndarray, bits: int) -> bytes:
    """Sorted hashes of a bucket, below its `bits` leading ones: 48 bits each, or steps of 40 bits where all are so small."""
    x = (x << np.uint64(bits)) >> np.uint64(16)
    step = np.diff(x, prepend=np.uint64(0))
    if len(x) and int(step.max()) >> 40:
        return b"6" + pack48(x, 0)
    return b"5" + step.astype(np.uint32).tobytes() + (step >> np.uint64(32)).astype(np.uint8).tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    if data[:1] == b"6":
        return unpack48(data[1:])
    n = (len(data) - 1) // 5
    return np.cumsum(np.frombuffer(data, np.uint32, n, 1).astype(np.uint64) | (np.frombuffer(data, np.uint8, n, 1 + 4 * n).astype(np.uint64) << np.uint64(32)), dtype=np.uint64)


def pack_counts(x: np.ndarray) -> bytes:
    """A byte each, and eight more for those over 254."""
    return np.minimum(x, 255).astype(np.uint8).tobytes() + x[x > 254].astype(np.int64).tobytes()


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, np.int64, offset=n) if len(data) > n else 0
    return out


def checksum(words: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(W.mix(words + np.arange(len(words), dtype=np.uint64)))) >> 1 if len(words) else 0


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bytes, words) of each part of a partition."""
    for batch in batches:
        for _, _, data, offsets in W.blocks(batch.column(1)):
            yield pa.RecordBatch.from_arrays([pa.array([len(data)]), pa.array([len(W.spans(W.LOWER[data], offsets)[0])])], ["n_bytes", "n_words"])


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, alpha: float = ALPHA) -> DataFrame:
    """One row per input row: doc_id, n_words, log_score (sum), mean_log_score, by_order (words scored by each order).

    mean_log_score is null for texts without words (null, empty), whose log_score is 0.  N-grams do not cross
    documents.  Repeated rows count as often as they occur, each scored without itself.  An empty table gives
    an empty result; other columns are not looked at.  docs is read twice and must give the same partitions
    both times, as files do; blocks carry a checksum, and a mismatch is an error."""
    rows = docs.select(F.col(id_col), F.col(text_col))
    measured = rows.mapInArrow(W.lean(count_words), "n_bytes long, n_words long").agg(F.sum("n_bytes"), F.sum("n_words")).first()
    total, n_words = (int(x or 0) for x in measured)
    wanted = max(64, n_words * order // BUCKET_ENTRIES)
    bits = min(30, int(wanted - 1).bit_length())
    id_type = docs.schema[id_col].dataType.simpleString()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, words, at in text_blocks(batches):
            check = checksum(words)
            for n in range(1, order + 1):
                ids, counts = np.unique(W.grams(words, at, n)[0], return_counts=True)
                bucket = (ids >> np.uint64(64 - bits)).astype(np.int32)
                # A row for each bucket that has n-grams of the block; bucket 0 gets one in any case, so that no block is without rows.
                starts = np.flatnonzero(np.diff(bucket, prepend=-1))
                ends, to = np.append(starts[1:], len(ids))[: len(starts)], bucket[starts]
                if n == 1 and not (len(to) and to[0] == 0):
                    starts, ends, to = (np.concatenate(([0], x)) for x in (starts, ends, to))
                grams = [pack_sorted(ids[lo:hi], bits) for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True)]
                sums = [pack_counts(counts[lo:hi]) for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True)]
                m = len(to)
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(np.full(m, block)), pa.array(np.full(m, n, np.int32)), pa.array(np.full(m, check)), pa.array(grams, pa.binary()), pa.array(sums, pa.binary())], ["bucket", "block", "n", "check", "grams", "counts"])

    def add_up(table: pa.Table) -> pa.Table:
        orders, blocks, checks = (table.column(c).to_pylist() for c in ("n", "block", "check"))
        grams, counts = table.column("grams").to_pylist(), table.column("counts").to_pylist()
        out, bucket = [], table.column("bucket")[0].as_py()
        for n in sorted({*orders}):
            mine = [i for i, m in enumerate(orders) if m == n]
            keys = [unpack_sorted(grams[i]) for i in mine]
            ids, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.zeros(len(ids), dtype=np.int64)
            np.add.at(sums, inverse, np.concatenate([unpack_counts(counts[i], len(key)) for i, key in zip(mine, keys, strict=True)]))
            k = 0
            for i, key in zip(mine, keys, strict=True):
                out.append((blocks[i], n, bucket, checks[i], len(key), pack_counts(sums[inverse[k : k + len(key)]])))
                k += len(key)
        columns = list(zip(*out, strict=True))
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["block", "n", "bucket", "check", "size", "payload"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, words, at in text_blocks(batches):
            distinct, inverse, counts = np.unique(words, return_inverse=True, return_counts=True)
            by = np.argsort(-counts, kind="stable")
            rank = np.empty(len(by), dtype=np.uint32)
            rank[by] = np.arange(len(by), dtype=np.uint32)
            # The most frequent words have small numbers, so the high bytes, kept together, compress well.
            planes = np.ascontiguousarray(rank[inverse].astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("i", ids.type)])) as writer:
                writer.write_batch(pa.RecordBatch.from_arrays([ids], ["i"]))
            parts = [distinct[by].tobytes(), zstandard.compress(planes, 1), np.diff(at).astype(np.int64).tobytes(), sink.getvalue().to_pybytes()]
            payload = np.array([len(p) for p in parts], dtype=np.int64).tobytes() + b"".join(parts)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([checksum(words)]), pa.array([payload], pa.binary())], ["block", "check", "payload"])

    def settle(table: pa.Table, texts: pa.Table) -> pa.Table:
        n, bucket, check = (table.column(c).to_pylist() for c in ("n", "bucket", "check"))
        payload = table.column("payload")
        if len(texts) != 1 or {*check} != {texts.column("check")[0].as_py()}:
            raise RuntimeError("a block of the input changed between two reads; give score_documents a table that is read alike each time")
        data = texts.column("payload")[0].as_py()
        sizes = np.frombuffer(data, np.int64, 4)
        cuts = 32 + np.concatenate(([0], np.cumsum(sizes)))
        distinct, planes, lengths, ids = (data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        rank = np.ascontiguousarray(np.frombuffer(zstandard.decompress(planes), np.uint8).reshape(4, -1).T).view("<u4").ravel()
        words = np.frombuffer(distinct, np.uint64)[rank]
        at = np.concatenate(([0], np.cumsum(np.frombuffer(lengths, np.int64))))
        answers = sorted((n[i], bucket[i], i) for i in range(len(n)))
        size = table.column("size").to_pylist()
        counts = [np.concatenate([np.zeros(0, np.int64), *(unpack_counts(payload[i].as_py(), size[i]) for m, _, i in answers if m == k)]) for k in range(1, order + 1)]
        sums, used = block_scores(words, at, order, counts, n_words, alpha)
        length = np.diff(at)
        mean = pa.array(sums / np.maximum(length, 1), mask=length == 0)
        own = pa.ipc.open_stream(ids).read_all().column(0).combine_chunks()
        return pa.table([own, pa.array(length), pa.array(sums), mean, pa.array(used.tolist(), pa.list_(pa.int64()))], names=["doc_id", "n_words", "log_score", "mean_log_score", "by_order"])

    asked = dealt(rows.mapInArrow(W.lean(ask), "bucket int, block long, n int, check long, grams binary, counts binary"), "bucket", 3 * total)
    answers = dealt(asked.groupBy("bucket").applyInArrow(W.lean_group(add_up), "block long, n int, bucket int, check long, size long, payload binary"), "block", 2 * total)
    kept = dealt(rows.mapInArrow(W.lean(keep), "block long, check long, payload binary"), "block", 2 * total)
    return answers.groupBy("block").cogroup(kept.groupBy("block")).applyInArrow(W.lean_group(settle), f"doc_id {id_type}, n_words long, log_score double, mean_log_score double, by_order array<long>")
