"""Benchmark decontamination: a BM25 index of test items, searched with block-max WAND by every passage.

The test items are the small side, so they are indexed and the corpus streams past.  Items are ordered by
length class, then cut into shards of bounded size; the shards' indexes are broadcast, SCAN_SHARDS for one
reading of the corpus, and searched by every passage of every document (windows of twice the class's longest
item, moving by half a window, so that an item of the class stands whole in one of them).  A passage retrieves
every item whose BM25 score reaches `tau` of the score that the item's own text gets.  The statistics of BM25
(items, their mean length, the items that hold a term) are those of the whole benchmark, and the windows those
of the class, so the items retrieved don't depend on the shards.

Items are numbered by rising threshold, so the threshold at a pivot holds for all later items.  A passage
first takes WAND's pivot test over the whole shard at once, in NumPy: the lists of essential terms are added
up item by item, and the other terms count with their maxima, then with their lists where that leaves a
chance.  Only where some item reaches its threshold does the cursor search run.  What it retrieves is verified on the words: five-word runs of the
item found in the passage, and the words of its question and of its answer.
"""

from __future__ import annotations

import itertools
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import checkpoint, named, own_columns, unique_ids, without

K1, B = 1.2, 0.75
BLOCK = 16
SHARD_ITEMS, SHARD_WORDS = 20_000, 1_000_000
SCAN_SHARDS = 4
LENGTHS = [64 * 4**i for i in range(12)]


@dataclass
class Item:
    key: int
    words: np.ndarray
    question: np.ndarray  # distinct words
    answer: np.ndarray


@dataclass
class Statistics:
    """Of all items of the benchmark; df for the terms of one shard, in their order."""

    n_items: int
    mean_length: float
    df: np.ndarray


class Index:
    """Postings of one shard, by term: item numbers, weights, and the maxima of blocks of postings.

    Without statistics the shard is the whole benchmark; longest: the words of the longest item of its class."""

    def __init__(self, items: list[Item], n: int, tau: float, statistics: Statistics | None = None, longest: int = 0):
        lengths = np.array([len(i.words) for i in items])
        term = np.concatenate([i.words for i in items])
        item = np.repeat(np.arange(len(items)), lengths)
        self.terms, term = np.unique(term, return_inverse=True)
        pair, tf = np.unique(term.astype(np.int64) * len(items) + item, return_counts=True)
        term, item = pair // len(items), pair % len(items)
        of = statistics or Statistics(len(items), float(lengths.mean()), np.bincount(term, minlength=len(self.terms)))
        idf = np.log(1 + (of.n_items - of.df + 0.5) / (of.df + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / of.mean_length))
        own = np.bincount(item, weights=weight, minlength=len(items))
        order = np.argsort(own, kind="stable")
        number = np.empty_like(order)
        number[order] = np.arange(len(order))
        self.items = [items[i] for i in order]
        self.own, self.theta = own[order], tau * own[order]
        by = np.lexsort((number[item], term))
        self.item, self.weight = number[item][by], weight[by]
        self.at = np.searchsorted(term[by], np.arange(len(self.terms) + 1))
        self.most = np.maximum.reduceat(self.weight, self.at[:-1])
        self.stride = int(max(lengths.max(), longest) * 1.25) + 8
        low = np.cumsum(np.sort(self.most))
        optional = int(np.searchsorted(low, self.theta[0])) if len(low) else 0
        self.essential = np.ones(len(self.terms), dtype=bool)
        self.essential[np.argsort(self.most, kind="stable")[:optional]] = False
        self.runs = [np.unique(W.grams(i.words, np.array([0, len(i.words)]), min(n, len(i.words)))[0]) for i in self.items]
        self.n = n
        self.thresholds: list[float] = self.theta.tolist()
        self.opened: dict[int, tuple] = {}

    def sums(self, window: np.ndarray, term: np.ndarray, n_windows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, total weight of the window's terms in the item), for the pairs that share a term."""
        n = self.at[term + 1] - self.at[term]
        place = np.repeat(self.at[term] - np.concatenate(([0], np.cumsum(n)[:-1]))[: len(n)], n) + np.arange(n.sum())
        key, size = np.repeat(window, n) * len(self.items) + self.item[place], n_windows * len(self.items)
        if size <= 1 << 22:
            total = np.bincount(key, weights=self.weight[place], minlength=size)
            key = np.flatnonzero(total)
            total = total[key]
        else:
            key, inverse = np.unique(key, return_inverse=True)
            total = np.bincount(inverse, weights=self.weight[place], minlength=len(key))
        return key // len(self.items), key % len(self.items), total

    def screened(self, window: np.ndarray, term: np.ndarray, n_windows: int) -> np.ndarray:
        """Windows in which some item reaches its threshold.  (window, term) are distinct pairs.

        First the essential terms' lists, the others by their maxima; then all lists of the windows left."""
        must = self.essential[term]
        rest = np.bincount(window[~must], weights=self.most[term[~must]], minlength=n_windows)
        w, item, total = self.sums(window[must], term[must], n_windows)
        left = np.zeros(n_windows, dtype=bool)
        left[w[total + rest[w] >= self.theta[item] - 1e-9]] = True
        again = left[window]
        w, item, total = self.sums(window[again], term[again], n_windows)
        return np.unique(w[total >= self.theta[item] - 1e-9])

    def lists(self, term: int) -> tuple[list[int], list[float], list[float], list[int], float]:
        """A term's items and weights, the blocks' maxima and last items, and the largest weight."""
        if term not in self.opened:
            items, weights = self.item[self.at[term] : self.at[term + 1]], self.weight[self.at[term] : self.at[term + 1]]
            starts = np.arange(0, len(items), BLOCK)
            last = items[np.minimum(starts + BLOCK, len(items)) - 1]
            self.opened[term] = (items.tolist(), weights.tolist(), np.maximum.reduceat(weights, starts).tolist(), last.tolist(), float(weights.max()))
        return self.opened[term]

    def search(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """(item, score) of all items at or above their thresholds, by block-max WAND."""
        lists = [self.lists(t) for t in terms.tolist()]
        at, here, theta = [0] * len(lists), [own[0][0] for own in lists], self.thresholds
        live, found = list(range(len(lists))), []

        def advance(c: int, to: int) -> None:
            at[c] = bisect_left(lists[c][0], to, at[c])
            if at[c] < len(lists[c][0]):
                here[c] = lists[c][0][at[c]]
            else:
                live.remove(c)

        while live:
            live.sort(key=here.__getitem__)
            reach, pivot = 1e-9, -1
            for j, c in enumerate(live):
                reach += lists[c][4]
                if reach >= theta[here[c]]:
                    pivot = j
                    break
            if pivot < 0:
                break
            p = here[live[pivot]]
            while pivot + 1 < len(live) and here[live[pivot + 1]] == p:
                pivot += 1
            before = live[: pivot + 1]
            bound, leap = 1e-9, here[live[pivot + 1]] if pivot + 1 < len(live) else len(theta)
            for c in before:
                block = bisect_left(lists[c][3], p)
                if block < len(lists[c][3]):
                    bound += lists[c][2][block]
                    leap = min(leap, lists[c][3][block] + 1)
            if bound < theta[p]:
                for c in before:
                    advance(c, max(leap, p + 1))
            elif here[live[0]] == p:
                total = sum(lists[c][1][at[c]] for c in before)
                if total + 1e-9 >= theta[p]:
                    found.append((p, total))
                for c in before:
                    advance(c, p + 1)
            else:
                advance(max((c for c in before if here[c] < p), key=lambda c: lists[c][4]), p)
        return found

    def verify(self, number: int, passage: np.ndarray) -> tuple[float, float, float]:
        """Shares of the item's runs, of its question's words and of its answer's words that the passage holds."""
        item, runs = self.items[number], self.runs[number]
        n = min(self.n, len(item.words))
        have = W.grams(passage, np.array([0, len(passage)]), n)[0]
        share = lambda part, whole: float(np.isin(part, whole).mean()) if len(part) else 1.0
        return share(runs, have), share(item.question, passage), share(item.answer, passage)


def items_of(rows: list[tuple]) -> list[Item]:
    """rows: (item_id, question or text, answer or None).  A text alone is cut in half by words."""
    out = []
    for key, question, answer in rows:
        q, a = W.hash_of(question or ""), W.hash_of(answer or "")
        words = np.concatenate((q, a))
        if len(words) and key is not None:
            if not len(a):
                q, a = words[: (len(words) + 1) // 2], words[(len(words) + 1) // 2 :]
            out.append(Item(key, words, np.unique(q), np.unique(a)))
    return out


def measured(rows: DataFrame) -> DataFrame:
    """rows (id, q, a) with n_words and the distinct hashes of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [np.concatenate((W.hash_of(q or ""), W.hash_of(a or ""))) for q, a in zip(batch.column("q").to_pylist(), batch.column("a").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(w) for w in words], pa.int64()), pa.array([np.unique(w).view(np.int64) for w in words], pa.list_(pa.int64()))], ["id", "q", "a", "n_words", "terms"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, q string, a string, n_words long, terms array<long>")


def indexes(benchmark: DataFrame, id_col: str, question_col: str, answer_col: str | None, n: int, tau: float) -> Iterator[Index]:
    """The index of each shard, a bounded list of items of one length class; one at a time is on the driver."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(question_col).alias("q"), (F.col(answer_col) if answer_col else F.lit(None).cast("string")).alias("a"))
    found = measured(rows).where("n_words > 0 and id is not null")
    size = F.coalesce(*[F.when(F.col("n_words") <= m, F.lit(m)) for m in LENGTHS], F.lit(LENGTHS[-1]))
    found = checkpoint(found.withColumn("size", size))
    classes = found.groupBy("size").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"), F.max("n_words").alias("longest")).orderBy("size").collect()  # at most one row for each of LENGTHS
    n_items, n_words = sum(c["n"] for c in classes), sum(c["words"] for c in classes)
    cuts = [(c, max(1, -(-c["n"] // SHARD_ITEMS), -(-c["words"] // SHARD_WORDS))) for c in classes]
    holders = None
    if sum(parts for _, parts in cuts) > 1:
        holders = checkpoint(found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    for c, parts in cuts:
        for part in range(parts):
            own = found.where(F.col("size") == c["size"]).where(F.pmod(F.xxhash64("id", "q", "a"), F.lit(parts)) == part)
            items = items_of(sorted(((x["id"], x["q"], x["a"]) for x in own.select("id", "q", "a").collect()), key=lambda x: (x[0], x[1] or "", x[2] or "")))
            if not items:
                continue
            of = None
            if holders is not None:
                terms = np.unique(np.concatenate([i.words for i in items]))
                asked = spark.createDataFrame(pa.table({"term": terms.view(np.int64)}))  # at most SHARD_WORDS and one item
                counts = holders.join(F.broadcast(asked), "term").toArrow()
                order = np.argsort(np.asarray(counts.column("term").combine_chunks()).view(np.uint64))
                of = Statistics(n_items, n_words / n_items, np.asarray(counts.column("df").combine_chunks())[order])
            yield Index(items, n, tau, of, c["longest"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", question_col: str = "text", answer_col: str | None = None, tau: float = 0.6, n: int = 5, least: float = 0.8) -> DataFrame:
    """One row per (row of docs, item) that leaks: doc_id, item_id, start_word, score, overlap, question_overlap, answer_overlap.

    A leak is a passage that retrieves the item and holds a share `least` of its n-word runs, of its question's
    words and of its answer's words.  Of a document's passages the best counts (largest overlap, then first).
    score: BM25 by the score of the item's own text.  Items without words, null ids of items and empty or null
    texts match nothing; items of fewer than n words are one run.  An empty benchmark gives an empty table;
    repeated rows are matched row by row."""
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType
    out_schema = f"doc_id {id_type}, item_id {item_type.simpleString()}, start_word long, score double, overlap double, question_overlap double, answer_overlap double"
    rows = docs.select(F.col(id_col), F.col(text_col))
    context = docs.sparkSession.sparkContext
    found = None

    def searcher(handles):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            item_arrow = to_arrow_type(item_type)
            for batch in batches:
                for lo, hi, data, offsets in W.blocks(batch.column(1)):
                    hashed, at = W.word_hashes(data, offsets)
                    for handle in handles:
                        index, best = handle.value, {}
                        for doc, number, start, score, shares in leaks(index, hashed, at, least):
                            rank = (-shares[0], start)
                            if (doc, number) not in best or rank < best[doc, number][0]:
                                best[doc, number] = (rank, start, score, *shares)
                        pairs = sorted(best)
                        columns = [list(c) for c in zip(*[best[p][1:] for p in pairs], strict=True)] or [[]] * 5
                        ids = batch.column(0).slice(lo, hi - lo).take(pa.array([d for d, _ in pairs], pa.int64()))
                        yield pa.RecordBatch.from_arrays([ids, pa.array([index.items[i].key for _, i in pairs], item_arrow), pa.array(columns[0], pa.int64()), *[pa.array(c, pa.float64()) for c in columns[1:]]], ["doc_id", "item_id", "start_word", "score", "overlap", "question_overlap", "answer_overlap"])

        return run

    for some in itertools.batched((context.broadcast(i) for i in indexes(benchmark, item_col, question_col, answer_col, n, tau)), SCAN_SHARDS):
        part = rows.mapInArrow(W.lean(searcher(some)), out_schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], out_schema)


def leaks(index: Index, words: np.ndarray, at: np.ndarray, least: float) -> Iterator[tuple[int, int, int, float, tuple[float, float, float]]]:
    """(text, item, first word, score, shares) of every passage and item that pass."""
    term = np.minimum(np.searchsorted(index.terms, words), len(index.terms) - 1)
    place = np.flatnonzero(index.terms[term] == words)
    if not len(place):
        return
    term, counts = term[place], np.diff(at)
    windows = -(-counts // index.stride)
    first = np.concatenate(([0], np.cumsum(windows)))
    doc = np.searchsorted(at, place, "right") - 1
    step = (place - at[doc]) // index.stride
    mine = first[doc] + step
    earlier = np.flatnonzero(step > 0)
    key = np.unique(np.concatenate((mine, mine[earlier] - 1)) * len(index.terms) + np.concatenate((term, term[earlier])))
    window, term = key // len(index.terms), key % len(index.terms)
    bounds = np.searchsorted(window, np.arange(first[-1] + 1))
    for w in index.screened(window, term, int(first[-1])).tolist():
        d = int(np.searchsorted(first, w, "right") - 1)
        start = (w - int(first[d])) * index.stride
        passage = words[at[d] + start : min(at[d] + start + 2 * index.stride, at[d + 1])]
        for number, score in index.search(term[bounds[w] : bounds[w + 1]]):
            shares = index.verify(number, passage)
            if min(shares) >= least - 1e-9:
                yield d, number, start, score / float(index.own[number]), shares


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, in its own columns, less the documents that hold a passage of the benchmark.

    Rows with missing or repeated ids are told apart by their texts."""
    rows, key = unique_ids(docs, id_col, text_col)
    found = find_leaks(rows, benchmark, key, text_col, **options)
    return without(rows, found.select("doc_id").distinct(), [(named(key), "doc_id")]).select(*own_columns(docs))
