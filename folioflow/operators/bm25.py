"""BM25 over chunks, and what a stored index shares with it.

A chunk is one row, so its postings are made in that row: NumPy sorts the tokens of an Arrow batch by (row, term), and the
runs are the postings.  Nothing is shuffled to gather occurrences.  A search hands its phrases to the one scan of the texts,
which returns the rows that match (phrase, chunk, length, count) and the sums of all lengths; they are written once,
and all that follows reads them: its size is that of the matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.functions.batches import parts, split_tokens
from folioflow.functions.porter import stem, stemmed
from folioflow.operators.quantizer import best_columns
from folioflow.scratch import checkpoint

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
#: Phrases that a search may hand to the tasks; more are joined.
BROADCAST_PHRASES = 200_000
#: Scores that a task holds at a time; what it adds them up from takes several times as much.
SCORED = 1 << 18


@dataclass
class Found:
    """What phrases match: (phrase, chunk_id, dl, f), with the number of chunks of the index and their mean length."""

    rows: DataFrame
    n: int
    avgdl: float


class Index(Protocol):
    stems: bool

    def found(self, wanted: DataFrame) -> Found: ...


def terms_of(tokens: pa.Array, stems: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, place in the row, number of the term) of each token, and the terms; each distinct one is stemmed once."""
    tokens = tokens.combine_chunks() if isinstance(tokens, pa.ChunkedArray) else tokens
    flat = pc.list_flatten(tokens)
    row = pc.list_parent_indices(tokens).to_numpy()
    first = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy())))
    coded = flat.dictionary_encode()
    code, terms = coded.indices.to_numpy(), coded.dictionary
    if stems:
        again = pa.array([stem(t) for t in terms.to_pylist()], pa.string()).dictionary_encode()
        code, terms = again.indices.to_numpy()[code], again.dictionary
    return row, np.arange(len(row)) - first[row], code, terms


def runs(row: np.ndarray, code: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of the tokens by row and term, where each posting begins in it, its row, its term)."""
    key = row.astype(np.int64) * max(n_terms, 1) + code
    order = np.argsort(key, kind="stable")
    key = key[order]
    begins = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    return order, begins, key[begins] // max(n_terms, 1), key[begins] % max(n_terms, 1)


class Trie:
    """Phrases, as sequences of terms, found in the tokens of many rows at once."""

    def __init__(self, phrases: list[str]):
        self.phrases = pa.array(phrases, pa.string())
        split = [p.split(" ") for p in phrases]
        self.terms = pa.array(sorted({t for s in split for t in s}), pa.string())
        number = {t: i for i, t in enumerate(self.terms.to_pylist())}
        edges: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for i, terms in enumerate(split):
            node = 0
            for t in terms:
                node = edges.setdefault((node, number[t]), len(edges) + 1)
            ends[node] = i
        self.depth = max(map(len, split), default=0)
        keys = np.array([n * len(self.terms) + t for n, t in edges], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.children = keys[order], np.array(list(edges.values()), dtype=np.int64)[order]
        self.ends = np.full(len(edges) + 1, -1, dtype=np.int64)
        self.ends[list(ends)] = list(ends.values())

    def find(self, row: np.ndarray, code: np.ndarray, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, phrase, how often it stands there), sorted."""
        known = pc.fill_null(pc.index_in(terms, value_set=self.terms), -1).to_numpy().astype(np.int64)[code] if len(terms) else np.zeros(0, np.int64)
        at = np.flatnonzero(known >= 0)
        node, rows, found = np.zeros(len(at), np.int64), [], []
        for step in range(self.depth):
            inside = at + step < len(row)
            at, node = at[inside], node[inside]
            same = (row[at + step] == row[at]) & (known[at + step] >= 0)
            at, node = at[same], node[same]
            key = node * len(self.terms) + known[at + step]
            near = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[near] == key
            at, node = at[hit], self.children[near[hit]]
            ends = self.ends[node]
            rows.append(row[at[ends >= 0]].astype(np.int64))
            found.append(ends[ends >= 0])
        both = np.concatenate(rows or [np.zeros(0, np.int64)]) * max(len(self.phrases), 1) + np.concatenate(found or [np.zeros(0, np.int64)])
        both, n = np.unique(both, return_counts=True)
        return both // max(len(self.phrases), 1), both % max(len(self.phrases), 1), n


@dataclass
class TextIndex:
    """An index that is made of the chunks' texts as it is asked."""

    chunks: DataFrame  # chunk_id, text
    stems: bool
    kept: DataFrame | None = None  # postings kept for many searches

    def persist(self) -> TextIndex:
        self.kept = self.postings().persist()
        return self

    def _tokens(self) -> DataFrame:
        return self.chunks.select("chunk_id", X.index_tokens(F.col("text")).alias("tokens"))

    def _joined(self) -> DataFrame:
        return self.chunks.select("chunk_id", X.joined_tokens(F.col("text")).alias("tokens"))

    @property
    def _id_type(self) -> str:
        return self.chunks.schema["chunk_id"].dataType.simpleString()

    @property
    def lengths(self) -> DataFrame:
        return self._tokens().select("chunk_id", F.size("tokens").alias("dl"))

    @property
    def stats(self) -> DataFrame:
        return self.lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))

    def postings(self) -> DataFrame:
        """(term, chunk_id, dl, positions), made row by row."""
        if self.kept is not None:
            return self.kept
        stems = self.stems

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts(batches, 1):
                row, place, code, terms = terms_of(split_tokens(batch.column(1)), stems)
                order, begins, of, term = runs(row, code, len(terms))
                dl = np.bincount(row, minlength=batch.num_rows)[of] if len(of) else np.zeros(0, np.int64)
                positions = pa.ListArray.from_arrays(pa.array(np.append(begins, len(order)).astype(np.int32)), pa.array(place[order].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([terms.take(pa.array(term)), batch.column(0).take(pa.array(of)), pa.array(dl.astype(np.int32)), positions], ["term", "chunk_id", "dl", "positions"])

        return self._joined().mapInArrow(run, f"term string, chunk_id {self._id_type}, dl int, positions array<int>")

    def term_counts(self) -> DataFrame:
        """(term, df, cf): chunks and places that have the term.  Each batch adds up its own before Spark does."""
        stems = self.stems

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts(batches, 0):
                row, _, code, terms = terms_of(split_tokens(batch.column(0)), stems)
                _, _, _, term = runs(row, code, len(terms))
                yield pa.RecordBatch.from_arrays([terms, pa.array(np.bincount(term.astype(np.int64), minlength=len(terms))), pa.array(np.bincount(code, minlength=len(terms)))], ["term", "df", "cf"])

        return self._joined().select("tokens").mapInArrow(run, "term string, df long, cf long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))

    def found(self, wanted: DataFrame) -> Found:
        few = few_phrases(wanted)
        if few is None or self.kept is not None:
            n, avgdl = self.stats.first()
            return Found(by_positions(self.postings(), wanted), n, avgdl or 0.0)
        hits = self._hits(few)
        rows = hits.rows.select("chunk_id", "dl", F.explode(F.arrays_zip("phrase", "f")).alias("hit")).select(F.get(F.lit(few), F.col("hit.phrase")).alias("phrase"), "chunk_id", "dl", "hit.f")
        return Found(rows, hits.n, hits.avgdl)

    def _hits(self, few: list[str]) -> Found:
        """The chunks that have a phrase, a row each: (chunk_id, dl, phrase: numbers in `few`, f), written once by the one scan of the texts."""
        trie, stems = Trie(few), self.stems

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = total = 0
            names = ["chunk_id", "dl", "phrase", "f", "n"]
            listed = lambda at, values: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.astype(np.int32)))
            for batch in parts(batches, 1):
                row, _, code, terms = terms_of(split_tokens(batch.column(1)), stems)
                dl = np.bincount(row, minlength=batch.num_rows)
                n, total = n + batch.num_rows, total + len(row)
                of, phrase, f = trie.find(row, code, terms)
                begins = np.flatnonzero(np.concatenate((np.ones(min(1, len(of)), bool), of[1:] != of[:-1])))
                at, have = np.append(begins, len(of)), of[begins]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(have)), pa.array(dl[have]), listed(at, phrase), listed(at, f), pa.nulls(len(have), pa.int64())], names)
            if n:  # the sums over the task's chunks, as a row that is none
                none = listed(np.zeros(2), np.zeros(0))
                yield pa.RecordBatch.from_arrays([pa.nulls(1, batch.column(0).type), pa.array([total]), none, none, pa.array([n])], names)

        rows = checkpoint(self._joined().mapInArrow(run, f"chunk_id {self._id_type}, dl long, phrase array<int>, f array<int>, n long"))
        n, total = rows.where("n is not null").agg(F.sum("n"), F.sum("dl")).first()
        return Found(rows.where("n is null").drop("n"), n or 0, total / n if n else 0.0)

    def top(self, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
        """(query_id, chunk_id, score, rank).  A batch of matching chunks is scored against all queries at once and gives its own best k."""
        wanted = phrases(queries, self.stems)
        few = few_phrases(wanted) if self.kept is None else None
        asked = None if few is None else wanted.groupBy("query_id", "phrase").agg(F.count("*").alias("times")).limit(BROADCAST_PHRASES + 1).toArrow()
        if asked is None or asked.num_rows > BROADCAST_PHRASES:
            return ranked(scores(self, queries, allowed), k)
        hits = self._hits(few)
        df = np.zeros(len(few), np.int64)
        for r in hits.rows.select("phrase").mapInArrow(lambda batches: _counted(batches, len(few)), "phrase int, df long").groupBy("phrase").agg(F.sum("df").alias("df")).collect():
            df[r["phrase"]] = r["df"]
        scorer = Scorer(asked, few, hits.n, df, hits.avgdl)
        rows = hits.rows if allowed is None else hits.rows.join(allowed, "chunk_id", "left_semi")
        query_type = queries.schema["query_id"].dataType.simpleString()
        best = rows.select("chunk_id", "dl", "phrase", "f").mapInArrow(lambda batches: scorer.best(batches, k), f"query_id {query_type}, chunk_id {self._id_type}, score double")
        return ranked(best, k)


def _counted(batches: Iterator[pa.RecordBatch], n_phrases: int) -> Iterator[pa.RecordBatch]:
    df = np.zeros(n_phrases, np.int64)
    for batch in batches:
        df += np.bincount(pc.list_flatten(batch.column(0)).to_numpy(), minlength=n_phrases)
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], ["phrase", "df"])


class Scorer:
    """Scores of many chunks for many queries: what a phrase gains in a chunk goes to every query that has it."""

    def __init__(self, asked: pa.Table, few: list[str], n: int, df: np.ndarray, avgdl: float):
        phrase = pc.index_in(asked.column("phrase").combine_chunks(), value_set=pa.array(few, pa.string())).to_numpy()
        names = asked.column("query_id").combine_chunks().dictionary_encode()
        self.names, self.avgdl = names.dictionary, avgdl or 1.0
        with np.errstate(divide="ignore"):
            idf = np.log((n - df + 0.5) / (df + 0.5))
        weight = np.where(idf > 0, idf, LEAST_IDF)[phrase] * asked.column("times").to_numpy()
        order = np.argsort(phrase, kind="stable")
        self.query, self.weight = names.indices.to_numpy()[order].astype(np.int64), weight[order]
        self.begins = np.searchsorted(phrase[order], np.arange(len(few) + 1))

    def best(self, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
        n_queries = len(self.names)
        width = max(1, SCORED // max(n_queries, 1))
        for whole in parts(batches, 2):
            ordered = whole.take(pc.array_sort_indices(whole.column(0)))
            for lo in range(0, whole.num_rows if n_queries else 0, width):
                part = ordered.slice(lo, width)
                row = pc.list_parent_indices(part.column(2)).to_numpy()
                phrase, f = (pc.list_flatten(part.column(c)).to_numpy() for c in (2, 3))
                gains = f * (K1 + 1) / (f + K1 * (1 - B + B * part.column(1).to_numpy()[row] / self.avgdl))
                times = np.diff(self.begins)[phrase]
                at = np.repeat(self.begins[phrase] - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
                pair = np.repeat(row, times) * n_queries + self.query[at]
                total = np.bincount(pair, np.repeat(gains, times) * self.weight[at], minlength=part.num_rows * n_queries)
                total[np.bincount(pair, minlength=len(total)) == 0] = -np.inf
                score = np.round(total.reshape(-1, n_queries).T, 9)
                query, chunk = best_columns(score, k)
                yield pa.RecordBatch.from_arrays([self.names.take(pa.array(query)), part.column(0).take(pa.array(chunk)), pa.array(score[query, chunk])], ["query_id", "chunk_id", "score"])


def few_phrases(wanted: DataFrame) -> list[str] | None:
    """The distinct phrases, if they are within BROADCAST_PHRASES."""
    found = wanted.select("phrase").distinct().limit(BROADCAST_PHRASES + 1).toArrow().column(0).to_pylist()
    return sorted(found) if len(found) <= BROADCAST_PHRASES else None


def by_positions(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """(phrase, chunk_id, dl, f) by joins with the phrases' terms; the positions of a phrase's terms are intersected."""
    terms = F.posexplode(F.split("phrase", " ")).alias("place", "term")
    asked = wanted.select("phrase").distinct().select("phrase", F.size(F.split("phrase", " ")).alias("size"), terms)
    starts = F.transform("positions", lambda p: p - F.col("place"))
    rows = postings.join(asked, "term").select("phrase", "size", "chunk_id", "dl", starts.alias("starts"))
    single = rows.where("size = 1").select("phrase", "chunk_id", F.col("dl").cast("long").alias("dl"), F.size("starts").cast("long").alias("f"))
    lists = rows.where("size > 1").groupBy("phrase", "size", "chunk_id").agg(F.max("dl").cast("long").alias("dl"), F.collect_list("starts").alias("all")).where(F.size("all") == F.col("size"))
    common = F.aggregate(F.slice("all", 2, 1 << 30), F.col("all")[0], lambda a, b: F.array_intersect(a, b))
    longer = lists.select("phrase", "chunk_id", "dl", F.size(common).cast("long").alias("f")).where("f > 0")
    return single.unionByName(longer)


def build_index(chunks: DataFrame, stem: bool = True, id_col: str = "chunk_id", text_col: str = "text") -> TextIndex:
    return TextIndex(chunks.select(F.col(id_col).alias("chunk_id"), F.col(text_col).alias("text")), stem)


def phrases(queries: DataFrame, stem: bool) -> DataFrame:
    """(query_id, phrase): a query token is the phrase of terms, with a space between them, that the index makes of it.  Tokens that share one are rows of their own."""
    key = lambda token: F.array_join(X.index_tokens(token), " ")
    out = queries.select("query_id", F.explode(F.transform(X.query_tokens(F.col("query")), key)).alias("phrase")).where("phrase <> ''")
    return out.withColumn("phrase", stemmed("phrase")) if stem else out


def matches(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, phrase, chunk_id, f): how often each phrase stands in each chunk that has it."""
    wanted = phrases(queries, index.stems)
    return index.found(wanted).rows.join(wanted.distinct(), "phrase").select("query_id", "phrase", "chunk_id", "f")


def idf(n: int, df: Column) -> Column:
    found = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(found > 0, found).otherwise(LEAST_IDF)


def gain(f: Column, dl: Column, avgdl: float) -> Column:
    return f * (K1 + 1) / (f + K1 * (1 - B + B * dl / F.lit(avgdl or 1.0)))


def scores(index: Index, queries: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score) of every chunk that has a phrase of the query.

    allowed: chunk_ids the answer is confined to; the statistics stay those of the whole index."""
    wanted = phrases(queries, index.stems)
    found = index.found(wanted)
    known = found.rows.groupBy("phrase").agg(F.count("*").alias("df"))
    times = wanted.groupBy("query_id", "phrase").agg(F.count("*").alias("times"))
    weights = times.join(known, "phrase").select("query_id", "phrase", (F.col("times") * idf(found.n, F.col("df"))).alias("weight"))
    rows = found.rows if allowed is None else found.rows.join(allowed, "chunk_id", "left_semi")
    rows = rows.select("phrase", "chunk_id", gain(F.col("f"), F.col("dl"), found.avgdl).alias("gain")).join(weights, "phrase")
    return rows.groupBy("query_id", "chunk_id").agg(F.sum(F.col("weight") * F.col("gain")).alias("score"))


def ranked(scored: DataFrame, k: int, tie: str = "chunk_id") -> DataFrame:
    """The best k of each query with `rank` from 1; scores are rounded to 9 digits so that ties are ties on every run."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(tie))
    return scored.withColumn("score", F.round("score", 9)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top(index: Index, queries: DataFrame, k: int = 20, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank).  An index that finds the best by itself is asked for them."""
    if hasattr(index, "top"):
        return index.top(queries, k, allowed)
    return ranked(scores(index, queries, allowed), k)
