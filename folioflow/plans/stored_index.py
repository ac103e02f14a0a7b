"""BM25 over the blocks of a store: statistics by sums of changes, the best chunks shard by shard."""

from __future__ import annotations

from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators import bm25, postings
from folioflow.operators.vector import ranked

if TYPE_CHECKING:
    from folioflow.plans.store import Store

#: Terms that a plan names, so that files and row groups without them aren't read; more are joined.
NAMED_TERMS = 1000


class StoredIndex:
    """The inverted index of the live chunks, as it was written with them.

    A delete hides postings; what it takes from the statistics was written with it, so that a search adds up a few small
    rows and never reads all lengths."""

    stems = True

    def __init__(self, store: Store):
        self.store = store

    @property
    def lengths(self) -> DataFrame:
        return self.store.chunks().select("chunk_id", "dl")

    @property
    def stats(self) -> DataFrame:
        """(n, avgdl) of the live chunks."""
        sums = self.store.table("totals").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("dl").alias("dl"))
        return sums.select("n", F.when(F.col("n") > 0, F.col("dl") / F.col("n")).alias("avgdl"))

    def frequencies(self) -> DataFrame:
        """(term, df) of the live chunks."""
        return self.store.table("terms").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def _with_terms(self, rows: DataFrame, terms: list[str]) -> DataFrame:
        if len(terms) <= NAMED_TERMS:
            return rows.where(F.col("term").isin(terms))
        return rows.join(rows.sparkSession.createDataFrame([(t,) for t in terms], "term string"), "term", "left_semi")

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """(term, chunk_id, dl, positions) of the live chunks."""
        rows = self.store.table("postings")
        rows = rows if terms is None else self._with_terms(rows, terms)
        out = rows.mapInArrow(postings.opened, "term string, seq int, number long, dl int, positions array<int>")
        return out.join(self.store.numbered(), ["seq", "number"]).select("term", "chunk_id", "dl", "positions")

    def found(self, wanted: DataFrame) -> bm25.Found:
        few = bm25.few_phrases(wanted)
        terms = None if few is None else sorted({t for p in few for t in p.split(" ")})
        n, avgdl = self.stats.first()
        return bm25.Found(bm25.by_positions(self.postings(terms), wanted), n, avgdl or 0.0)

    def top(self, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
        """(query_id, chunk_id, score, rank).  Under a filter, or with more phrases than go to the tasks, every match is scored."""
        wanted = bm25.phrases(queries, self.stems)
        few = bm25.few_phrases(wanted) if allowed is None else None
        rows = None if few is None else wanted.groupBy("query_id", "phrase").agg(F.count("*").alias("times")).limit(bm25.BROADCAST_PHRASES + 1).toArrow()
        if rows is None or rows.num_rows > bm25.BROADCAST_PHRASES:
            return bm25.ranked(bm25.scores(self, queries, allowed), k)
        store, (n, avgdl) = self.store, self.stats.first()
        blocks = self._with_terms(store.table("postings"), sorted({t for p in few for t in p.split(" ")}))
        dead = store.dead_numbers()
        df = self._frequencies_of(few, blocks, dead)
        weight = {p: idf if (idf := float(np.log((n - f + 0.5) / (f + 0.5)))) > 0 else bm25.LEAST_IDF for p, f in df.items()}
        asked: dict = {}
        for q, phrase, times in zip(*(rows.column(c).to_pylist() for c in ("query_id", "phrase", "times")), strict=True):
            if phrase in weight:
                asked.setdefault(q, []).append((phrase, weight[phrase] * times))
        reached = {} if dead is not None else self._reached(blocks, k, avgdl)
        least = {q: max(w * reached.get(p, 0.0) for p, w in own) for q, own in asked.items()}
        query_type, name_type = queries.schema["query_id"].dataType.simpleString(), rows.schema.field("query_id").type

        def search(table: pa.Table, gone: pa.Table | None = None) -> pa.Table:
            lists = postings.Lists(table, np.zeros(0, np.int64) if gone is None else gone.column("number").to_numpy() & (postings.SHARD - 1))
            names, ids, scores = [], [], []
            for q, own in asked.items() if table.num_rows else ():
                some, score = lists.best(own, k, avgdl, least[q])
                names += [q] * len(some)
                ids.append(some)
                scores.append(score)
            number = np.concatenate(ids) if ids else np.zeros(0, np.int64)
            seq, shard = (table.column(c)[0].as_py() if table.num_rows else 0 for c in ("seq", "shard"))
            return pa.table({"query_id": pa.array(names, name_type), "seq": pa.array(np.full(len(number), seq, np.int32)), "number": pa.array((shard << postings.SHARD_BITS) + number), "score": pa.array(np.concatenate(scores) if scores else np.zeros(0))})

        found = _by_shard(blocks, dead, search, f"query_id {query_type}, seq int, number long, score double")
        found = found.join(store.numbered(), ["seq", "number"]).select("query_id", "chunk_id", F.round("score", 9).alias("score"))
        return ranked(found, k, "chunk_id")

    def _frequencies_of(self, few: list[str], blocks: DataFrame, dead: DataFrame | None) -> dict[str, int]:
        """df of each phrase that occurs: of a term by the sums of changes, of longer ones by a count."""
        single, longer = [p for p in few if " " not in p], [p for p in few if " " in p]
        out = {r["term"]: r["df"] for r in self._with_terms(self.store.table("terms"), single).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0").collect()}
        if longer:

            def count(table: pa.Table, gone: pa.Table | None = None) -> pa.Table:
                lists = postings.Lists(table, np.zeros(0, np.int64) if gone is None else gone.column("number").to_numpy() & (postings.SHARD - 1))
                df = [len(lists.phrase(p)[0]) if table.num_rows else 0 for p in longer]
                return pa.table({"phrase": pa.array(longer), "df": pa.array(df, pa.int64())})

            sums = _by_shard(blocks, dead, count, "phrase string, df long").groupBy("phrase").agg(F.sum("df").alias("df"))
            out |= {r["phrase"]: r["df"] for r in sums.where("df > 0").collect()}
        return out

    def _reached(self, blocks: DataFrame, k: int, avgdl: float) -> dict[str, float]:
        """Of each term with k blocks or more the gain that k chunks reach: the k-th best of its blocks' best chunks.  No block is decoded."""
        best = blocks.select("term", F.col("shard"), bm25.gain(F.col("top_tf"), F.col("top_dl"), avgdl).alias("score")).withColumnRenamed("term", "query_id")
        rows = ranked(best, k, "shard").groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k)
        return {r["query_id"]: r["least"] for r in rows.collect()}


def _by_shard(blocks: DataFrame, dead: DataFrame | None, work, schema: str) -> DataFrame:
    if dead is None:
        return blocks.groupBy("seq", "shard").applyInArrow(lambda table: work(table), schema)
    return blocks.groupBy("seq", "shard").cogroup(dead.groupBy("seq", "shard")).applyInArrow(lambda table, gone: work(table, gone), schema)
