"""A document store of plain Parquet: chunks, inverted index, its statistics, catalog and tombstones, with committed sequence numbers.

The statistics are changes: a write adds the numbers of its terms and words, a delete takes away those of what it hides.

A write claims a sequence number, puts its rows under it and then the number under commits/; readers take
committed numbers only, so a write that fails leaves nothing to see, and two writers never share a folder.  A
tombstone hides a document's rows with smaller numbers, its postings too.  Two writers that add the same document
at the same time both add it, and two that delete it both take it from the statistics; ingest and deletes are meant for one at a
time.  A claim is a file that is created only where there is none, which the file system must decide: object stores that can't need a
writer at a time altogether."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow import schemas
from folioflow.functions import text as X
from folioflow.operators import bm25, postings, vector
from folioflow.operators.vector_index import VectorIndex
from folioflow.plans.stored_index import StoredIndex

TABLES = {"chunks": schemas.CHUNKS_STORED, "postings": postings.BLOCKS, "terms": "term string, df long", "totals": "n long, dl long", "documents": schemas.DOCUMENTS, "tombstones": "doc_id string"}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        """What a folder holds, by one listing."""
        path, files = self._path(folder)
        return [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []

    def _committed(self) -> list[int]:
        return sorted(int(n) for n in self._names("commits") if n.isdigit())

    def _claim(self) -> int:
        """A number that no other writer has: its file is created only where there is none."""
        number = max((int(n) for n in [*self._names("claims"), *self._names("commits")] if n.isdigit()), default=0) + 1
        while True:
            path, files = self._path(f"claims/{number}")
            try:
                files.create(path, False).close()
                return number
            except Py4JJavaError as error:
                if not files.exists(path):
                    raise error
                number += 1

    def _commit(self, tables: dict[str, Callable[[dict[str, DataFrame]], DataFrame]]) -> int:
        """tables: what to write, one after the other; each may read those written before it."""
        number, written = self._claim(), {}
        for name, rows in tables.items():
            path = f"{self.root}/{name}/seq={number}"
            rows(written).write.parquet(path)
            written[name] = self.spark.read.schema(TABLES[name]).parquet(path)
        path, files = self._path(f"commits/{number}")
        files.create(path, False).close()
        return number

    def table(self, name: str) -> DataFrame:
        """All committed rows with their `seq`, hidden ones too."""
        have = {*self._names(name)}
        paths = [f"{self.root}/{name}/seq={n}" for n in self._committed() if f"seq={n}" in have]
        if not paths:
            return self.spark.createDataFrame([], TABLES[name] + ", seq int")
        return self.spark.read.option("basePath", f"{self.root}/{name}").schema(TABLES[name] + ", seq int").parquet(*paths)

    def _live(self, name: str, after: int = 0) -> DataFrame:
        rows = self.table(name).where(F.col("seq") > after)
        dead = self.table("tombstones").groupBy(F.col("doc_id").alias("__doc")).agg(F.max("seq").alias("__seq"))
        return rows.join(dead, (F.col("doc_id") == F.col("__doc")) & (F.col("seq") < F.col("__seq")), "left_anti")

    def chunks(self, after: int = 0) -> DataFrame:
        """The live chunks, of writes after a sequence number."""
        return self._live("chunks", after).drop("seq")

    def numbered(self) -> DataFrame:
        """(seq, number, chunk_id) of the live chunks."""
        return self._live("chunks").select("seq", "number", "chunk_id")

    def dead_numbers(self) -> DataFrame | None:
        """(seq, shard, number) of hidden chunks; None where nothing was ever deleted."""
        if not self.last("tombstones"):
            return None
        gone = self.table("tombstones").groupBy(F.col("doc_id").alias("__doc")).agg(F.max("seq").alias("__seq"))
        rows = self.table("chunks").join(gone, (F.col("doc_id") == F.col("__doc")) & (F.col("seq") < F.col("__seq")))
        return rows.select("seq", F.shiftright("number", postings.SHARD_BITS).alias("shard"), "number")

    def last(self, name: str | None = None) -> int:
        """The newest committed number, of those that wrote a table; 0 without any."""
        have = None if name is None else {*self._names(name)}
        return max((n for n in self._committed() if have is None or f"seq={n}" in have), default=0)

    def index_vectors(self) -> None:
        """A vector index of the live chunks as they are now; later writes and deletes are seen to by `near`."""
        number = self.last()
        if number and str(number) not in self._names("vectors"):
            VectorIndex.build(self.chunks(), f"{self.root}/vectors/{number}")

    def near(self) -> vector.Search:
        """The search of the newest vector index, with what was written since compared exactly and what was deleted left out;
        the exact search where there is no index."""
        built = [int(n) for n in self._names("vectors") if n.isdigit() and "model" in self._names(f"vectors/{n}")]
        return IndexedSearch(self, max(built)) if built else vector.ExactSearch()

    def documents(self) -> DataFrame:
        return self._live("documents").drop("seq")

    def listing(self) -> DataFrame:
        return self.documents().orderBy("added_at", "doc_name")

    def has_document(self, doc_id: str) -> bool:
        return not self.documents().where(F.col("doc_id") == doc_id).isEmpty()

    def add(self, chunks: DataFrame) -> int:
        """Chunks of documents that aren't in the store; the others are left out.  Returns the sequence number, 0 without rows.

        The catalog's name is that of the first chunk."""
        fresh = chunks.join(self.documents().select("doc_id"), "doc_id", "left_anti").persist()
        try:
            if fresh.isEmpty():
                return 0
            entries = catalog(fresh).select("doc_id", "doc_name", "n_chunks", F.current_timestamp().alias("added_at"))
            return self._write(fresh, entries)
        finally:
            fresh.unpersist()

    def _write(self, chunks: DataFrame, entries: DataFrame) -> int:
        """Chunks with their numbers, and from the written ones, in their order, the blocks of the inverted index; no posting is shuffled."""
        columns = [c.split()[0] for c in schemas.CHUNKS_STORED.split(", ")]
        dealt = chunks.repartition("doc_id").sortWithinPartitions("doc_id", "chunk_index")
        numbered = dealt.withColumn("number", F.monotonically_increasing_id()).withColumn("dl", F.size(X.index_tokens(F.col("text"))))
        tokens = lambda w: w["chunks"].select("number", X.index_tokens(F.col("text")).alias("tokens"))
        return self._commit({
            "chunks": lambda w: numbered.select(*columns),
            "postings": lambda w: postings.blocks(tokens(w), StoredIndex.stems).sortWithinPartitions("term", "shard"),
            "terms": lambda w: w["postings"].groupBy("term").agg(F.sum("n").alias("df")).repartition("term").sortWithinPartitions("term"),
            "totals": lambda w: w["chunks"].agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("dl")),
            "documents": lambda w: entries,
        })

    def index(self) -> StoredIndex:
        """The inverted index of the live chunks."""
        return StoredIndex(self)

    def delete(self, doc_ids: list[str] | DataFrame) -> bool:
        """Whether a chunk was removed.  Deleting nothing writes nothing.  A frame has a column doc_id."""
        gone = doc_ids if isinstance(doc_ids, DataFrame) else self.spark.createDataFrame([(d,) for d in doc_ids], "doc_id string")
        gone = gone.select("doc_id").distinct()
        lost = self.chunks().join(gone, "doc_id", "left_semi").select("doc_id", "chunk_id", "text", "dl").persist()
        try:
            if lost.isEmpty():
                return False
            counts = bm25.TextIndex(lost, StoredIndex.stems).term_counts()
            self._commit({
                "tombstones": lambda w: lost.select("doc_id").distinct(), "terms": lambda w: counts.select("term", (-F.col("df")).alias("df")).repartition("term").sortWithinPartitions("term"),
                "totals": lambda w: lost.agg((-F.count("*")).alias("n"), (-F.sum("dl")).cast("long").alias("dl")),
            })
            return True
        finally:
            lost.unpersist()

    def compact(self, to: Store) -> None:
        """The live rows as one write of another, empty store."""
        to._write(self.chunks(), self.documents())

    def document_text(self, doc_id: str) -> str:
        found = document_texts(self.chunks().where(F.col("doc_id") == doc_id)).first()
        return found["text"] if found else ""


class IndexedSearch:
    def __init__(self, store: Store, number: int):
        self.store, self.number = store, number
        self.index = VectorIndex(store.spark, f"{store.root}/vectors/{number}")

    def top(self, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        store = self.store
        alive = store.chunks().select("chunk_id") if store.last("tombstones") > self.number else None
        found = self.index.top(None, queries, k, alive=alive)
        if store.last("chunks") > self.number:
            fresh = vector.top(store.chunks(self.number), queries, k)
            found = vector.ranked(found.drop("rank").unionByName(fresh.drop("rank")), k, "chunk_id")
        return found


def catalog(chunks: DataFrame) -> DataFrame:
    """(doc_id, doc_name, n_chunks)."""
    return chunks.groupBy("doc_id").agg(F.min_by("doc_name", "chunk_index").alias("doc_name"), F.count("*").cast("int").alias("n_chunks"))


def document_texts(chunks: DataFrame) -> DataFrame:
    """(doc_id, text): the chunks' texts in their order, a blank line between them."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda c: c["text"]), "\n\n").alias("text"))
