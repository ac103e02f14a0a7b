"""A partitioned approximate vector index of plain Parquet.

Vectors lie in the folder of their nearest cell (`lists/cell=..`), beside codes for what the cell's centre misses.  A
search reads the codes of the cells near to its queries, keeps the best by the codes' inner products, reads the vectors of
these few and ranks them by their exact cosine.  How many cells are near enough is measured when the index is built, on
the fitting sample, for the recall asked for.

A cell that holds many vectors (near copies may be a third of all) is dealt to blocks.  Cells and blocks are put together to
bundles of a bounded size; a block of queries meets a bundle in one task, which gives each query's best of the whole
bundle, however many cells the query probes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.batches import lean_group, parts
from folioflow.operators import quantizer as Q
from folioflow.operators import vector

#: Vectors in a cell, about, where there are cells enough; and the most cells.
CELL_ROWS, MOST_CELLS = 512, 4096
#: Rows of lists, and queries, at most, that one task compares; and the fewest queries worth a task of their own.
LIST_BLOCK, QUERY_BLOCK, LEAST_QUERIES = 32_768, 2048, 256
#: Blocks of queries, where QUERY_BLOCK allows so few.
QUERY_BLOCKS = 16
#: Entries of queries' vectors whose cells a task looks for at a time.
PROBED_ENTRIES = 1 << 15
#: Candidates, about, that one task ranks.
RANKED = 1 << 19
#: Candidates kept for each result before the exact ranking, and at least.
CANDIDATES, LEAST_CANDIDATES = 10, 100
#: Queries and rows of the sample that the number of probes is measured on.
TRIAL_QUERIES, TRIAL_ROWS = 256, 20_000


def cells_for(n: int) -> int:
    return min(MOST_CELLS, max(1, n // CELL_ROWS))


def probes_needed(model: Q.Quantizer, rows: np.ndarray, recall: float, k: int) -> int:
    """Cells to probe so that a share `recall` of the k nearest rows of each trial query lies in them."""
    asked = rows[:TRIAL_QUERIES]
    home = model.near(rows, 1)[:, 0]
    place = np.argsort(model.near(asked, len(model.cells)), axis=1)  # of each cell among those of a query
    scores = asked @ rows.T
    k = min(k, len(rows))
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    needed = np.sort(np.take_along_axis(place, home[best], 1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)))]) + 1


def bundled(sizes: list[int], n_blocks: list[int]) -> tuple[list[int], int]:
    """(the bundle of each cell's first block, how many there are): cells in a row with up to LIST_BLOCK rows share one; each block of a larger cell has its own."""
    first, bundle, rows = [], -1, LIST_BLOCK
    for size, count in zip(sizes, n_blocks, strict=True):
        if count > 1 or bundle < 0 or rows + size > LIST_BLOCK:
            bundle, rows = bundle + 1, 0
        first.append(bundle)
        bundle, rows = bundle + count - 1, LIST_BLOCK if count > 1 else rows + size
    return first, bundle + 1


def _homes(batches: Iterator[pa.RecordBatch], model: Q.Quantizer) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(model.near(Q.matrix(batch.column(0), model.dims)[0], 1)[:, 0])], ["cell"])


class VectorIndex:
    """An index under a path.  `top` has the form of vector.Search; its first argument isn't looked at, as the index holds the vectors."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        found = spark.read.parquet(f"{self.path}/model").first()
        of = lambda name, shape: np.frombuffer(found[name]).reshape(found[shape])
        self.model = Q.Quantizer(of("cells", "cells_shape"), of("books", "books_shape"))
        self.probes, self.n_blocks, self.fields = found["probes"], found["n_blocks"], found["fields"]
        # An index that was written without sizes has a bundle for each block.
        self.sizes = found["sizes"] if "sizes" in found else [n * LIST_BLOCK for n in self.n_blocks]

    @staticmethod
    def build(vectors: DataFrame, path: str, id_col: str = "chunk_id", vector_col: str = "embedding", n_cells: int | None = None, recall: float = 0.97, k: int = 20) -> VectorIndex:
        """vectors: of unit length, as the exact search takes them.  All but null ones, those of another length than the most
        frequent (of equally frequent ones the largest) and those with a null or an entry that isn't finite are indexed.

        recall, k: what the number of probes is measured for.  The folder must not exist."""
        spark, path = vectors.sparkSession, path.rstrip("/")
        rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where(F.col(vector_col).isNotNull())
        finite = F.forall("vector", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
        dims = rows.groupBy(F.size("vector").alias("dims")).agg(F.count_if(finite).alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
        dims, n = (dims["dims"], dims["n"]) if dims else (0, 0)
        good = rows.where((F.size("vector") == dims) & finite)
        plain = good.select("vector")
        model = Q.fit(plain, n, n_cells or cells_for(n)) if n and dims else None
        if model is None:
            model = Q.Quantizer(np.zeros((1, max(dims, 1))), np.zeros((1, 1, Q.WIDTH)))
        trial = Q.sample(plain, n, TRIAL_ROWS).limit(TRIAL_ROWS).toArrow().column(0).combine_chunks() if n else []
        probes = probes_needed(model, Q.matrix(trial, dims)[0], recall, k) if len(trial) else 1
        # One number a cell: how many blocks its rows are dealt to.
        sizes = {r["cell"]: r["n"] for r in good.select("vector").mapInArrow(lambda batches: _homes(batches, model), "cell int").groupBy("cell").agg(F.count("*").alias("n")).collect()}
        sizes = [sizes.get(c, 0) for c in range(len(model.cells))]
        n_blocks = [max(1, -(-n // LIST_BLOCK)) for n in sizes]

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, _ = Q.matrix(batch.column(1), dims)
                cell = model.near(x, 1)[:, 0]
                codes, _ = model.encode(x, cell)
                yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1)], ["cell", "id", "code", "vector"])

        fields = {f.name: f.dataType.simpleString() for f in good.schema.fields}
        kept = f"id {fields['id']}, code binary, vector {fields['vector']}"
        lists = good.mapInArrow(place, f"cell int, {kept}")
        placed = lists.withColumn("block", F.pmod(F.xxhash64("id"), F.get(F.lit(n_blocks), F.col("cell"))).cast("int"))
        placed.repartition("cell", "block").sortWithinPartitions("cell", "block", "id").write.partitionBy("cell").parquet(f"{path}/lists")
        shapes = [[int(x) for x in m.shape] for m in (model.cells, model.books)]
        about = [(model.cells.tobytes(), shapes[0], model.books.tobytes(), shapes[1], probes, n_blocks, sizes, f"{kept}, block int, cell int")]
        spark.createDataFrame(about, "cells binary, cells_shape array<int>, books binary, books_shape array<int>, probes int, n_blocks array<int>, sizes array<long>, fields string").coalesce(1).write.parquet(f"{path}/model")
        return VectorIndex(spark, path)

    def lists(self) -> DataFrame:
        return self.spark.read.schema(self.fields).parquet(f"{self.path}/lists")

    def top(self, vectors: DataFrame | None, queries: DataFrame, k: int = 20, id_col: str = "chunk_id", probes: int | None = None, alive: DataFrame | None = None, digits: int = 6) -> DataFrame:
        """(query_id, id, score, rank): about the k nearest by cosine, with exact scores; ties by id.

        queries: (query_id, embedding), any number; those of another length find nothing.  probes: cells to read for a query, else
        what was measured; all of them leave only the codes to choose by.  alive: ids (one column) that may be found."""
        model, probes = self.model, min(probes or self.probes, len(self.model.cells))
        candidates = max(LEAST_CANDIDATES, CANDIDATES * k)
        asked = queries.select("query_id", "embedding").where(F.size("embedding") == model.dims)
        query_type = queries.schema["query_id"].dataType.simpleString()
        id_type = self.lists().schema["id"].dataType.simpleString()
        n = asked.count()

        first, n_bundles = bundled(self.sizes, self.n_blocks)
        firsts, counts = np.array(first), np.array(self.n_blocks)

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts(batches, 1, PROBED_ENTRIES):
                x, good = Q.matrix(batch.column(1), model.dims)
                rows = np.flatnonzero(good)
                cells = model.near(x[rows], probes)
                row, cell = np.repeat(rows, cells.shape[1]), cells.ravel()
                # A cell of many blocks is probed in each of them.
                n = counts[cell]
                bundle = np.repeat(firsts[cell], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row, cell = np.repeat(row, n), np.repeat(cell, n)
                order = np.lexsort((cell, bundle, row))
                row, bundle, cell = row[order], bundle[order], cell[order]
                begins = np.flatnonzero(np.concatenate((np.ones(min(1, len(row)), bool), (row[1:] != row[:-1]) | (bundle[1:] != bundle[:-1]))))
                take, listed = pa.array(row[begins]), pa.ListArray.from_arrays(pa.array(np.append(begins, len(row)).astype(np.int32)), pa.array(cell.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(bundle[begins].astype(np.int32)), batch.column(0).take(take), batch.column(1).take(take), listed], ["bundle", "query_id", "embedding", "cells"])

        probed = asked.mapInArrow(probe, f"bundle int, query_id {query_type}, embedding {queries.schema['embedding'].dataType.simpleString()}, cells array<int>")
        lists = self.lists()
        if n <= QUERY_BLOCK and probes < len(model.cells):
            # Few queries leave cells alone: these folders aren't read.
            lists = lists.where(F.col("cell").isin([r["cell"] for r in probed.select(F.explode("cells").alias("cell")).distinct().collect()]))
        query_block, n_query_blocks = vector.in_blocks(n, min(QUERY_BLOCK, max(LEAST_QUERIES, n // QUERY_BLOCKS)), "query_id")
        bundle = (F.get(F.lit(first), F.col("cell")) + F.col("block")).cast("int")
        left = lists.select(bundle.alias("bundle"), "cell", "id", "code", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1))).alias("q"))
        right = probed.withColumn("q", query_block)
        # Few blocks a task: what they give is many times what they read, and the exchange after them holds it.
        left, right = (side.repartition(n_bundles * n_query_blocks, "bundle", "q") for side in (left, right))

        def scan(have: pa.Table, asked: pa.Table) -> pa.Table:
            have = have.take(pa.compute.sort_indices(have, [("cell", "ascending"), ("id", "ascending")]))
            ids, cell, names = (t.column(c).combine_chunks() for t, c in ((have, "id"), (have, "cell"), (asked, "query_id")))
            found = [pa.record_batch({"query_id": names.slice(0, 0), "id": ids.slice(0, 0), "score": pa.array([], pa.float64()), "cell": cell.slice(0, 0)})]
            if have.num_rows and asked.num_rows:
                place = np.argsort(pa.compute.sort_indices(ids).to_numpy())
                codes = np.frombuffer(b"".join(have.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
                cells, begins = np.unique(cell.to_numpy(), return_index=True)
                ends = np.append(begins[1:], len(ids))
                x, probed = Q.matrix(asked.column("embedding").combine_chunks(), model.dims)[0], asked.column("cells").combine_chunks()
                width = max(1, Q.SCORES // len(ids))
                for lo in range(0, len(x), width):
                    part, own = x[lo : lo + width], probed.slice(lo, width)
                    row, of = pa.compute.list_parent_indices(own).to_numpy(), pa.compute.list_flatten(own).to_numpy()
                    row, of = row[order := np.argsort(of, kind="stable")], of[order]
                    tables, scores = model.tables(part), np.full((len(part), len(ids)), -np.inf, np.float32)
                    for c, begin, end in zip(cells, begins, ends, strict=True):
                        rows = row[np.searchsorted(of, c) : np.searchsorted(of, c, "right")]
                        if len(rows):
                            scores[rows, begin:end] = model.scores(part[rows], c, codes[begin:end], tables[:, rows])
                    query, column = Q.best_columns(scores, candidates, place)
                    take = pa.array(column)
                    found.append(pa.record_batch({"query_id": names.take(pa.array(query + lo)), "id": ids.take(take), "score": pa.array(scores[query, column].astype(np.float64)), "cell": cell.take(take)}))
            return pa.Table.from_batches(found)

        near = left.groupBy("bundle", "q").cogroup(right.groupBy("bundle", "q")).applyInArrow(lean_group(scan), f"query_id {query_type}, id {id_type}, score double, cell int")
        if alive is not None:
            near = near.join(alive.select(F.col(alive.columns[0]).alias("id")), "id", "left_semi")
        # Dealt by their number: a task that ranked what its bundles gave would sort many times what it read.
        near = near.repartition(max(1, -(-n * n_bundles * candidates // RANKED)), "query_id")
        near = vector.ranked(near, candidates, "id").select("query_id", "cell", "id")
        pairs = near.join(lists.select("cell", "id", "vector"), ["cell", "id"]).join(asked, "query_id").select("query_id", "id", "vector", "embedding")

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = Q.matrix(batch.column(2), model.dims)[0], Q.matrix(batch.column(3), model.dims)[0]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round((a * b).sum(1), digits))], ["query_id", id_col, "score"])

        return vector.ranked(pairs.mapInArrow(exact, f"query_id {query_type}, {id_col} {id_type}, score double"), k, id_col)
