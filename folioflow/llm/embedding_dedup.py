"""Near-duplicate embeddings by product quantisation.

1. Vectors of a label are dealt to inverted lists by their nearest cell, with a code of bytes for what the cell's centre
   misses and the length of what the code misses in turn (folioflow.operators.quantizer; fitted on a bounded sample).
2. Every vector also visits near cells: those whose border with its own cell is within the largest distance that a link
   spans, the PROBES nearest at most.  A visit goes to cells with a smaller number only, so that a pair meets once, in the
   smaller of its two cells.
3. In a list, inner products with the codes come from a table for each vector and part.  A pair is a candidate if the product
   reaches the threshold less what the code misses, a bound that loses no link; candidates are ranked again by the exact cosine.
4. Lists that hold many vectors have pivots, found on a sample: angles are a metric, so vectors within half of the
   allowed angle of a pivot are all linked to each other, and are counted instead of compared; only vectors within one
   and a half of it can have links to them.  Lists and visits are cut into tiles of bounded size.
5. Links join vectors to components.

A group of near copies of any size is one comparison a vector; no pair is ever emitted.  What remains quadratic is a
large list whose vectors lie neither near to a pivot nor far from each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators import quantizer as Q

from . import words as W
from .common import checkpoint, components, join_counted, named, partitions_for
from .jaccard_join import least_labels, runs_of

#: Vectors of a label in a cell, about, where there are cells enough; and the most cells.
LIST_ROWS, MOST_CELLS = 512, 4096
#: Cells that a vector is compared in at most, its own included.
PROBES = 8
#: Vectors of a list in a tile; visitors that meet them there.
TILE, VISITORS = 512, 4096
#: Vectors of a large list that its pivots are found on, about; the most pivots; the least share of the sample that one stands for.
PIVOT_ROWS, PIVOTS, PIVOT_SHARE = 256, 16, 1 / 32
LOOSE = PIVOTS + 1


def units(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of unit length as doubles; shorter ones end in zeros."""
    out = np.zeros((len(column), dims))
    for n in pc.unique(pc.list_value_length(column)).drop_null().to_pylist():
        x, good = Q.matrix(column, n)
        x = x / np.maximum(np.abs(x).max(1, keepdims=True), np.finfo(float).tiny) if n else x  # squares neither vanish nor overflow
        out[good, :n] = x[good] / np.linalg.norm(x[good], axis=1, keepdims=True)
    return out


def border(model: Q.Quantizer, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """How far each row is from the border between its nearest cell, the first of cells, and each other."""
    centres = model.cells[cells]
    less = (centres**2).sum(2) / 2 - np.einsum("nd,ncd->nc", x, centres)
    apart = np.linalg.norm(centres - centres[:, :1], axis=2)
    return (less - less[:, :1]) / np.maximum(apart, 1e-12)


def pivots_of(x: np.ndarray, similarity: float) -> np.ndarray:
    """Centres of the denser balls of a sample, densest first: each stands for a share of it at least."""
    tight, found = math.sqrt((1 + similarity) / 2), []
    least = max(8, PIVOT_SHARE * len(x))
    while len(x) >= least and len(found) < PIVOTS:
        linked = x @ x.T >= similarity
        centre = x[linked[linked.sum(1).argmax()]].mean(0)
        centre /= np.linalg.norm(centre)
        inside = x @ centre >= tight
        if inside.sum() < least:
            break
        found.append(centre)
        x = x[~inside]
    return np.array(found)


def linked(model: Q.Quantizer, cell: int, asked: np.ndarray, have: np.ndarray, codes: np.ndarray, missed: np.ndarray, similarity: float) -> np.ndarray:
    """Which rows of a list have a cosine of similarity with each row asked for: candidates by codes, then exactly."""
    near = model.scores(asked, cell, codes) >= similarity - missed[None, :] - 1e-5  # the last is the rounding of the tables
    rows, columns = near.any(1), near.any(0)
    near[np.ix_(rows, columns)] &= asked[rows] @ have[columns].T >= similarity
    return near


class Lists:
    """Where the vectors of `rows` (node, label, vector) go."""

    def __init__(self, model: Q.Quantizer, similarity: float, probes: int, vector_type: str):
        self.model, self.similarity, self.probes = model, similarity, probes
        self.chord = math.sqrt(2 - 2 * similarity)
        self.half = math.acos(similarity) / 2
        self.vector_type = vector_type
        self.placed = f"list string, cell int, visitor boolean, node long, vector {vector_type}, code binary, missed double"

    def homes(self, rows: DataFrame) -> DataFrame:
        """(list, node, vector), a row each: the list of a vector's own cell."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = self.model.near(units(batch.column("vector"), self.model.dims), 1)[:, 0]
                yield pa.RecordBatch.from_arrays([self.names(batch.column("label"), cell), batch.column("node"), batch.column("vector")], ["list", "node", "vector"])

        return rows.mapInArrow(W.lean(run), f"list string, node long, vector {self.vector_type}")

    @staticmethod
    def names(label: pa.Array, cell: np.ndarray) -> pa.Array:
        return pc.binary_join_element_wise(pa.array(cell.astype(str)), label, "|")

    def place(self, rows: DataFrame) -> DataFrame:
        """A row for the list of each vector, with its code, and for each one that it visits."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = units(batch.column("vector"), self.model.dims)
                cells = self.model.near(x, self.probes)
                codes, missed = self.model.encode(x, cells[:, 0])
                goes = (border(self.model, x, cells) <= self.chord + 1e-9) & (cells < cells[:, :1])
                goes[:, 0] = True
                row, k = np.nonzero(goes)
                home, take = k == 0, pa.array(row)
                cell = cells[row, k]
                code = pa.array([codes[r].tobytes() if h else None for r, h in zip(row.tolist(), home.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([self.names(batch.column("label").take(take), cell), pa.array(cell), pa.array(~home), batch.column("node").take(take), batch.column("vector").take(take), code, pa.array(missed[row], mask=~home)], ["list", "cell", "visitor", "node", "vector", "code", "missed"])

        return rows.mapInArrow(W.lean(run), self.placed)

    def pivots(self, rows: DataFrame) -> DataFrame | None:
        """(list, pivots) of the lists over TILE that have any; None without."""
        homes = self.homes(rows)
        big = checkpoint(homes.groupBy("list").agg(F.count("*").alias("size")).where(F.col("size") > TILE))
        if big.isEmpty():
            return None
        some = join_counted(homes, big, "list").where(F.pmod(F.xxhash64("node"), F.col("size")) < PIVOT_ROWS)

        def find(table: pa.Table) -> pa.Table:
            x = units(table.column("vector").combine_chunks(), self.model.dims)
            found = pivots_of(x[np.argsort(np.asarray(table.column("node")))], self.similarity)
            return pa.table({"list": table.column("list").slice(0, 1), "pivots": pa.array([found.tobytes()])})

        found = checkpoint(some.groupBy("list").applyInArrow(W.lean_group(find), "list string, pivots binary").where("octet_length(pivots) > 0"))
        return None if found.isEmpty() else found

    def settle(self, placed: DataFrame, pivots: DataFrame | None) -> DataFrame:
        """placed with `unit` and `tight` for `list`: a list with pivots falls into units, and a visitor visits those that can have links to it.

        Of the units of a list, too, a vector visits those with smaller numbers only."""
        if pivots is None:
            return placed.withColumn("tight", F.lit(False)).withColumnRenamed("list", "unit")
        n = pivots.count()
        joined = placed.join(F.broadcast(pivots) if n * PIVOTS * self.model.dims * 8 <= 4 << 20 else pivots, "list", "left")
        near, reach = math.cos(self.half) + 1e-12, math.cos(min(math.pi, 3 * self.half)) - 1e-9

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, visitor = units(batch.column("vector"), self.model.dims), np.asarray(batch.column("visitor").to_numpy(zero_copy_only=False)).astype(bool)
                close = np.full((len(x), PIVOTS), -2.0)
                lists = pc.dictionary_encode(batch.column("list"))
                code, kept = np.asarray(lists.indices), batch.column("pivots")
                for c in np.unique(code).tolist():
                    own = np.flatnonzero(code == c)
                    raw = kept[int(own[0])].as_py()
                    if raw is not None:
                        p = np.frombuffer(raw).reshape(-1, self.model.dims)
                        close[own, : len(p)] = x[own] @ p.T
                inside = close >= near
                home = np.where(visitor | ~inside.any(1), LOOSE, inside.argmax(1) + 1)
                goes = (close >= reach) & (np.arange(1, PIVOTS + 1) < home[:, None])
                row, k = np.nonzero(np.concatenate([goes, np.ones((len(x), 1), bool)], 1))
                own = k == PIVOTS
                sub, take = np.where(own, home[row], k + 1), pa.array(row)
                unit = pc.binary_join_element_wise(pa.array(sub.astype(str)), batch.column("list").take(take), "|")
                kept = [batch.column(c).take(take) for c in ("cell", "node", "vector")]
                stays = own & ~visitor[row]
                hidden = lambda c, t: pc.if_else(pa.array(stays), batch.column(c).take(take), pa.scalar(None, t))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([unit, kept[0], pa.array(~stays), kept[1], kept[2], hidden("code", pa.binary()), hidden("missed", pa.float64()), pa.array(sub < LOOSE)], ["unit", "cell", "visitor", "node", "vector", "code", "missed", "tight"])

        return joined.mapInArrow(W.lean(run), self.placed.replace("list string", "unit string") + ", tight boolean")

    def tiles(self, settled: DataFrame, sizes: DataFrame) -> DataFrame:
        """settled in the tiles (unit, block, side) in which each pair that may be linked meets once.

        A tile holds about TILE vectors of the unit (visitor: false) and up to VISITORS others.  Those of a loose unit also visit its blocks with
        smaller numbers.  A tight unit is compared with visitors only."""
        rows = join_counted(settled, sizes.where("not tight or visitors > 0").drop("tight", "least"), "unit")
        home_blocks = F.ceil(F.col("homes") / TILE).cast("int")
        sides = F.ceil((F.col("visitors") + F.when(F.col("tight"), 0).otherwise(F.col("homes"))) / VISITORS).cast("int")
        rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), home_blocks).cast("int")).withColumn("aside", F.pmod(F.xxhash64("node", F.lit(3)), F.greatest(sides, F.lit(1))).cast("int"))
        upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        spot = lambda block, side, visits: F.struct(block.alias("block"), side.alias("side"), F.lit(visits).alias("visits"))
        stay = F.transform(upto(F.greatest(sides, F.lit(1))), lambda s: spot(F.col("own"), s, False))
        visit = lambda blocks: F.transform(upto(blocks), lambda b: spot(b, F.col("aside"), True))
        where = F.when(F.col("visitor"), visit(home_blocks)).when(F.col("tight"), stay).otherwise(F.concat(stay, visit(F.col("own"))))
        return rows.select("unit", "cell", "tight", "node", "vector", "code", "missed", F.explode(where).alias("at")).select("unit", "cell", "tight", "node", "vector", "code", "missed", "at.*")

    def compare(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(node, n_links, least) from tiles in the order of (unit, block, side, visits): the vectors of a tile are held, its visitors stream past them."""
        key, held, homes = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = np.asarray(pc.dictionary_encode(batch.column("unit")).indices)
            columns = [unit, *(np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("block", "side", "visits"))]
            for start, end in runs_of(*columns):
                part = batch.slice(start, end - start)
                now = tuple(part.column(c)[0].as_py() for c in ("unit", "block", "side"))
                if now != key:
                    if key is not None and homes is None:
                        yield from self.within(held)
                    key, held, homes = now, [], None
                if not columns[3][start]:
                    held.append(part)
                    continue
                if homes is None:
                    yield from self.within(held)
                    homes = self.opened(held) if held else False
                for lo in range(0, part.num_rows if homes else 0, TILE):
                    yield from self.beside(homes, part.slice(lo, TILE))
        if key is not None and homes is None:
            yield from self.within(held)

    def opened(self, held: list[pa.RecordBatch]) -> tuple:
        table = pa.Table.from_batches(held)
        codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        return np.asarray(table.column("node")), units(table.column("vector").combine_chunks(), self.model.dims), codes, np.asarray(table.column("missed")), table.column("cell")[0].as_py()

    def within(self, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The vectors of a tile among themselves: on one side of it, and unless they are linked anyway."""
        if held and held[0].column("side")[0].as_py() == 0 and not held[0].column("tight")[0].as_py():
            node, x, codes, missed, cell = self.opened(held)
            found = linked(self.model, cell, x, x, codes, missed, self.similarity)
            found |= found.T  # both ways are the same pair; the codes of either side may have brought it up
            np.fill_diagonal(found, False)
            yield from told(node, found)

    def beside(self, homes: tuple, visitors: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        node, x, codes, missed, cell = homes
        own = np.asarray(visitors.column("node"))
        found = linked(self.model, cell, units(visitors.column("vector"), self.model.dims), x, codes, missed, self.similarity)
        if found.any():
            rows, columns = np.flatnonzero(found.any(1)), np.flatnonzero(found.any(0))
            both = np.zeros((len(rows) + len(columns),) * 2, dtype=bool)
            both[: len(rows), len(rows) :] = found[np.ix_(rows, columns)]
            both |= both.T
            yield from told(np.concatenate([own[rows], node[columns]]), both)


RESULT = "node long, n_links long, least long"


def told(node: np.ndarray, found: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(node, its links, a node of its component) of a symmetric matrix, for nodes that have any."""
    if found.any():
        n, label = found.sum(1), least_labels(found)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(n[some]), pa.array(node[label[some]])], ["node", "n_links", "least"])


def embedding_dedup(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", similarity: float = 0.93, probes: int = PROBES, n_cells: int | None = None) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors are linked if their labels are equal and their cosine, in double precision, is similarity or more.  n_links:
    other rows linked to this one, copies included; component_id: the smallest vec_id that links reach, its own included;
    kept: vec_id = component_id.

    Rows without a label, and vectors that are null, empty, zero, or hold a null or an entry that isn't finite, are linked with
    nothing; so are vectors of different lengths with each other.  Rows that repeat an id are rows of their own, kept alike;
    a null id is no component's smallest unless it has no other.  An empty table gives an empty result; other columns are not looked at.

    No link found is ever wrong.  One can be missed only where the cells within reach of both its vectors are more than
    `probes`; n_cells: how many cells there are, else by the number of rows of a label."""
    spark = table.sparkSession
    vector = named(vector_col)
    finite = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))) & F.exists(vector, lambda c: c.cast("double") != 0)
    good = F.coalesce(named(label_col).isNotNull() & vector.isNotNull() & finite, F.lit(False))
    label = F.concat_ws("|", F.size(vector).cast("string"), named(label_col).cast("string"))
    rows = checkpoint(table.select(F.monotonically_increasing_id().alias("node"), named(id_col).alias("vec_id"), F.when(good, label).alias("label"), F.when(good, vector).alias("vector")))
    useful = rows.where("vector is not null").select("node", "label", "vector")
    sizes = useful.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims")).agg(F.sum("n"), F.sum(F.col("n").cast("double") * F.col("n")), F.max("dims")).first()
    n, squares, dims = sizes
    if n is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    def padded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = units(batch.column(0), dims)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dims, dtype=np.int32)), pa.array(x.ravel()))], ["unit"])

    plain = useful.select("vector").mapInArrow(W.lean(padded), "unit array<double>")
    model = Q.fit(plain, n, n_cells or min(MOST_CELLS, max(1, int(squares / n) // LIST_ROWS)))
    lists = Lists(model, similarity, probes, useful.schema["vector"].dataType.simpleString())

    settled = lists.settle(lists.place(useful), lists.pivots(useful))
    counted = checkpoint(settled.groupBy("unit").agg(F.count_if(~F.col("visitor")).alias("homes"), F.count_if("visitor").alias("visitors"), F.max("tight").alias("tight"), F.min(F.when(~F.col("visitor"), F.col("node"))).alias("least")).where("homes > 0"))
    tiles = lists.tiles(settled, counted)
    parts = partitions_for(spark, n * (1 + probes // 2), 50_000)
    order = ["unit", "block", "side", "visits"]
    compared = tiles.repartition(parts, "unit", "block", "side").sortWithinPartitions(*order).mapInArrow(W.lean(lists.compare), RESULT)
    among = join_counted(settled.where("tight and not visitor").select("unit", "node"), counted.where("tight").select("unit", "homes", "least"), "unit")
    exact = checkpoint(compared.unionByName(among.select("node", (F.col("homes") - 1).alias("n_links"), "least")))

    links = exact.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    reached = components(exact.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))).withColumnRenamed("node", "reached")
    ids = checkpoint(rows.select("node", "vec_id").join(reached, F.col("node") == F.col("reached")).groupBy("component").agg(F.min("vec_id").alias("component_id")))
    own = join_counted(reached, ids, "component").select(F.col("reached").alias("node"), "component_id")
    out = rows.select("node", "vec_id").join(links, "node", "left").join(own, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
