"""N-gram Jaccard join by chosen paths.

1. A text becomes the set of its runs of five words.  Texts with the same set are one class member with a
   count; only distinct sets go on.
2. A set is embedded as the minima of FUNCTIONS hash functions; each pair (function, minimum) is a token that
   two sets share with the probability of their Jaccard similarity.
3. Each run starts from one node that holds all sets.  A node samples tokens at the rate 1 / (similarity *
   FUNCTIONS) and sends a set to a child for each sampled token that it has, so a similar pair survives a
   level with one expected shared child.  Nodes with few sets are compared by brute force on the embeddings;
   larger ones are split again, and after DEPTH levels compared in tiles of bounded size.  The number of runs
   follows from the recall wanted for a pair at the threshold.
4. The links found (by a cautious estimate) join sets into candidate groups.  In each group the full sets are
   read once and compared exactly: that gives the numbers of links and the final classes.

No pair is ever emitted: a node yields at most one link for each of its sets, a group one for each set (and tile).
Large nodes and groups are compared with their first set; only sets that are not close to it meet all others.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import BROADCAST_ROWS, checkpoint, components, join_counted, named, own_columns, partitions_for, unique_ids, without

FUNCTIONS = 64
DEPTH = 3
SMALL = 64
TILE = 512

_random = np.random.default_rng(20240607)
MULTIPLY = _random.integers(0, 2**63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _random.integers(0, 2**63, FUNCTIONS, dtype=np.uint64)


def runs_needed(recall: float, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has shared a node of every level with probability `recall`."""
    alive = 1.0
    for _ in range(depth):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes of n-word runs, sorted within a text; where each text's begin).

    A text of 1 to n-1 words has one run, of all its words; one without words has none."""
    hashed, at = W.word_hashes(data, offsets)
    runs, begins = W.grams(hashed, at, n)
    counts = np.diff(begins)
    short = np.flatnonzero((counts == 0) & (np.diff(at) > 0))
    doc = np.concatenate((np.repeat(np.arange(len(counts)), counts), short))
    whole = np.zeros(len(short), dtype=np.uint64)
    for k, i in enumerate(short.tolist()):
        own = hashed[at[i] : at[i + 1]]
        whole[k] = np.bitwise_xor.reduce(W.mix(own + np.arange(1, len(own) + 1, dtype=np.uint64)))
    value = np.concatenate((runs, whole))
    order = np.lexsort((value, doc)) if len(short) else None
    if order is None:
        for i in range(len(counts)):
            value[begins[i] : begins[i + 1]].sort()
    else:
        value, doc = value[order], doc[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], np.searchsorted(doc[new], np.arange(len(counts) + 1))


def embed(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, FUNCTIONS) minima of 32 bits; texts without shingles get zeros."""
    out = np.zeros((len(at) - 1, FUNCTIONS), dtype=np.uint32)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        for i in range(FUNCTIONS):
            out[full, i] = np.minimum.reduceat(((sets * MULTIPLY[i] + ADD[i]) >> np.uint64(32)).astype(np.uint32), at[full])
    return out


def shorten(tokens: np.ndarray) -> np.ndarray:
    """16 bits of each token: enough to compare two sets, not to tell all sets of a corpus apart."""
    return (tokens ^ (tokens >> np.uint32(16))).astype(np.uint16)


def set_id(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 63-bit number of each set; equal sets have equal numbers."""
    total = np.zeros(len(sets) + 1, dtype=np.uint64)
    np.cumsum(W.mix(sets + np.uint64(0x51)), out=total[1:])
    n = np.diff(at).astype(np.uint64)
    return (W.mix((total[at[1:]] - total[at[:-1]]) + n * np.uint64(0x9E37)) >> np.uint64(1)).astype(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """doc_id, sid, n_shingles, tokens for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in W.blocks(batch.column(1)):
                sets, at = shingle_sets(data, offsets, n)
                tokens = embed(sets, at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(set_id(sets, at)), pa.array(np.diff(at).astype(np.int64)), pa.array([t.tobytes() for t in tokens], pa.binary())], ["doc_id", "sid", "n_shingles", "tokens"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(W.lean(run), f"doc_id {id_type}, sid long, n_shingles long, tokens binary")


def children(node: np.ndarray, tokens: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child node) of each sampled token; which tokens a node samples depends on the node alone."""
    rate = np.uint64(int(2**64 / (similarity * FUNCTIONS)))
    rows, out = [], []
    for i in range(FUNCTIONS):
        salt = W.mix(np.full(1, i + 1, dtype=np.uint64))
        chosen = np.flatnonzero(W.mix(node ^ salt) < rate)
        rows.append(chosen)
        out.append(W.mix(node[chosen] * W.BASE + salt) ^ W.mix(tokens[chosen, i].astype(np.uint64) + salt))
    return np.concatenate(rows), W.mix(np.concatenate(out))


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def matrix_of(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, FUNCTIONS)


def with_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sketch = shorten(matrix_of(batch.column("tokens"), np.uint32))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s.tobytes() for s in sketch], pa.binary())], [*batch.schema.names, "sketch"])


def split(rows: DataFrame, similarity: float, runs: int | None) -> DataFrame:
    """The next level: (node, sid) for each child.  With runs, from the root of each run; else from `node`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, tokens = batch.column("sid"), matrix_of(batch.column("tokens"), np.uint32)
            starts = [W.mix(np.full(len(sid), 0xABCD + 7919 * r, dtype=np.uint64)) for r in range(runs)] if runs else [np.asarray(batch.column("node")).astype(np.int64).view(np.uint64)]
            for node in starts:
                row, child = children(node, tokens, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(signed(child)), sid.take(pa.array(row))], ["node", "sid"])

    return rows.mapInArrow(W.lean(run), "node long, sid long")


def grouped(key: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Callable:
    """A mapInArrow function over rows sorted by key: hands on tables of whole groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.asarray(batch.column(k)) for k in key]
            starts = np.zeros(batch.num_rows, dtype=bool)
            for k, c in zip(key, columns, strict=True):
                starts[1:] |= c[1:] != c[:-1]
                starts[0] |= bool(held) and held[-1].column(k)[-1].as_py() != c[0]
            cuts = np.flatnonzero(starts)
            if len(cuts):
                last = int(cuts[-1])
                yield from work(pa.Table.from_batches([*held, *([batch.slice(0, last)] if last else [])]))
                held, batch = [], batch.slice(last)
            held.append(batch)
        if held:
            yield from work(pa.Table.from_batches(held))

    return run


def least_labels(linked: np.ndarray) -> np.ndarray:
    """For each node of a symmetric boolean matrix the smallest index in its component."""
    n = len(linked)
    label = np.arange(n)
    while True:
        lower = np.where(linked, label[None, :], n).min(axis=1, initial=n)
        lower = np.minimum(lower, label)
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def compare_nodes(least_share: float) -> Callable:
    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        node, sid = np.asarray(table.column("node")), np.asarray(table.column("sid"))
        order = np.lexsort((sid, node))
        node, sid = node[order], sid[order]
        sketch = matrix_of(table.column("sketch"), np.uint16)[order]
        bounds = np.concatenate(([0], np.flatnonzero(node[1:] != node[:-1]) + 1, [len(node)]))
        a, b = [], []
        sizes = np.diff(bounds)
        pairs = bounds[:-1][sizes == 2]
        close = (sketch[pairs] == sketch[pairs + 1]).sum(1) >= least_share * FUNCTIONS
        a.append(sid[pairs[close] + 1])
        b.append(sid[pairs[close]])
        for start, size in zip(bounds[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            own = sketch[start : start + size]
            linked = np.empty((size, size), dtype=bool)
            for k in range(0, size, 64):
                linked[k : k + 64] = (own[k : k + 64, None, :] == own[None, :, :]).sum(2) >= least_share * FUNCTIONS
            label = least_labels(linked)
            moved = np.flatnonzero(label != np.arange(size))
            a.append(sid[start + moved])
            b.append(sid[start + label[moved]])
        x, y = np.concatenate(a), np.concatenate(b)
        both = np.unique(np.stack([x, y], 1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return grouped(["node"], work)


def in_tiles(rows: DataFrame, key: str) -> DataFrame:
    """rows, copied to the tiles (key, kind, i, j, side) in which each pair of sets that needs comparing meets once.

    rows: key, sid, done, n_left, n_done and others.  Sets that aren't done are dealt to blocks of about TILE, which meet each other
    (kind 0) and the blocks of those that are (kind 1); sets that are done don't meet each other."""
    own = lambda n, salt: F.pmod(F.xxhash64("sid", F.lit(salt)), blocks(n)).cast("int")
    blocks = lambda n: F.ceil(F.col(n) / TILE).cast("int")
    numbers = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), blocks(n) - 1)).otherwise(F.array().cast("array<int>"))
    tile = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    left, done = F.col("left_block"), F.col("done_block")
    among = F.transform(numbers("n_left"), lambda o: tile(0, F.least(left, o), F.greatest(left, o), (left > o).cast("int")))
    across = F.transform(numbers("n_done"), lambda j: tile(1, left, j, F.lit(0)))
    meets = F.when(F.col("done"), F.transform(numbers("n_left"), lambda i: tile(1, i, done, F.lit(1)))).otherwise(F.concat(among, across))
    placed = rows.withColumn("left_block", F.when(~F.col("done"), own("n_left", 7))).withColumn("done_block", F.when(F.col("done"), own("n_done", 5)))
    others = [c for c in rows.columns if c not in ("n_left", "n_done")]
    return placed.select(*others, F.explode(meets).alias("tile")).select(*others, "tile.*")


def beside_first(big: DataFrame, cautious: float) -> tuple[DataFrame, DataFrame]:
    """((a, b): links of a node's sets to its first set, (node, sid, sketch): the tiles in which what is left meets all).

    Links need only join a node's sets, so sets that the first one is like are done with among themselves: a node of near
    copies is linked in one pass."""
    reps = big.groupBy("node").agg(F.min_by("sketch", "sid").alias("rep_sketch"), F.min("sid").alias("rep"))
    met = join_counted(big.select("node", "sid", "sketch"), reps, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = (matrix_of(batch.column("sketch"), np.uint16) == matrix_of(batch.column("rep_sketch"), np.uint16)).sum(1) >= cautious * FUNCTIONS
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("sid"), batch.column("sketch"), batch.column("rep"), pa.array(alike)], ["node", "sid", "sketch", "rep", "done"])

    placed = checkpoint(met.mapInArrow(W.lean(run), "node long, sid long, sketch binary, rep long, done boolean"))
    first = placed.where("done and sid <> rep").select(F.col("sid").alias("a"), F.col("rep").alias("b"))
    sums = placed.groupBy("node").agg(F.count_if(~F.col("done")).alias("n_left"), F.count_if("done").alias("n_done")).where("n_left > 0")
    tiles = in_tiles(join_counted(placed.select("node", "sid", "sketch", "done"), sums, "node"), "node")
    return first, tiles.select(F.xxhash64("node", "kind", "i", "j").alias("node"), "sid", "sketch")


def candidate_links(sets: DataFrame, n_sets: int, similarity: float, recall: float, cautious: float) -> DataFrame:
    """(a, b): links that join, over any number of steps, all pairs of sets that a shared node shows to be alike."""
    spark = sets.sparkSession
    level, found = split(sets, similarity, runs_needed(recall)), None
    for depth in range(1, DEPTH + 1):
        level = checkpoint(level)
        sizes = level.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        alive = join_counted(level, sizes, "node")
        level = checkpoint(alive.join(sets.select("sid", "sketch"), "sid"))
        big = level.where(F.col("size") > SMALL)
        ready = level.where(F.col("size") <= SMALL).select("node", "sid", "sketch")
        more = not big.isEmpty()
        if depth == DEPTH and more:
            first, tiles = beside_first(big, cautious)
            found = first if found is None else found.unionByName(first)
            ready = ready.unionByName(tiles)
        parts = partitions_for(spark, n_sets * 4, 100_000)
        links = ready.repartition(parts, "node").sortWithinPartitions("node").mapInArrow(W.lean(compare_nodes(cautious)), "a long, b long")
        found = links if found is None else found.unionByName(links)
        if not more:
            break
        level = split(big.select("node", "sid").join(sets.select("sid", "tokens"), "sid"), similarity, None)
    return found.distinct()


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of the one list shares with each of the other, in slices of the shingles."""
    value, column = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in [*left, *right]])
    by = np.argsort(column, kind="stable")
    column, owner = column[by], owner[by]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    width = max(256, 2_000_000 // (len(left) + len(right)))
    for k in range(0, len(value), width):
        lo, hi = np.searchsorted(column, (k, k + width))
        matrix = np.zeros((len(left) + len(right), min(width, len(value) - k)), dtype=np.float32)
        matrix[owner[lo:hi], column[lo:hi] - k] = 1
        out += matrix[: len(left)] @ matrix[len(left) :].T
    return out


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> np.ndarray:
    shared = shared_counts(left, right)
    n, m = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    return shared >= similarity * (n[:, None] + m[None, :] - shared) - 1e-4


def sets_of(column: pa.ChunkedArray, rows: np.ndarray) -> list[np.ndarray]:
    return [np.frombuffer(column[int(r)].as_py(), np.uint64) for r in rows]


def runs_of(*keys: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of equal keys."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    starts = np.flatnonzero(new)
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(new)], strict=True))


RESULT = ["sid", "n_doc_links", "n_set_links", "least"]


def compare_groups(similarity: float) -> Callable:
    """Exact comparison of all sets of a group of at most TILE."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        group, sid, copies = (np.asarray(table.column(c)) for c in ("component", "sid", "copies"))
        packed = table.column("shingles")
        order = np.lexsort((sid, group))
        out: list[list[np.ndarray]] = [[], [], [], []]
        for start, end in runs_of(group[order]):
            rows = order[start:end]
            rows = rows[np.concatenate(([True], sid[rows][1:] != sid[rows][:-1]))]  # a repeated row
            sets = sets_of(packed, rows)
            linked = linked_pairs(sets, sets, similarity)
            np.fill_diagonal(linked, False)
            out[0].append(sid[rows])
            out[1].append(linked @ copies[rows].astype(np.int64))
            out[2].append(linked.sum(1))
            out[3].append(sid[rows][least_labels(linked)])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], RESULT)

    return grouped(["component"], work)


def around_first(large: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(results of the tight sets among themselves, tiles of the other sets among themselves and with the tight ones) of groups over TILE sets.

    1 - similarity is a metric, so two sets that are each within half of the allowed distance of the group's first set
    are linked: they are counted, not compared.  Only the others meet every set of the group, in tiles of about 2 * TILE rows.
    A group of near copies costs one comparison a set."""
    reps = large.groupBy("component").agg(F.min_by("shingles", "sid").alias("first"), F.min("sid").alias("rep"))
    met = join_counted(large, reps, "component")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tight = []
            for own, first in zip(batch.column("shingles").to_pylist(), batch.column("first").to_pylist(), strict=True):
                a, b = np.frombuffer(own, np.uint64), np.frombuffer(first, np.uint64)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                tight.append(shared >= (1 + similarity) / 2 * (len(a) + len(b) - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("component", "sid", "copies", "shingles", "rep")], pa.array(tight, pa.bool_())], ["component", "sid", "copies", "shingles", "rep", "done"])

    placed = checkpoint(met.mapInArrow(W.lean(run), "component long, sid long, copies long, shingles binary, rep long, done boolean"))
    sums = placed.groupBy("component").agg(F.count_if(~F.col("done")).alias("n_left"), F.count_if("done").alias("n_done"), F.sum(F.when(F.col("done"), F.col("copies")).otherwise(0)).alias("done_copies"))
    known = join_counted(placed, sums, "component")
    among = known.where("done").select("sid", (F.col("done_copies") - F.col("copies")).alias("n_doc_links"), (F.col("n_done") - 1).alias("n_set_links"), F.col("rep").alias("least"))
    return among, in_tiles(known.where("n_left > 0").select("component", "sid", "copies", "shingles", "done", "n_left", "n_done"), "component").drop("done")


def compare_tiles(similarity: float) -> Callable:
    """Exact comparison of the two sides of a tile, or of one side with itself."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = [np.asarray(table.column(c)) for c in ("component", "kind", "i", "j")]
        sid, copies, side = (np.asarray(table.column(c)) for c in ("sid", "copies", "side"))
        packed = table.column("shingles")
        order = np.lexsort((sid, side, *reversed(keys)))
        out: list[list[np.ndarray]] = [[], [], [], []]
        for start, end in runs_of(*[k[order] for k in keys]):
            rows = order[start:end]
            linked = np.zeros((len(rows), len(rows)), dtype=bool)
            if keys[1][rows[0]] == 0 and keys[2][rows[0]] == keys[3][rows[0]]:
                sets = sets_of(packed, rows)
                linked[:] = linked_pairs(sets, sets, similarity)
                np.fill_diagonal(linked, False)
            else:
                k = int((side[rows] == 0).sum())
                if 0 < k < len(rows):
                    linked[:k, k:] = linked_pairs(sets_of(packed, rows[:k]), sets_of(packed, rows[k:]), similarity)
                    linked[k:, :k] = linked[:k, k:].T
            out[0].append(sid[rows])
            out[1].append(linked @ copies[rows].astype(np.int64))
            out[2].append(linked.sum(1))
            out[3].append(sid[rows][least_labels(linked)])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], RESULT)

    return grouped(["component", "kind", "i", "j"], work)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, similarity: float = 0.8, recall: float = 0.999, cautious: float = 0.55) -> DataFrame:
    """One row per input row: doc_id, set_id, class_id, class_size, n_links, n_set_links, kept.

    set_id: the smallest doc_id with the same set of n-word runs; class_id: the smallest doc_id that links of
    similarity or more reach; n_links: other rows linked to this one, copies included; n_set_links: other
    sets linked; kept: this is the class's first row.  A text under n words has one run; texts without words
    (null, empty) link to nothing, are classes of their own, and are kept.  Rows that repeat an id are copies
    of each other if their sets agree.  A null id is never a class's first unless all its ids are null; its row is compared
    and linked like any other.
    Other columns are not looked at.  recall: the chance that a pair at the very threshold meets in a node."""
    spark = docs.sparkSession
    rows = checkpoint(signatures(docs, id_col, text_col, n))
    sets = checkpoint(rows.where("n_shingles > 0").groupBy("sid").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.max("tokens").alias("tokens")).mapInArrow(with_sketch, f"sid long, first_id {rows.schema['doc_id'].dataType.simpleString()}, copies long, tokens binary, sketch binary"))
    n_sets = sets.count()
    loose = components(candidate_links(sets.select("sid", "tokens", "sketch"), n_sets, similarity, recall, cautious))
    members = checkpoint(loose.join(sets.select("sid", "first_id", "copies"), loose["node"] == sets["sid"]).select("component", "sid", "first_id", "copies"))
    n_members = members.count()

    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    placed = members.join(sizes, "component").withColumn("blocks", F.ceil(F.col("size") / TILE).cast("int"))
    def reread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in W.blocks(batch.column("text")):
                found, at = shingle_sets(data, offsets, n)
                part = batch.slice(lo, hi - lo)
                same = np.flatnonzero(set_id(found, at) == np.asarray(part.column("sid")))  # another row may repeat the id
                take = pa.array(same)
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(take) for c in ("component", "sid", "copies", "blocks")], pa.array([found[at[i] : at[i + 1]].tobytes() for i in same], pa.binary())], ["component", "sid", "copies", "blocks", "shingles"])

    def reread_nameless(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in W.blocks(batch.column(0)):
                found, at = shingle_sets(data, offsets, n)
                yield pa.RecordBatch.from_arrays([pa.array(set_id(found, at)), pa.array([found[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["sid", "shingles"])

    def full(of: DataFrame) -> DataFrame:
        """The sets of members, read again from the rows that hold them; a set may come more than once."""
        send = F.broadcast if n_members <= BROADCAST_ROWS else (lambda df: df)
        texts = docs.select(F.col(id_col).alias("first_id"), F.col(text_col).alias("text")).join(send(of.where("first_id is not null")), "first_id").select("component", "sid", "copies", "blocks", "text")
        found = texts.mapInArrow(W.lean(reread), "component long, sid long, copies long, blocks int, shingles binary")
        nameless = of.where("first_id is null").select("component", "sid", "copies", "blocks")
        if nameless.isEmpty():
            return found
        # sets that no id leads to are found by their numbers
        own = docs.where(F.col(id_col).isNull()).select(F.col(text_col).alias("text")).mapInArrow(W.lean(reread_nameless), "sid long, shingles binary")
        return found.unionByName(own.join(send(nameless), "sid").dropDuplicates(["sid"]).select(*found.columns))

    parts = partitions_for(spark, n_members, 5_000)
    result = "sid long, n_doc_links long, n_set_links long, least long"
    small = full(placed.where("blocks = 1")).repartition(parts, "component").sortWithinPartitions("component")
    compared = small.mapInArrow(W.lean(compare_groups(similarity)), result)
    if not sizes.where(F.col("size") > TILE).isEmpty():
        tight, tiles = around_first(checkpoint(full(placed.where("blocks > 1")).dropDuplicates(["sid"])), similarity)
        compared = compared.unionByName(tight).unionByName(tiles.repartition(parts, "component", "kind", "i", "j").sortWithinPartitions("component", "kind", "i", "j").mapInArrow(W.lean(compare_tiles(similarity)), result))
    exact = checkpoint(compared)

    links = exact.groupBy("sid").agg(F.sum("n_doc_links").alias("n_doc_links"), F.sum("n_set_links").alias("n_set_links"))
    classes = components(exact.where("sid <> least").select(F.col("sid").alias("a"), F.col("least").alias("b")))
    placed = sets.select("sid", "first_id", "copies").join(classes, F.col("sid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "sid"))
    roots = placed.groupBy("component").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_size"))
    settled = checkpoint(placed.join(roots, "component").join(links, "sid", "left").select("sid", F.col("first_id").alias("set_id"), "class_id", "class_size", "copies", F.coalesce("n_doc_links", F.lit(0)).alias("n_doc_links"), F.coalesce("n_set_links", F.lit(0)).alias("n_set_links")))

    # Sets of many rows are few and go by broadcast; the others are joined on their own key.
    n_rows = rows.count()
    hot_from = max(1000, n_rows // 256)
    columns = ["sid", "set_id", "class_id", "class_size", "copies", "n_doc_links", "n_set_links"]
    hot = F.broadcast(settled.where(F.col("copies") >= hot_from).select(*[F.col(c).alias(f"hot_{c}") for c in columns]))
    cold = settled.where(F.col("copies") < hot_from).select(*[F.col(c).alias(f"cold_{c}") for c in columns])
    out = rows.select("doc_id", "n_shingles", "sid").join(hot, (F.col("sid") == F.col("hot_sid")) & (F.col("n_shingles") > 0), "left")
    key = F.when(F.col("hot_sid").isNotNull() | (F.col("n_shingles") == 0), -1 - F.abs(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.monotonically_increasing_id().cast("string"))) % (1 << 40))).otherwise(F.col("sid"))
    out = out.withColumn("key", key).join(cold, F.col("key") == F.col("cold_sid"), "left")
    pick = lambda c: F.coalesce(f"hot_{c}", f"cold_{c}")
    class_id = F.coalesce(pick("class_id"), F.col("doc_id"))
    return out.select(
        "doc_id", F.coalesce(pick("set_id"), F.col("doc_id")).alias("set_id"), class_id.alias("class_id"), F.coalesce(pick("class_size"), F.lit(1)).cast("long").alias("class_size"),
        F.coalesce(pick("copies") - 1 + pick("n_doc_links"), F.lit(0)).cast("long").alias("n_links"), F.coalesce(pick("n_set_links"), F.lit(0)).cast("long").alias("n_set_links"), F.col("doc_id").eqNullSafe(class_id).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, in its own columns, with the first document of each class of near duplicates.

    Rows with missing or repeated ids are told apart by their texts, and rows that repeat both are reduced to one."""
    rows, key = unique_ids(docs, id_col, text_col)
    if key != id_col:
        rows = rows.dropDuplicates([key])
    found = jaccard_join(rows, key, text_col, **options)
    return without(rows, found.where("not kept").select("doc_id"), [(named(key), "doc_id")]).select(*own_columns(docs))
