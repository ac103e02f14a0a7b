"""What the operators share: tables, checkpoints, skew-safe joins and connected components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.scratch import checkpoint, remove
from folioflow.scratch import folder as scratch_folder

__all__ = ["checkpoint", "remove", "scratch_folder"]

UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of two longs that one broadcast may hold; beyond it the join is shuffled.
BROADCAST_ROWS = 400_000
BROADCAST_BYTES = 4 << 20
#: Edges that one task of a round of components writes, about.
EDGES = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER_AZ, LOWER_AZ)


def named(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def own_columns(df: DataFrame) -> list[Column]:
    return [named(c) for c in df.columns]


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it: no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def join_counted(rows: DataFrame, counted: DataFrame, key: str) -> DataFrame:
    """rows joined with counted, which has a row a key.

    counted is written once and measured: up to BROADCAST_BYTES it is broadcast; beyond, both sides are plain shuffles with no
    aggregation above them, so that the adaptive skew join can deal the rows of a frequent key to many tasks."""
    counted = checkpoint(counted)
    binary = [F.octet_length(f.name) for f in counted.schema.fields if f.dataType.simpleString() == "binary"]
    n_bytes = counted.agg(F.sum(sum(binary, F.lit(16 * len(counted.columns)).cast("long")))).first()[0] or 0
    return rows.join(F.broadcast(counted) if n_bytes <= BROADCAST_BYTES else counted, key)


def partitions_for(spark: SparkSession, rows: int, each: int) -> int:
    """So many that each holds about `each` rows, and no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def dealt(df: DataFrame, key: str, n_bytes: int, each: int = 128 << 20) -> DataFrame:
    """df dealt by key to so many partitions that each gets about `each` of n_bytes, where the session's shuffle partitions are fewer."""
    wanted = -(-n_bytes // each)
    return df.repartition(wanted, key) if wanted > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def checked_broadcast(small: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """small, marked for broadcast only if its counted rows are within the bound."""
    return F.broadcast(small) if rows <= most else small


def null_safe(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]]) -> Column:
    condition = F.lit(True)
    for a, b in on:
        condition = condition & left[a].eqNullSafe(right[b])
    return condition


def without(docs: DataFrame, drop: DataFrame, on: Sequence[tuple[Column, str]]) -> DataFrame:
    """docs less the rows whose key (a column expression for each column of drop) is in drop; null equals null.

    drop is written once and counted; it is broadcast only within BROADCAST_ROWS, else the anti-join is shuffled."""
    drop = checkpoint(drop)
    n = drop.count()
    if n == 0:
        return docs
    condition = F.lit(True)
    names = [fresh(docs, f"__drop_{i}") for i in range(len(on))]
    renamed = drop.select(*[F.col(name).alias(names[i]) for i, (_, name) in enumerate(on)])
    for i, (expression, _) in enumerate(on):
        condition = condition & expression.eqNullSafe(F.col(names[i]))
    return docs.join(checked_broadcast(renamed, n), condition, "left_anti")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b) of longs, by alternating large and small stars.

    Every round is two aggregations with map-side combining and two equi-joins, and is written; the edges
    never grow beyond twice their first number.  Nodes without an edge have no row."""
    spark, folders = edges.sparkSession, []

    def written(df: DataFrame, rows: int | None = None) -> DataFrame:
        """df as a table of its own, whose size Spark knows, in a file for each EDGES of about `rows` rows; those that nothing reads any more are deleted."""
        folders.append(scratch_folder(spark))
        (df if rows is None else df.coalesce(max(1, -(-rows // EDGES)))).write.parquet(folders[-1])
        for folder in folders[-4:-3]:
            remove(spark, folder)
        return spark.read.schema("a long, b long").parquet(folders[-1])

    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = written(join_counted(both.where("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), before[0])
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = join_counted(large, smallest, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = written(small, 2 * before[0])
        now = state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def unique_ids(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """docs and a column that names a row: id_col where no id is missing or repeated, else a new column, a hash of id and text.

    Rows that repeat both then have one name."""
    counts = docs.groupBy(named(id_col).alias("id")).agg(F.count("*").alias("n"))
    if counts.where("id is null or n > 1").isEmpty():
        return docs, id_col
    name = fresh(docs, "__row_name")
    return docs.withColumn(name, F.xxhash64(named(id_col).cast("string"), F.coalesce(named(text_col), F.lit("")))), name
