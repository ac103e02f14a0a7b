"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

1. Rows are counted by length class (the byte length, folded beyond 65,536); the classes with two
   rows or more are at most 131,072 and are broadcast.
2. Rows of such a class are counted by a slot of (length, hash of a prefix); the slots with two rows
   or more become a bitmap of fixed size, which is broadcast.
3. Only rows whose slot is set have their full content hashed; SHA-256 decides.

All counts combine on the map side, so a text that holds a third of all rows is one row for each task.
Copies then look up their group: groups over 1/256 of the rows (at most 256) by broadcast, others by a
shuffled join in which rows without a group carry a key of their own and spread evenly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fresh, lower_az, named, without

FOLD = 1 << 16
BITMAP_BITS = 32768


def length_class(n_bytes: Column) -> Column:
    return F.when(n_bytes < FOLD, n_bytes).otherwise(FOLD + F.pmod(n_bytes, F.lit(FOLD)))


def bit_is_set() -> Column:
    """Whether __bitmap (binary, or null) has bit __position."""
    return F.expr("coalesce((shiftright(cast(conv(hex(substring(__bitmap, cast(__position div 8 as int) + 1, 1)), 16, 10) as int), cast(__position % 8 as int)) & 1) = 1, false)")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, slot_bits: int = 22, digest_all: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, text_sha256, keep_id, group_size, kept.

    Texts are equal when identical after lower-casing A-Z; null equals the empty text.  Of equal texts the
    largest id stays (null ids only where a group has no other).  Rows that repeat both id and text are all
    reported and share one verdict.  text_sha256 is null for rows that lengths or prefixes set apart, unless
    digest_all.  slot_bits sizes the bitmap (2**slot_bits / 8 bytes); a small one costs hashing, never results.
    An empty table gives an empty result; other columns, whatever their names, are not looked at."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    rows = rows.withColumn("n_bytes", F.octet_length("__text").cast("long")).withColumn("__class", length_class(F.col("n_bytes")))

    lengths = checkpoint(rows.groupBy("__class").agg(F.count("*").alias("__n")))
    n_rows = lengths.agg(F.sum("__n")).first()[0] or 0
    shared = lengths.where("__n > 1").select("__class", F.lit(True).alias("__shared"))

    rows = rows.join(F.broadcast(shared), "__class", "left")
    prefix = lower_az(F.substring("__text", 1, prefix_chars))
    slot = F.pmod(F.xxhash64("n_bytes", prefix), F.lit(1 << slot_bits))
    rows = rows.withColumn("__slot", F.when(F.col("__shared"), slot))
    crowded = rows.where("__slot is not null").groupBy("__slot").agg(F.count("*").alias("__n")).where("__n > 1")
    bitmaps = checkpoint(
        crowded.select(F.floor(F.col("__slot") / BITMAP_BITS).alias("__bucket"), F.bitmap_bit_position(F.col("__slot") + 1).alias("__bit")).groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__bitmap"))
    )

    rows = rows.withColumn("__bucket", F.floor(F.col("__slot") / BITMAP_BITS)).withColumn("__position", F.bitmap_bit_position(F.col("__slot") + 1))
    rows = rows.join(F.broadcast(bitmaps), "__bucket", "left")
    rows = rows.withColumn("__survives", bit_is_set())
    digest = F.sha2(lower_az(F.col("__text")), 256)
    rows = rows.select("doc_id", "n_bytes", F.monotonically_increasing_id().alias("__place"), "__survives", (digest if digest_all else F.when(F.col("__survives"), digest)).alias("text_sha256"))

    groups = rows.where("__survives").groupBy(F.col("text_sha256").alias("__sha")).agg(F.max("doc_id").alias("__keep"), F.count("*").alias("__size")).where("__size > 1")
    groups = checkpoint(groups)
    hot_from = max(1000, n_rows // 256)
    hot = groups.where(F.col("__size") >= hot_from).select(F.col("__sha").alias("__hot_sha"), F.col("__keep").alias("__hot_keep"), F.col("__size").alias("__hot_size"))
    cold = groups.where(F.col("__size") < hot_from)
    rows = rows.withColumn("__look", F.when(F.col("__survives"), F.col("text_sha256")))
    rows = rows.join(F.broadcast(hot), F.col("__look") == F.col("__hot_sha"), "left")
    # Rows without a group, and those of hot groups, have a key of their own; for null ids it is the row's place in its partition.
    own = F.concat(F.lit("row "), F.coalesce(F.col("doc_id").cast("string"), F.col("__place").cast("string")))
    rows = rows.withColumn("__look", F.when(F.col("__look").isNull() | F.col("__hot_sha").isNotNull(), own).otherwise(F.col("__look")))
    rows = rows.join(cold, F.col("__look") == F.col("__sha"), "left")
    size = F.coalesce("__hot_size", "__size", F.lit(1)).cast("long")
    keep = F.when(size > 1, F.coalesce("__hot_keep", "__keep")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_bytes", "text_sha256", keep.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, in its own columns.

    Rows that repeat id and text are reduced to one as well.  A row is named by its id and the hash of its
    text, so a null id drops nothing else."""
    found = checkpoint(exact_dedup(docs, id_col, text_col).where("group_size > 1"))
    sha = F.sha2(lower_az(named(text_col)), 256)
    out = without(docs, found.where("not kept").select("doc_id", "text_sha256").distinct(), [(named(id_col), "doc_id"), (sha, "text_sha256")])
    again = checkpoint(found.where("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "text_sha256"))
    if again.isEmpty():
        return out
    own, of, whose = (fresh(out, c) for c in ("__sha", "__id", "__key"))
    marked = out.withColumn(own, sha)
    key = again.select(F.col("doc_id").alias(of), F.col("text_sha256").alias(whose))
    same = named(id_col).eqNullSafe(F.col(of)) & (F.col(own) == F.col(whose))
    return marked.join(key, same, "left_anti").unionByName(marked.join(key, same, "left_semi").dropDuplicates([id_col, own])).drop(own)
