"""How filters of a cleaning chain interact, by Walsh-Hadamard sums.

1. One pass over the texts gives each document a mask: a bit for each filter that it fails.  Filters that look at
   the text alone are columns; the copy filter counts texts by their SHA-256 (copies combine on the map side, so a
   text that holds a third of all rows is a row for each task).
2. For each part and label the 32 signed parity sums are added up: the sum over documents of
   (-1) ** (number of failed filters among those of s), for every set s of filters.
3. The transform is its own inverse but for the factor 32, so the sums give back the number of documents of each
   mask exactly.  Every order of the filters, every step of it and every filter's Shapley value follow from these 32
   numbers: a document that fails f filters is removed by each of them in 120 / f of the 120 orders.

What is shuffled is a narrow row for each distinct (document, text), never a text.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, named

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
COPY = 1 << FILTERS.index("E")
LABELS = ("all", "good", "toxic")
SPACE = " \t\n\x0b\f\r"


def text_masks(rows: DataFrame, text: str, *kept: str) -> DataFrame:
    """rows' columns `kept` and mask: the bits of the filters A to D of a text that isn't null.

    Words and their numbers are columns of their own, so that each is worked out once."""
    cut = rows.withColumn("__inner", F.btrim(text, F.lit(SPACE))).withColumn("__words", F.split("__inner", "[ \\t\\n\\x0B\\f\\r]+"))
    empty = (F.col("__inner") == "").cast("long")  # is split into one empty word
    counts = cut.select(
        *kept, (F.size("__words") - empty).alias("__n"), (F.size(F.array_distinct("__words")) - empty).alias("__distinct"), F.char_length(text).cast("long").alias("__chars"),
        F.octet_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long").alias("__capitals"), F.col(text).rlike("[#$%&*|]").alias("__signs"),
    )
    n, distinct, chars, capitals, signs = (F.col(f"__{c}") for c in ("n", "distinct", "chars", "capitals", "signs"))
    fails = (n < 200, distinct * 100 < n * 50, capitals * 100 > chars * 3, signs)
    return counts.select(*kept, sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0)).cast("int").alias("mask"))


def sign(mask: Column, s: int) -> Column:
    """1 or -1: the parity of the failed filters among those of s."""
    return (1 - 2 * (F.bit_count(mask.bitwiseAND(F.lit(s))) % 2)).cast("long")


def masked(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of a part and of labels fail just the filters of a mask; several rows may add up to a cell.

    A null text is empty, a null part the empty string.  A text is a copy where an equal text has a smaller id; rows
    that repeat an id aren't copies of each other; rows without an id have no place in that order, so they neither
    are nor make copies, and have no labels.  Of several label rows of an id each mark counts that any of them has."""
    text = F.coalesce(named(text_col), F.lit(""))
    whole = docs.select(named(id_col).alias("id"), F.coalesce(named(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), text.alias("text"))
    rows = checkpoint(text_masks(whole, "text", "id", "part", "sha"))
    nameless = rows.where("id is null").groupBy("part", "mask").agg(F.count("*").alias("n")).select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "n")
    marks = labels.where("quality = 1 or toxic = 1").groupBy(F.col("doc_id").alias("id")).agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
    counted = rows.where("id is not null").groupBy("id", "sha", "part", "mask").agg(F.count("*").alias("n"))  # a repeated row is one row from here on
    marked = counted.join(marks, "id", "left").fillna(0, ["good", "toxic"])
    kinds = ["sha", "part", "mask", "good", "toxic"]
    alike = marked.groupBy(*kinds).agg(F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", "id").alias("n_least"))
    # Of a text there is a row for each part and labels at most; those of the smallest id are no copies.
    first = alike.groupBy("sha").agg(F.min("least").alias("first"))
    split = F.array(F.struct("mask", F.col("fresh").alias("n")), F.struct((F.col("mask") + COPY).alias("mask"), (F.col("n") - F.col("fresh")).alias("n")))
    told = alike.join(first, "sha").withColumn("fresh", F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0))
    named_rows = told.select("part", "good", "toxic", F.explode(split).alias("cell")).select("part", "cell.mask", "good", "toxic", "cell.n").where("n > 0")
    return named_rows.unionByName(nameless)


def spectrum(masks: DataFrame) -> DataFrame:
    """(part, label, sums): the 32 signed parity sums of each part and label of `masked` rows."""
    own = F.array(F.lit("all"), *[F.when(F.col(label) == 1, F.lit(label)) for label in LABELS[1:]])
    rows = masks.select("part", "mask", "n", F.explode(F.array_compact(own)).alias("label"))
    sums = rows.groupBy("part", "label").agg(*[F.sum(sign(F.col("mask"), s) * F.col("n")).alias(f"w{s}") for s in range(MASKS)])
    return sums.select("part", "label", F.array(*[f"w{s}" for s in range(MASKS)]).alias("sums"))


def cells(sums: Column) -> Column:
    """The number of documents of each mask, from the parity sums."""
    every = F.sequence(F.lit(0), F.lit(MASKS - 1))
    signed = lambda m: lambda total, s: total + (1 - 2 * (F.bit_count(m.bitwiseAND(s)) % 2)).cast("long") * F.get(sums, s)
    return F.transform(every, lambda m: (F.aggregate(every, F.lit(0).cast("long"), signed(m)) / MASKS).cast("long"))


def interactions(found: DataFrame) -> DataFrame:
    """(part, label, filters, effect): of each set of filters the mean of its signs, from 1 (none of them ever fails) down to -1."""
    rows = found.select("part", "label", (F.col("sums")[0]).alias("n"), F.posexplode("sums").alias("s", "sum"))
    letters = F.concat(*[F.when(F.col("s").bitwiseAND(F.lit(1 << i)) > 0, F.lit(x)).otherwise("") for i, x in enumerate(FILTERS)])
    return rows.select("part", "label", letters.alias("filters"), (F.col("sum") / F.col("n")).alias("effect"))


def _total(of: Column, wanted) -> Column:
    masks = F.filter(F.sequence(F.lit(0), F.lit(MASKS - 1)), wanted)
    return F.aggregate(masks, F.lit(0).cast("long"), lambda total, m: total + F.get(of, m))


def orders(found: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, from the rows of `spectrum`."""
    empty = F.array(*[F.lit(0).cast("long")] * MASKS)
    one = found.groupBy("part").agg(*[F.max(F.when(F.col("label") == label, F.col("sums"))).alias(label) for label in LABELS])
    counts = one.select("part", *[cells(F.coalesce(label, empty)).alias(label) for label in LABELS])
    every = F.lit(["".join(p) for p in itertools.permutations(FILTERS)])
    rows = counts.withColumn("filter_order", F.explode(every)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = {x: F.instr("filter_order", x) for x in FILTERS}
    own = sum((F.when(place[x] == F.col("step"), 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0))
    before = sum((F.when(place[x] < F.col("step"), 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0))
    rows = rows.withColumn("own", own).withColumn("before", before)
    own, before, n = F.col("own"), F.col("before"), F.col("all")
    fails, gone = lambda m: m.bitwiseAND(own) > 0, lambda m: m.bitwiseAND(before) > 0
    here = lambda m: fails(m) & ~gone(m)
    n_orders = math.factorial(len(FILTERS))
    shares = F.transform(n, lambda x, m: F.when(m > 0, x * (n_orders / F.bit_count(m)).cast("long")).otherwise(0))
    return rows.select(
        "part", "filter_order", "step", _total(n, lambda m: ~fails(m) & ~gone(m)).alias("kept"), _total(n, here).alias("removed"), _total(n, lambda m: fails(m) & gone(m)).alias("redundant"),
        F.get(n, own).alias("unique_fails"), _total(F.col("good"), here).alias("good_lost"), _total(F.col("toxic"), here).alias("toxic_lost"), _total(shares, fails).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each part, each of the 120 orders of the filters A to E and each step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A: under 200 words.  B: fewer than half of the words are distinct.  C: over 3 % of the characters are capitals A-Z.
    D: one of # $ % & * | occurs.  E: an equal text has a smaller id.  kept: documents left after the step; removed:
    those that go in it; redundant: those that fail its filter and went before; unique_fails: those that fail it alone;
    good_lost, toxic_lost: removed ones labelled so; shapley: the removals of the step's filter summed over all orders.

    Null and empty texts have no words: they fail A and, but for the first, E.  Nulls elsewhere, repeated rows and ids
    are told of in `masked`.  An empty table gives an empty result; other columns are not looked at."""
    return orders(spectrum(masked(docs, labels, id_col, text_col, part_col)))
