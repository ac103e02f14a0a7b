import re

import pytest

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(low(text))


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"

PARTS = [
    "the quick brown fox jumps over the lazy dog and runs into the deep dark forest where nobody has ever been before now",
    "pack my box with five dozen liquor jugs while the band plays on and the crowd goes home in the rain of the evening",
    "sphinx of black quartz judge my vow said the old man to the young girl who had come from the village by the sea",
    "how vexingly quick daft zebras jump said nobody in particular on a warm summer day in the middle of the long year",
]

ODD = [
    (1, PARTS[0]), (2, PARTS[0].upper()), (3, PARTS[1] + " " + PARTS[2]), (4, PARTS[1] + " " + PARTS[2] + " end"), (5, None), (6, ""), (7, "a"), (8, "one two"),
    (9, PARTS[3] + "\n" + PARTS[0] + "\n" + PARTS[1]), (10, "é" * 300), (11, PARTS[0]), (12, "one two"), (13, " \n\t "), (14, "ab " * 3000), (15, PARTS[2] + " Licensed under CC BY-NC 4.0. All rights reserved. "),
    (16, PARTS[2].replace("old", "new")), (17, "x" * 5000), (18, PARTS[3] * 3), (19, "日本語 テキスト " * 40),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empties, long texts, ties and copies."""
    rows = [(i, t, None if i % 3 else "en", "src", None) for i, t in ODD]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def clashing(odd):
    """Repeated rows, repeated and null ids, and columns named like the operators' own."""
    from pyspark.sql import functions as F

    more = odd.where("doc_id in (1, 3, 14)").unionByName(odd.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(odd.where("doc_id = 9").withColumn("doc_id", F.lit(3).cast("long")))
    both = odd.unionByName(more)
    for name in ("kept", "score", "slot", "shard", "bucket", "size", "sid", "toxicity", "__class", "__text", "node", "runs", "n_words", "label", "__at", "__slot", "__shard", "__sha", "__id", "__row_name", "__toxicity_score", "__drop_0", "a.b", "size"):
        both = both.withColumn(name, F.lit(7))
    return both
