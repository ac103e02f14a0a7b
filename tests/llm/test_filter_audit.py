"""The filter audit against plain rules applied order by order."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from folioflow.llm import filter_audit as A

from .conftest import COLUMNS

LABELS = "doc_id long, quality int, toxic int"
MANY = " ".join(f"word{i}" for i in range(250))


def failed(text, copy):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    capitals = sum("A" <= c <= "Z" for c in text)
    return {f for f, bad in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 3 * len(text), bool(re.search("[#$%&*|]", text)), copy), strict=True) if bad}


def plain(docs, labels):
    """Each order walked through document by document."""
    docs = [(i, text or "", lang or "") for i, text, lang in docs]
    seen = {}
    for i, text, _ in docs:
        if i is not None:
            seen[text] = min(i, seen.get(text, i))
    fails = [failed(t, i is not None and i > seen[t]) for i, t, _ in docs]
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, x in labels if x == 1} - {None}  # a row without an id has no labels
    out = {}
    for part in {p for _, _, p in docs}:
        own = [k for k, d in enumerate(docs) if d[2] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in fails[k]]
                left = [k for k in left if f not in fails[k]]
                total[f] += len(gone)
                bad = [k for k in own if f in fails[k]]
                out[part, "".join(order), step] = (len(left), len(gone), len(bad) - len(gone), sum(fails[k] == {f} for k in own), sum(docs[k][0] in good for k in gone), sum(docs[k][0] in toxic for k in gone))
        for (p, order, step), row in list(out.items()):
            if p == part:
                out[p, order, step] = (*row, total[order[step - 1]])
    return out


def told(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in df.collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 0, 1), (3, None, 1), (4, 1, None), (9, 1, 1), (11, 0, 0), (None, 1, 1), (77, 1, 1)], LABELS)


def test_equals_a_walk_through_every_order(spark, odd, clashing, labels):
    own = [tuple(r) for r in labels.collect()]
    for docs in (odd, clashing):
        rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.select("doc_id", "text", "lang").collect()]
        got = told(A.audit(docs, labels))
        assert got == plain(rows, own) and len(got) == 1200


def test_limits_of_each_filter(spark):
    texts = [
        MANY, MANY.rsplit(" ", 51)[0], MANY.rsplit(" ", 50)[0], "a b " * 50 + " ".join(f"w{i}" for i in range(98)) + " w0 w1", " ".join(f"w{i}" for i in range(100)) + " w0" * 100, " ".join(f"w{i}" for i in range(100)) + " w0" * 101,
        "A" * 3 + "é" * 97, "A" * 4 + "é" * 96, "Ä" * 50, MANY + "|", "no\x0bbreak\x0cat\x1call\xa0here", "\x0b \r\n", "Word word WORD", "x" * 300_000, "ab " * 200_000,
    ]
    docs = [(i, t, ["en", None, ""][i % 3]) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in docs], COLUMNS)
    assert told(A.audit(df, spark.createDataFrame([], LABELS))) == plain(docs, [])


def test_repeated_rows_count_each(spark, labels):
    docs = [(5, MANY, "en"), (5, MANY, "en"), (6, MANY, "en"), (6, MANY, "de"), (None, MANY, "en"), (None, MANY, "en"), (4, "x", "en"), (4, "y", None)]
    df = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in docs], COLUMNS)
    assert told(A.audit(df, labels)) == plain(docs, [tuple(r) for r in labels.collect()])


def test_empty_tables(spark, empty, labels):
    assert A.audit(empty, labels).count() == 0
    assert [f"{n} {t}" for n, t in A.audit(empty, labels).dtypes] == ["part string", "filter_order string", "step int", *[f"{c} bigint" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]]


def test_sums_are_the_transform_of_the_cells(spark, odd, labels):
    found = A.spectrum(A.masked(odd, labels)).withColumn("cells", A.cells(F.col("sums"))).collect()
    assert {r["label"] for r in found} == set(A.LABELS)
    for r in found:
        n = r["cells"]
        assert min(n) >= 0 and sum(n) == r["sums"][0]
        assert r["sums"] == [sum(x * (-1) ** bin(m & s).count("1") for m, x in enumerate(n)) for s in range(A.MASKS)]
    effects = {(r["part"], r["label"], r["filters"]): r["effect"] for r in A.interactions(A.spectrum(A.masked(odd, labels))).collect()}
    assert effects["en", "all", ""] == 1.0 and -1 <= effects["en", "all", "AE"] <= 1
