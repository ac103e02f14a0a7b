"""Near-duplicate embeddings against all pairs by NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import embedding_dedup as E

TABLE = "vec_id long, embedding array<float>, label int"


def plain(rows, similarity=0.93):
    """{row number: (n_links, component_id)} of (vec_id, vector, label) rows."""
    good = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    n, reach = [0] * len(rows), list(range(len(rows)))
    find = lambda i: i if reach[i] == i else find(reach[i])
    for size, label in {(len(rows[i][1]), rows[i][2]) for i in good}:
        own = [i for i in good if len(rows[i][1]) == size and rows[i][2] == label]
        x = np.array([np.float32(rows[i][1]) for i in own], dtype=float)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= similarity, 1)), strict=True):
            n[own[a]], n[own[b]] = n[own[a]] + 1, n[own[b]] + 1
            reach[find(own[b])] = find(own[a])
    least = {}
    for i, (vec, _, _) in enumerate(rows):
        if vec is not None:
            least[find(i)] = min(vec, least.get(find(i), vec))
    return sorted(((rows[i][0], n[i], least.get(find(i))) for i in range(len(rows))), key=repr)


def told(df):
    rows = df.collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in rows), key=repr)


def noisy(r, centre, n, noise):
    return centre + noise * r.normal(size=(n, len(centre)))


@pytest.fixture(scope="module")
def rows():
    """Random vectors, groups of near copies, a group of 300 in one label, exact copies, a chain, and vectors that link with nothing."""
    r = np.random.default_rng(4)
    d = 24
    parts = [r.normal(size=(250, d))] + [noisy(r, c, 6, 0.1) for c in r.normal(size=(12, d))] + [noisy(r, r.normal(size=d), 300, 0.08)] + [np.repeat(r.normal(size=(1, d)), 90, 0), np.repeat(r.normal(size=(1, d)) * 1e-30, 9, 0)]
    a, b = r.normal(size=(2, d))
    parts.append(np.array([a * math.cos(t) + b * math.sin(t) for t in np.linspace(0, 1.5, 40)]) * 5)
    x = np.concatenate(parts).astype("float32")
    label = [int(v) for v in r.integers(0, 3, len(x))]
    label[322:] = [1] * (len(x) - 322)
    out = [(i, v.tolist(), lab) for i, (v, lab) in enumerate(zip(x, label, strict=True))]
    odd = [[0.0] * d, None, [], [float("nan")] * d, [None, *[1.0] * (d - 1)], [float("inf")] * d, [1.0, 2.0], [1.0, 2.0], [*x[0].tolist(), 0.0]]
    out += [(5000 + i, v, 1) for i, v in enumerate(odd)] + [(6000, x[5].tolist(), None), (6001, x[5].tolist(), None), (None, x[330].tolist(), 1), (330, x[330].tolist(), 1), (3, x[3].tolist(), label[3])]
    return out


@pytest.mark.parametrize("options, tile", [({}, 512), ({"n_cells": 12}, 40), ({"n_cells": 5, "probes": 5}, 30)])
def test_equals_all_pairs(spark, rows, monkeypatch, options, tile):
    monkeypatch.setattr(E, "TILE", tile)
    monkeypatch.setattr(E, "VISITORS", 3 * tile)
    df = spark.createDataFrame(rows, TABLE).repartition(3)
    assert told(E.embedding_dedup(df, **options)) == plain(rows)


def test_pivots_take_the_dense_groups(rows):
    x = np.array([v for _, v, label in rows[322:622] if v])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = np.random.default_rng(8).normal(size=(100, x.shape[1]))
    found = E.pivots_of(np.concatenate([r / np.linalg.norm(r, axis=1, keepdims=True), x]), 0.93)
    assert len(found) == 1 and (x @ found[0] >= math.sqrt(1.93 / 2)).mean() > 0.9


def test_recall_where_cells_are_many(spark):
    """Pairs at the very threshold, in more cells than a vector visits: at least 0.9 are found (0.97 and more here)."""
    r = np.random.default_rng(6)
    d = 32
    a = r.normal(size=(1500, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.normal(size=a.shape)
    b -= (b * a).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    x = np.concatenate([a, 0.931 * a + math.sqrt(1 - 0.931**2) * b])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = E.embedding_dedup(df, n_cells=48).agg(F.sum("n_links")).first()[0]
    assert 0.97 * 3000 <= got <= 3000


def test_names_and_empty_tables(spark, rows):
    df = spark.createDataFrame(rows[300:420], TABLE)
    clash = df.select(F.col("vec_id").alias("a.b"), F.col("embedding").alias("node"), F.col("label").alias("unit"), *[F.lit(1).alias(c) for c in ("vector", "label", "vec_id", "component", "n_links", "visitor", "tight", "list")])
    assert told(E.embedding_dedup(clash, "a.b", "node", "unit")) == plain(rows[300:420])
    none = spark.createDataFrame([], TABLE)
    assert E.embedding_dedup(none).count() == 0
    assert told(E.embedding_dedup(spark.createDataFrame([(2, None, 1), (3, [0.0], 1), (4, [1.0], None)], TABLE))) == [(2, 0, 2), (3, 0, 3), (4, 0, 4)]
    assert E.embedding_dedup(none).dtypes == E.embedding_dedup(df).dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
