"""Whitening against NumPy over the whole table at once, and exact integers."""

import math
from fractions import Fraction

import numpy as np
import pytest

from folioflow.llm import queries as Q
from folioflow.llm import whitening as W

SF = "/root/testdata/sf0.001"
TABLE = "vec_id long, embedding array<float>, label int"


def plain(rows, components=4):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} of (vec_id, vector) rows, all of the same length."""
    good = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    x = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in good]
    fitted = np.array(sorted({tuple(v) for _, v in x}), dtype=float)
    n, s = len(fitted), [sum(int(r[k]) for r in fitted) for k in range(fitted.shape[1])]
    centred = fitted - fitted.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, v in x:
        deviation = sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True))
        for c in range(min(components, len(s))):
            out.append((i, c + 1, n, deviation, abs(float((np.array(v, float) - fitted.mean(0)) @ vectors[:, c])) / math.sqrt(values[c]), values[c] / values.sum()))
    return sorted(out)


def check(df, expected):
    got = sorted((r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"], r["identity_error"]) for r in df.collect())
    assert [g[:4] for g in got] == [e[:4] for e in expected]
    for g, e in zip(got, expected, strict=True):
        assert abs(g[4] - e[4]) < 1e-8 and abs(g[5] / e[5] - 1) < 1e-9 and 0 <= g[6] < 1e-9


def test_query_equals_numpy(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(Q.queries()["op12_whitening"](spark, SF), plain(rows))


def test_copies_count_once_and_broken_rows_go(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_ROWS", 7)
    r = np.random.default_rng(5)
    base = r.normal(size=(60, 6)) * [3, 1, 0.5, 0.2, 0.1, 0.05] + 2
    rows = [(i, v.tolist()) for i, v in enumerate(base.astype("float32"))] + [(100 + i, base[3].astype("float32").tolist()) for i in range(400)] + [(7, base[9].astype("float32").tolist()), (7, base[9].astype("float32").tolist())]
    broken = [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, [float("nan")] + [0.0] * 5), (904, [float("inf")] + [0.0] * 5), (905, [0.0] * 5), (906, [float("-inf")] * 6), (907, [1e30] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in [*rows, *broken]], TABLE).repartition(5)
    check(W.whiten(df), plain(rows))
    clashing = df.selectExpr("vec_id as id", "embedding as `v.x`", "vec_id as x", "label as n", "label as component", "label as whitened")
    check(W.whiten(clashing, "id", "v.x"), plain(rows))


def test_rows_without_an_id_are_reported(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (None, [0.0, 1.0], 1), (3, [2.0, 5.0], None)], TABLE)
    got = W.whiten(df).collect()
    assert sorted((str(r["vec_id"]), r["component"]) for r in got) == sorted([("None", 1), ("None", 2)] * 2 + [("3", 1), ("3", 2)])


def test_no_variance_and_empty_tables(spark):
    same = W.whiten(spark.createDataFrame([(i, [0.5, -0.25], 1) for i in range(3)], TABLE)).collect()
    assert len(same) == 6 and all(r["whitened"] is None and r["identity_error"] is None and r["explained"] is None and r["deviation"] == 0 and r["n"] == 1 for r in same)
    line = W.whiten(spark.createDataFrame([(i, [i / 1.0, 1.0], 1) for i in range(9)], TABLE)).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in line) and {r["explained"] for r in line} == {1.0, 0.0}
    none = W.whiten(spark.createDataFrame([(1, None, 1)], TABLE))
    assert none.count() == 0 and W.whiten(spark.createDataFrame([], TABLE)).dtypes == none.dtypes


def test_deviations_are_exact_at_any_size():
    r = np.random.default_rng(1)
    for n, most in ((50, 100), (10**9, 300), (3, 2**61)):
        rows = r.integers(-most, most, (20, 3))
        sums = [int(x) for x in r.integers(-most, most, 3)]
        sums = [s * n for s in sums]
        found = W.Whitening(n, sums, np.eye(3), np.ones(3), 3.0).deviations(rows).to_pylist()
        exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in rows.tolist()]
        assert found == [e if e < 2**63 else None for e in exact]


@pytest.mark.parametrize("cuts", [(1,), (3, 5, 8), (40,), tuple(range(1, 90, 2))])
def test_merging_equals_one_state(cuts):
    """Far from the origin, where sums of squares would lose everything."""
    rows = np.random.default_rng(2).integers(-40, 40, (90, 5)) + 10**8
    whole = W.State.of(rows)
    parts = [W.State.of(p) for p in np.split(rows, cuts)]
    while len(parts) > 1:
        parts = [parts[0].merged(parts[1]), *parts[2:]] if len(parts) % 2 else [a.merged(b) for a, b in zip(parts[::2], parts[1::2], strict=True)]
    exact = [[Fraction(0)] * 5 for _ in range(5)]
    means = [Fraction(s, 90) for s in whole.sums]
    for row in rows.tolist():
        d = [v - m for v, m in zip(row, means, strict=True)]
        exact = [[exact[i][j] + d[i] * d[j] for j in range(5)] for i in range(5)]
    assert parts[0].n == 90 and parts[0].sums == whole.sums == [int(s) for s in rows.sum(0)]
    for state in (whole, parts[0]):
        assert np.allclose(state.scatter, np.array([[float(v) for v in r] for r in exact]), rtol=1e-9, atol=1e-4)
