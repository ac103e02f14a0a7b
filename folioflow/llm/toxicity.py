"""Toxicity by a factorization machine over hashed terms.

Terms are words and word beginnings (4 to 6 bytes), so that inflected forms share a term; a text has a
term or not, whatever its length.  The machine adds a weight for each term and, for each pair of terms,
the product of two short learned vectors: an insult beside a group's name can count where neither does.

Fitting uses a bounded sample: at most `sample` labelled rows (a third of them toxic at most), taken in
the order of a hash of doc_id.  Terms are chosen by a two-sample test on that sample, at most `terms`.
One task fits (the sample bounds it) on four fifths of the sample; the last fifth sets where the odds are even.
The model is a few hundred kilobytes.  Scoring reads every row.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import fresh, named, own_columns

PREFIXES = (4, 5, 6)
GATE_BITS = 22
RANK = 6


@dataclass
class Model:
    terms: np.ndarray  # uint32, sorted
    linear: np.ndarray
    factors: np.ndarray
    bias: float


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct 32-bit terms, where each text's terms begin), sorted within a text."""
    low = W.LOWER[data]
    starts, ends, at = W.spans(low, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(at)) << np.uint64(32)
    keys = [doc | (W.hashes(low, starts, ends) >> np.uint64(32))]
    for n in PREFIXES:
        longer = np.flatnonzero(ends - starts > n)
        keys.append(doc[longer] | (W.mix(W.hashes(low, starts[longer], starts[longer] + n) + np.uint64(n)) >> np.uint64(32)))
    key = np.concatenate(keys)
    key.sort()
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    return key.astype(np.uint32), np.searchsorted(key, np.arange(len(offsets), dtype=np.uint64) << np.uint64(32))


def choose(doc: np.ndarray, term: np.ndarray, y: np.ndarray, most: int, least_docs: int = 3, z: float = 3.5) -> np.ndarray:
    """Terms whose share of toxic rows differs from that of others by z standard errors; the strongest `most`."""
    ids, inverse, n = np.unique(term, return_inverse=True, return_counts=True)
    positive = np.bincount(inverse, weights=y[doc], minlength=len(ids))
    n1, n0 = y.sum(), len(y) - y.sum()
    share = n / len(y)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / max(n1, 1) + 1 / max(n0, 1)))
    strength = np.abs(positive / max(n1, 1) - (n - positive) / max(n0, 1)) / spread
    good = np.flatnonzero((n >= least_docs) & (strength >= z))
    return np.sort(ids[good[np.lexsort((ids[good], -strength[good]))][:most]])


def fit_machine(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, most: int, rank: int = RANK, rounds: int = 150, rate: float = 0.05, shrink: float = 1e-4) -> Model:
    """Full-batch Adam on the weighted logistic loss; the same sample gives the same model."""
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    term = np.concatenate([*rows, np.zeros(0, np.uint32)])
    prior = float(np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    ids = choose(doc, term, y, most) if 0 < y.sum() < len(y) else np.zeros(0, np.uint32)
    bias = float(np.log(prior / (1 - prior)))
    linear, factors = np.zeros(len(ids)), np.random.default_rng(7).normal(0, 0.01, (len(ids), rank))
    if not len(ids):
        return Model(ids, linear.astype(np.float32), factors.astype(np.float32), bias)
    at = np.minimum(np.searchsorted(ids, term), len(ids) - 1)
    hit = np.flatnonzero(ids[at] == term)
    doc, col, n = doc[hit], at[hit], len(rows)
    order = np.argsort(col, kind="stable")
    cols, docs_by_col = col[order], doc[order]
    col_at = np.searchsorted(cols, np.arange(len(ids)))
    doc_at = np.searchsorted(doc, np.arange(n + 1))
    by_doc = lambda x: np.diff(np.concatenate((np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)))[doc_at], axis=0)
    params = [np.array([bias]), linear, factors]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    total = weight.sum()
    for step in range(1, rounds + 1):
        b, w, v = params
        sums = by_doc(v[col])
        margin = b[0] + by_doc(w[col]) + 0.5 * ((sums**2).sum(1) - by_doc((v[col] ** 2).sum(1)))
        error = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / total
        at_col = error[docs_by_col]
        gw = np.add.reduceat(at_col, col_at)
        gv = np.add.reduceat(at_col[:, None] * (sums[docs_by_col] - v[cols]), col_at, axis=0)
        for i, g in enumerate((np.array([error.sum()]), gw + shrink * w, gv + 10 * shrink * v)):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            params[i] = params[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Model(ids, params[1].astype(np.float32), params[2].astype(np.float32), float(params[0][0]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 12_000, terms: int = 20_000, rank: int = RANK) -> Model:
    """labels: (id, 0/1).  Rows with a null id or label are not used; of repeated labels of an id the largest counts.

    rank: the length of the terms' vectors; 0 leaves a linear model.  Without rows of both labels the model is a constant."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64(F.col("id").cast("string")), F.col("id")]
    bounds = {1: sample // 3, 0: sample - sample // 3}
    chosen = known.where("y = 1").orderBy(*order).limit(bounds[1]).unionByName(known.where("y = 0").orderBy(*order).limit(bounds[0]))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("id", "text", "y")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in W.blocks(batch.column("text")):
                found, at = terms_of(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), batch.column("y").slice(lo, hi - lo), pa.array([found[at[i] : at[i + 1]].tobytes() for i in range(hi - lo)], pa.binary())], ["id", "y", "terms"])

    weights = {y: counts.get(y, 0) / max(1, min(counts.get(y, 0), bounds[y])) for y in (0, 1)}

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ys, rows = [], [], []
        for batch in batches:
            ids += [str(x) for x in batch.column("id").to_pylist()]
            ys += batch.column("y").to_pylist()
            rows += [np.frombuffer(x, np.uint32) for x in batch.column("terms").to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (zlib.crc32(ids[i].encode()), ids[i], rows[i].tobytes()))
        y = np.array([ys[i] for i in order], dtype=np.float64)
        model = calibrated([rows[i] for i in order], y, np.where(y == 1, weights[1], weights[0]), terms, rank)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model.__dict__)], pa.binary())], ["model"])

    id_type = docs.schema[id_col].dataType.simpleString()
    found = texts.mapInArrow(W.lean(featurise), f"id {id_type}, y int, terms binary").repartition(1).mapInArrow(W.lean(train), "model binary").first()
    return Model(**pickle.loads(found[0])) if found else calibrated([], np.zeros(0), np.zeros(0), terms, rank)  # without rows there may be no task


def margins(model: Model, term: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """The log odds of n texts, from (term, text) pairs."""
    near = np.minimum(np.searchsorted(model.terms, term), max(len(model.terms) - 1, 0))
    good = np.flatnonzero(model.terms[near] == term) if len(model.terms) else np.zeros(0, np.int64)
    near, doc = near[good], doc[good]
    out = model.bias + np.bincount(doc, weights=model.linear[near], minlength=n)
    for k in range(model.factors.shape[1]):
        v = model.factors[near, k].astype(np.float64)
        out = out + 0.5 * (np.bincount(doc, weights=v, minlength=n) ** 2 - np.bincount(doc, weights=v * v, minlength=n))
    return out


def probabilities(model: Model, data: np.ndarray, offsets: np.ndarray, gate: np.ndarray) -> np.ndarray:
    found, at = terms_of(data, offsets)
    hit = np.flatnonzero(gate[found >> np.uint32(32 - GATE_BITS)])
    margin = margins(model, found[hit], np.searchsorted(at, hit, "right") - 1, len(offsets) - 1)
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def calibrated(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, most: int, rank: int = RANK, least: int = 20) -> Model:
    """Every fifth row sets where the odds are even; the others are learnt from.  With under `least` toxic or other rows in that fifth, all are learnt from."""
    fifth = np.arange(len(y)) % 5 == 4
    n1, n0 = y[fifth].sum(), (1 - y[fifth]).sum()
    if min(n1, n0) < least:
        return fit_machine(rows, y, weight, most, rank)
    learn, rest = np.flatnonzero(~fifth), np.flatnonzero(fifth)
    model = fit_machine([rows[i] for i in learn], y[learn], weight[learn], most, rank)
    seen = [rows[i] for i in rest]
    margin = margins(model, np.concatenate(seen), np.repeat(np.arange(len(rest)), [len(r) for r in seen]), len(rest))
    order = np.argsort(margin, kind="stable")
    margin, own, w = margin[order], y[rest][order], weight[rest][order]
    # Cutting before row i makes the rows up to it not toxic; the widest gap of the best cuts is halved.
    wrong = np.concatenate(([0], np.cumsum(w * own))) + np.concatenate((np.cumsum((w * (1 - own))[::-1])[::-1], [0]))
    best = np.flatnonzero(wrong[1:-1] <= wrong[1:-1].min() + 1e-9) + 1
    at = best[np.argmax(margin[best] - margin[best - 1])]
    model.bias -= float((margin[at] + margin[at - 1]) / 2)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """docs, every row, with a column score_col (0 to 1) in place of any of that name.

    A null or empty text scores as a text without terms.  Rows are scored alone, so repeated rows score alike."""
    names = [c for c in docs.columns if c != score_col]
    rows = docs.select(*[named(c).alias(f"c{i}") for i, c in enumerate(names)])  # names with dots can't be asked of a frame
    schema = T.StructType([*docs.select(*[named(c) for c in names]).schema.fields, T.StructField(score_col, T.DoubleType())])
    position = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate = np.zeros(1 << GATE_BITS, dtype=bool)
        gate[model.terms >> np.uint32(32 - GATE_BITS)] = True
        for batch in batches:
            for lo, hi, data, offsets in W.blocks(batch.column(position)):
                out = probabilities(model, data, offsets, gate)
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in batch.columns], pa.array(out)], [*names, score_col])

    return rows.mapInArrow(W.lean(run), schema)


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """docs, in its own columns, less the rows that score `threshold` or more."""
    mark = fresh(docs, "__toxicity_score")
    scored = score(docs, fit(docs, labels, id_col, text_col, **options), text_col, mark)
    return scored.where(F.col(mark) < threshold).select(*own_columns(docs))


def held_out(id_col: str = "doc_id"):
    """Rows that are never learnt from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))
