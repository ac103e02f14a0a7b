"""The learned embedder against NumPy's singular values."""

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import latent
from folioflow.plans import queries

SF = "/root/testdata/sf0.001"


def dense(spark, df, features):
    tokens = df.select(X.index_tokens(F.col("text")).alias("t")).toArrow().column(0).combine_chunks()
    rows, columns, values = latent.entries(tokens, features)
    out = np.zeros((len(tokens), features))
    out[rows, columns] = values
    n_with = (out > 0).sum(0)
    out *= np.log((1 + len(tokens)) / (1 + n_with)) + 1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300), tokens


def test_singular_values_and_vectors(spark):
    df = spark.createDataFrame([(t,) for t in pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()[:120]] + [(None,), ("",)], "text string").repartition(3)
    full, tokens = dense(spark, df, 2048)
    u, s, vt = np.linalg.svd(full, full_matrices=False)
    model = latent.fit(df, dims=12, features=2048)
    assert np.allclose(model.values, s[:12], rtol=0.01) and model.vectors.shape == (2048, 12)
    assert np.allclose(model.vectors.T @ model.vectors, np.eye(12), atol=1e-8)
    assert np.linalg.norm(full @ model.vectors) ** 2 >= 0.99 * (s[:12] ** 2).sum()
    got = model.embed(tokens)
    expected = full @ model.vectors
    assert np.allclose(got, expected / np.maximum(np.linalg.norm(expected, axis=1, keepdims=True), 1e-300), atol=1e-5)


def test_embedder(spark, tmp_path):
    topics = ["river water fish boat swim", "court judge law trial jury"]
    r = np.random.default_rng(0)
    rows = [(i, " ".join(r.permutation(topics[i % 2].split())[:3])) for i in range(60)] + [(90, None), (91, ""), (92, "unknownword")]
    df = spark.createDataFrame(rows, "id int, text string").repartition(4)
    model = latent.fit(df, dims=2)
    model.save(spark, str(tmp_path / "m"))
    again = latent.LatentEmbedder(latent.Latent.load(spark, str(tmp_path / "m")))
    assert again.dims == 2
    got = {r["id"]: np.array(r["e"]) for r in df.select("id", again.passages(F.col("text")).alias("e")).collect()}
    q = np.array(spark.createDataFrame([("the judges and laws",)], "q string").select(again.queries(F.col("q")).alias("e")).first()["e"])
    assert min(got[i] @ q for i in range(1, 60, 2)) > 0.9 > 0.5 > max(got[i] @ q for i in range(0, 60, 2))
    assert not got[90].any() and not got[91].any() and all(abs(np.linalg.norm(got[i]) - 1) < 1e-5 for i in range(60))


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "text string")
    for df in (none, spark.createDataFrame([(None,), ("",)], "text string")):
        model = latent.fit(df, dims=3, features=64)
        assert not model.values.any() and not model.vectors.any()
        assert not latent.LatentEmbedder(model).model.embed(df.select(X.index_tokens(F.col("text")).alias("t")).toArrow().column(0).combine_chunks()).any()


def test_the_matrix_is_made_once_and_multiplied_in_slabs(spark):
    """Blocks of the texts hold the whole matrix; slabs of any block are bounded in rows and give its products."""
    texts = pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist() + [None, "", "one", "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1).sortWithinPartitions("id")
    full, tokens = dense(spark, df, 512)
    found, at = np.zeros_like(full), 0
    for n, row, feature, value in latent._blocks(df, "text", 512).collect():
        row, feature, value = np.frombuffer(row, np.int32), np.frombuffer(feature, np.int32), np.frombuffer(value)
        for first, have, part in latent.slabs(row, feature, value, n, 512):
            assert len(part) <= latent.SLAB_ROWS
            found[at + first : at + first + len(part), have] = part
        at += n
    rows, columns, values = latent.entries(tokens, 512)
    plain = np.zeros_like(full)
    plain[rows, columns] = values
    assert at == len(texts) > latent.SLAB_ROWS and np.array_equal(found, plain)


def test_every_text_counts(spark):
    """However many texts there are: each has a part in weights and singular values, and so has one that stands at the end alone."""
    n = 200_500
    texts = F.when(F.col("id") == n - 1, "omega zeta").otherwise(F.concat(F.lit("alpha beta"), (F.col("id") % 1009).cast("string")))
    features = 1 << 12
    model = latent.fit(spark.range(0, n, 1, 4).select(texts.alias("text")), dims=2, features=features, passes=2)
    feature = lambda word: zlib.crc32(word.encode()) % features
    df = np.zeros(features)
    for word, count in [("alpha", n - 1), ("omega", 1), ("zeta", 1), *((f"beta{i}", len(range(i, n - 1, 1009))) for i in range(1009))]:
        df[feature(word)] += count
    assert np.allclose(model.weights, np.log((1 + n) / (1 + df)) + 1, rtol=1e-12)


def test_packed_blocks_and_sums_in_a_tree(spark, monkeypatch):
    """What is kept of the texts is the matrix, also of counts over a byte; sums in a tree give the model that sums at the driver give."""
    texts = [None, "", "one", *sorted(pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()[:60], key=len), "many " * 300, "lots " * 70_000]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    plain, small = (latent._blocks(df, "text", 512, small=small).collect() for small in (False, True))
    assert len(plain) == len(small)
    for a, b in zip(plain, small, strict=True):
        found = latent.unpacked(*(pa.scalar(bytes(x), pa.binary()) for x in b[1:]), 512)
        full = []
        for row, feature, value in (found, [np.frombuffer(x, kind) for x, kind in zip(a[1:], (np.int32, np.int32, float), strict=True)]):
            full.append(np.zeros((a[0], 512)))
            full[-1][row, feature] = value
        # Rows of a block are sorted by length when they are kept.
        assert a[0] == b[0] and np.array_equal(*(x[np.lexsort(x.T)] for x in full))
    direct = latent.fit(df, dims=4, features=512)
    monkeypatch.setattr(latent, "SUM_BYTES", 0)
    tree = latent.fit(df, dims=4, features=512)
    assert np.array_equal(direct.weights, tree.weights) and np.allclose(direct.values, tree.values, rtol=1e-9)
    assert np.allclose(np.abs((direct.vectors * tree.vectors).sum(0)), 1, atol=1e-3)


def test_embedder_rates_and_search_learn_from_every_document(spark, tmp_path, monkeypatch):
    n, models = 200_500, []
    spark.range(0, n, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.lit("alpha beta"), (F.col("id") % 1009).cast("string")).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "alpha beta7")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    fit = latent.fit
    monkeypatch.setattr(latent, "fit", lambda texts: models.append(fit(texts, dims=2, features=1 << 12, passes=1)) or models[-1])
    for query in (queries.embedder_rates, queries.search_learned):
        query(spark, str(tmp_path))
    # The weight of a feature that no text has tells how many texts there were.
    assert [m.weights.max() for m in models] == pytest.approx([np.log(1 + n) + 1] * 2, rel=1e-12)
