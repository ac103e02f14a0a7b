"""Work on Arrow batches goes by parts of a bounded size."""

import random

import numpy as np
import pyarrow as pa
import pytest

from folioflow.functions import batches as B
from folioflow.functions import text as X
from folioflow.operators import bm25, postings, vector


@pytest.mark.parametrize("column", [pa.array(["x" * 700, None, "", "y" * 5000, *["z" * 300] * 40]), pa.array([["a"] * 700, None, [], ["b"] * 5000, *[["c"] * 300] * 40])])
def test_parts_are_bounded_and_whole(column):
    batch = pa.RecordBatch.from_arrays([column, pa.array(range(len(column)))], ["x", "n"])
    found = list(B.parts(iter([batch, batch.slice(0, 0), batch.slice(7)]), 0, 1000))
    assert pa.Table.from_batches(found).to_pydict() == pa.Table.from_batches([batch, batch.slice(7)]).to_pydict()
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column(0).to_pylist()) <= 1000 for p in found) and max(p.num_rows for p in found) > 1


def test_normalising_yields_parts():
    texts = ["ﬁ" * 1000, None, ""] * 2000
    found = list(X.nfkc.func(iter([pa.array(texts), pa.array(texts[:1])])))
    assert pa.chunked_array(found).to_pylist() == [*["fi" * 1000, None, ""] * 2000, "fi" * 1000]
    assert len(found) > 5 and max(len(p) for p in found) <= 1100


def test_joined_tokens_are_split_as_they_were():
    random.seed(1)
    for _ in range(50):
        texts = pa.array([" ".join(random.choice(["a", "bb", "é", "日本"]) for _ in range(random.randrange(4))) for _ in range(9)])
        texts = texts.slice(random.randrange(9), 5)
        assert B.split_tokens(texts).to_pylist() == [t.split() for t in texts.to_pylist()]
        assert bm25.terms_of(B.split_tokens(texts), True)[0].tolist() == [i for i, t in enumerate(texts.to_pylist()) for _ in t.split()]


def test_blocks_of_a_shard_go_by_terms_in_parts():
    r = random.Random(4)
    texts = pa.array([" ".join(r.choice("abcdefgh") for _ in range(r.randrange(30))) for _ in range(40)])
    local = np.arange(5, 45)
    held = lambda: [postings.Tokens.of(local[k : k + 9], B.split_tokens(texts.slice(k, 9)), False) for k in range(0, 40, 9)]
    whole = list(postings.shard_blocks(3, local, held(), 8, 1 << 20))
    found = list(postings.shard_blocks(3, local, held(), 8, 50))
    assert len(whole) == 1 and len(found) > 4
    assert pa.Table.from_batches(found).to_pylist() == whole[0].to_pylist()
    for row in postings.opened([b.append_column("seq", pa.array([1] * b.num_rows)) for b in found]):
        for term, number, dl, positions in zip(*(row.column(c).to_pylist() for c in ("term", "number", "dl", "positions")), strict=True):
            words = texts[(number & (postings.SHARD - 1)) - 5].as_py().split()
            assert dl == len(words) and positions == [i for i, w in enumerate(words) if w == term]


def test_products_are_held_in_small_parts(monkeypatch):
    r = np.random.default_rng(3)
    asked, have, ids, names = r.normal(size=(9, 4)), r.normal(size=(50, 4)), pa.array(r.permutation(50)), pa.array(range(9))
    whole = pa.Table.from_batches(vector.compared(asked, names, have, ids, 5, "id", 6))
    assert 8 * vector.COMPARED <= 4 << 20
    monkeypatch.setattr(vector, "COMPARED", 100)
    found = list(vector.compared(asked, names, have, ids, 5, "id", 6))
    assert len(found) == 5 and pa.Table.from_batches(found).equals(whole.combine_chunks())
