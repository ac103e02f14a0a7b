"""All terms of a seed find its neighbours."""

import numpy as np

from folioflow.llm import packing


def test_a_document_that_shares_any_term_is_found():
    seed = np.arange(100, dtype=np.uint32)
    docs = [seed, *[np.array([t, 1000 + t], dtype=np.uint32) for t in range(100)], np.array([5000], dtype=np.uint32)]
    index, unused = packing.ShardIndex(docs), np.ones(len(docs), dtype=bool)
    unused[0], found = False, []
    while len(near := index.neighbours(0, unused)):
        found += near.tolist()
        unused[near] = False
    assert sorted(found) == list(range(1, 101))
