"""Exact dedup, n-gram Jaccard join and repeated strings against plain Python."""

import collections
import hashlib

import pytest

from folioflow.llm import exact_dedup, jaccard_join, repeats

from .conftest import ODD, low, words


def test_exact_groups(spark, odd):
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(odd, digest_all=True).collect()}
    groups = collections.defaultdict(list)
    for i, t in ODD:
        groups[low(t)].append(i)
    assert len(got) == len(ODD)
    for i, t in ODD:
        own = groups[low(t)]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(own), len(own), i == max(own))
        assert got[i]["text_sha256"] == hashlib.sha256(low(t).encode()).hexdigest()


@pytest.mark.parametrize("slot_bits", [1, 22])
def test_exact_hashes_survivors_only(odd, slot_bits):
    rows = exact_dedup.exact_dedup(odd, slot_bits=slot_bits).collect()
    assert all(r["text_sha256"] for r in rows if r["group_size"] > 1)
    if slot_bits == 22:
        assert all(r["text_sha256"] is None for r in rows if r["doc_id"] in (3, 17, 10))


def test_exact_hot_group(spark):
    rows = [(i, "Same text" if i % 3 == 0 else f"text {i}") for i in range(6000)]
    found = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).where("group_size > 1").collect()
    assert len(found) == 2000 and {r["keep_id"] for r in found} == {5997} and sum(r["kept"] for r in found) == 1


def test_exact_odd_tables(clashing, empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    rows = exact_dedup.exact_dedup(clashing).collect()
    assert len(rows) == clashing.count()
    kept = exact_dedup.keep_one_of_each(clashing)
    assert kept.columns == clashing.columns
    texts = [low(r["text"]) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({low(t) for _, t in ODD})


def exact_links(rows):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    parent, links, set_links = {i: i for i in sets}, collections.Counter(), collections.defaultdict(set)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                if sets[i] != sets[j]:
                    set_links[i].add(sets[j])
                    set_links[j].add(sets[i])
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (root(i), links[i], len(set_links[i])) for i in sets}


def test_jaccard_links_and_classes(odd):
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_set_links"]) for r in jaccard_join.jaccard_join(odd).collect()}
    assert got == exact_links(ODD)


def test_jaccard_large_group_in_tiles(spark, monkeypatch):
    """A chain of near copies, larger than a node and a tile may be."""
    for name, value in (("SMALL", 8), ("TILE", 16)):
        monkeypatch.setattr(jaccard_join, name, value)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        own = list(base)
        own[i % 40 * 3] = f"edit{i}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(f"z{i}x{j}" for j in range(50))) for i in range(20)]
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_set_links"]) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == exact_links(rows)


def test_jaccard_large_group_of_tight_and_loose_sets(spark, monkeypatch):
    """Near copies close to the first set, others farther off that link to some of them only, copies, and a null id; all larger than a tile."""
    for name, value in (("SMALL", 8), ("TILE", 16)):
        monkeypatch.setattr(jaccard_join, name, value)
    r = __import__("random").Random(8)
    base, rows = [f"w{i}" for i in range(200)], []
    for i in range(120):
        own = list(base)
        for k in r.sample(range(0, 200, 10), r.choice([0, 1, 1, 2, 3, 4, 6])):
            own[k] = f"edit{i % 50}x{k}"
        rows.append((i, " ".join(own)))
    rows += [(200 + i, rows[i * 3][1]) for i in range(15)] + [(300 + i, " ".join(f"z{i}x{j}" for j in range(50))) for i in range(20)]
    got = {x["doc_id"]: (x["class_id"], x["n_links"], x["n_set_links"]) for x in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == exact_links(rows)


def test_jaccard_recall_by_runs():
    assert jaccard_join.runs_needed(0.9) < jaccard_join.runs_needed(0.999) < 30


def test_jaccard_recall_near_the_threshold(spark, monkeypatch):
    """Pairs of a similarity just over 0.8 among unlike sets, with nodes that are split down to the last level."""
    monkeypatch.setattr(jaccard_join, "SMALL", 4)
    rows = []
    for i in range(400):
        base = [f"p{i}w{j}" for j in range(100)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join([*base[:90], *(f"q{i}w{j}" for j in range(10))]))]
    expected = exact_links(rows)
    got = {r["doc_id"]: r["class_id"] for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [i for i, (c, n, _) in expected.items() if n and c != i]
    assert len(linked) == 400 and sum(got[i] == expected[i][0] for i in linked) >= 0.99 * len(linked)


def test_jaccard_hot_node(spark):
    """A third of the rows are near copies of one text; null ids and empty texts beside them."""
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:55], f"x{i}"])) for i in range(1200)] + [(2000 + i, " ".join(f"u{i}v{j}" for j in range(12))) for i in range(2400)] + [(None, "")] * 50
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {r["class_size"] for r in got if r["doc_id"] is not None and r["doc_id"] < 1200} == {1200} and {r["n_links"] for r in got if r["doc_id"] is not None and r["doc_id"] < 1200} == {1199}
    assert {r["class_size"] for r in got if r["doc_id"] is None or r["doc_id"] >= 2000} == {1}


def test_jaccard_odd_tables(clashing, empty):
    assert jaccard_join.jaccard_join(empty).count() == 0
    assert jaccard_join.jaccard_join(clashing).count() == clashing.count()
    kept = jaccard_join.keep_one_of_each(clashing)
    assert kept.columns == clashing.columns
    texts = [r["text"] for r in kept.collect()]
    assert sum(t is not None and t.lower().startswith("the quick") for t in texts) == 1
    assert jaccard_join.keep_one_of_each(empty).count() == 0


def removed(rows, length=100):
    seen, out = {}, {}
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if data[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            else:
                seen[data[p : p + length]] = i
        spans = sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest())
    return out


def digest(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def test_repeats(odd):
    assert digest(repeats.remove_repeats(odd)) == removed(ODD)


def test_repeats_with_many_phrases_of_a_trigger(spark, monkeypatch):
    """One passage in texts that differ on both sides, more of them than a segment keeps together; small segments."""
    monkeypatch.setattr(repeats, "MANY", 3)
    monkeypatch.setattr(repeats, "SEGMENT_BYTES", 4000)
    passage = "a passage that very many documents share, word for word, and that is rather longer than a hundred bytes, so it goes. "
    rows = [(i, f"{i * 7919 % 1000:04d} head {i} " * (i % 7 + 1) + passage * (1 + i % 2) + f"tail {i * 31} " * (i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    # tasks are threads' children of this process only in part, so the constants are also given by the module's state there
    assert digest(repeats.remove_repeats(df)) == removed(rows)


def test_repeats_have_one_trigger_in_blocks_of_any_size(spark, monkeypatch):
    """The same stretches in short texts and beside a very long one, whose block is larger; many phrases of one trigger in all."""
    for name, value in (("CROWD", 5), ("PIECE_BYTES", 30_000)):
        monkeypatch.setattr(repeats, name, value)
    r = __import__("random").Random(1)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    shared = [" ".join(word() for _ in range(40)) for _ in range(12)]
    rows = [(i, " ".join([word(), r.choice(shared), word(), r.choice(shared)])) for i in range(60)]
    rows += [(100 + i, " ".join([*(word() for _ in range(60_000)), *shared])) for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert digest(repeats.remove_repeats(df)) == removed(rows)
    for length in (32, 70_000):
        with pytest.raises(ValueError):
            repeats.remove_repeats(df, length=length)


def test_repeats_odd_tables(spark, clashing, empty):
    assert repeats.remove_repeats(empty).count() == 0
    rows = repeats.remove_repeats(clashing).collect()
    assert len(rows) == clashing.count()
    same = [r for r in rows if r["doc_id"] == 1]
    assert len(same) == 2 and len({tuple(r) for r in same}) == 1
    text = spark.createDataFrame([("b", "x y " * 60), ("a", "x y " * 60)], "doc_id string, text string")
    assert {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(text).collect()} == {"a": 236, "b": 240}
