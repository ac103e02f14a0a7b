"""The other operators against plain Python, exact round trips or held-out accuracy."""

import collections
import math
import random
import zlib

import numpy as np
import pytest

from folioflow.llm import decontaminate, language_model, license_scan, packing, sharding, toxicity, url_filter
from folioflow.llm import words as W

from .conftest import ODD, PARTS, words


def test_word_hashes():
    data, at = W.utf8(__import__("pyarrow").array([t for _, t in ODD]))
    found, begins = W.word_hashes(data, at)
    flat = [w for _, t in ODD for w in words(t)]
    assert len(found) == len(flat) and np.diff(begins).tolist() == [len(words(t)) for _, t in ODD]
    assert len(set(found.tolist())) == len(set(flat)) == len(set(zip(flat, found.tolist(), strict=True)))


# decontamination


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_leaks(spark, odd):
    items = [(1, PARTS[0]), (2, PARTS[3]), (3, "nothing of this stands in any of the documents at all my friend"), (4, None), (5, ""), (None, PARTS[1]), (6, "one two"), (7, PARTS[1].replace("evening", "night"))]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(odd, bench(spark, items)).collect()}
    expected = set()
    for i, t in ODD:
        own = words(t)
        for k, text in items:
            w = words(text)
            n = min(5, len(w))
            if k is not None and n:
                runs = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
                have = {tuple(own[j : j + n]) for j in range(len(own) - n + 1)}
                if len(runs & have) >= 0.8 * len(runs):
                    expected.add((i, k))
    assert got == expected and (9, 7) in got


def test_block_max_wand_finds_all_above_threshold():
    r = random.Random(5)
    vocabulary = [f"v{i}" for i in range(80)]
    items = decontaminate.items_of([(i, " ".join(r.choices(vocabulary, k=r.randint(4, 30))), None) for i in range(150)])
    index = decontaminate.Index(items, 5, 0.6)
    for _ in range(150):
        terms = np.unique(np.searchsorted(index.terms, W.hash_of(" ".join(r.choices(vocabulary, k=r.randint(1, 50))))))
        terms = terms[terms < len(index.terms)]
        total = np.zeros(len(index.items))
        for t in terms:
            total[index.item[index.at[t] : index.at[t + 1]]] += index.weight[index.at[t] : index.at[t + 1]]
        expected = np.flatnonzero(total >= index.theta - 1e-9).tolist()
        found = index.search(terms)
        assert [i for i, _ in found] == expected and all(abs(s - total[i]) < 1e-9 for i, s in found)
        assert bool(len(index.screened(np.zeros(len(terms), np.int64), terms, 1))) == bool(expected)


def test_retrieval_does_not_depend_on_shards(spark, monkeypatch):
    """Items of several lengths and passages that share a part of their words; with `least` 0 all that is retrieved is returned."""
    r = random.Random(11)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([6, 20, 70, 300])))) for i in range(90)]
    texts = [(i, " ".join(" ".join(r.sample(items, 1)[0][1].split()[: r.randint(2, 60)]) for _ in range(3))) for i in range(40)]
    docs, rows = spark.createDataFrame(texts, "doc_id long, text string"), bench(spark, items)
    found = lambda: {(x["doc_id"], x["item_id"], x["start_word"], round(x["score"], 9)) for x in decontaminate.find_leaks(docs, rows, least=0.0).collect()}
    whole = found()
    for name, value in (("SHARD_ITEMS", 7), ("SCAN_SHARDS", 2)):
        monkeypatch.setattr(decontaminate, name, value)
    assert whole and found() == whole


def test_leaks_odd_tables(spark, odd, clashing, empty):
    items = bench(spark, [(1, PARTS[3])])
    assert decontaminate.find_leaks(empty, items).count() == 0 == decontaminate.find_leaks(odd, bench(spark, [])).count()
    left = decontaminate.without_leaks(clashing, items)
    assert left.columns == clashing.columns and left.where("text like '%vexingly%'").count() == 0
    assert left.count() == clashing.where("text is null or text not like '%vexingly%'").count()


# packing


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def check_pieces(rows, texts, path, window):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], dtype="<u4") for i, x in texts}
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids)
    for i, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[i]) and r["ids_crc32"] == zlib.crc32(ids[i][at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids[i])
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window and at & (at - 1) == 0


@pytest.mark.parametrize("window", [16, 2048])
def test_packing_round_trip(odd, tokenizer, window):
    check_pieces(packing.pack(odd, tokenizer, window=window).collect(), ODD, tokenizer, window)


def test_packing_special_texts(spark, tokenizer):
    texts = [(1, "a<|endoftext|>b  don't\u00a0STOP\x0bnow"), (2, "ΣΑΣ Σ. İstanbul e\u0301 \u0301x"), (3, "\u2003wide\u2003space"), (4, "x" * 3000), (5, "they'll we've I'm 123 4.5%")]
    check_pieces(packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), tokenizer).collect(), texts, tokenizer, 2048)


def test_packing_prefers_neighbours():
    r = np.random.default_rng(1)
    docs = [np.concatenate((r.integers(1000 * (i % 4 + 1), 1000 * (i % 4 + 1) + 40, 60), [1])).astype(np.uint32) for i in range(64)]
    sequences = packing.pack_shard(docs, 256)
    alike = [len({d % 4 for d, _, _ in s}) for s in sequences if len(s) > 2]
    assert sum(a <= 2 for a in alike) >= 0.7 * len(alike)
    assert sum(n for s in sequences for _, _, n in s) == sum(len(d) for d in docs)


def test_neighbours_are_those_that_share_most():
    """BM25 over all terms of the seed, from its formula."""
    r = np.random.default_rng(3)
    docs = [r.choice(60, r.integers(3, 40)).astype(np.uint32) for _ in range(50)]
    index = packing.ShardIndex(docs)
    unused = r.random(50) < 0.8
    mean, df = np.mean([len(d) for d in docs]), collections.Counter(t for d in docs for t in set(d.tolist()))
    for seed in range(0, 50, 7):
        score = {}
        for i, d in enumerate(docs):
            tf = collections.Counter(d.tolist())
            both = [t for t in set(docs[seed].tolist()) if tf[t] and df[t] > 1]
            if both and unused[i]:
                score[i] = sum(math.log(1 + (50 - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in both)
        got = index.neighbours(seed, unused).tolist()
        best = sorted(score.values(), reverse=True)[: packing.NEIGHBOURS]
        assert np.allclose([score[i] for i in got], best, rtol=1e-5)


def test_packing_odd_tables(clashing, empty, tokenizer):
    assert packing.pack(empty, tokenizer).count() == 0
    rows = packing.pack(clashing, tokenizer, with_ids=True).collect()
    assert all(len(r["ids"]) == r["length"] for r in rows)
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == 2 * next(r["doc_tokens"] for r in rows if r["doc_id"] == 1)


# sharding


def test_table_is_balanced_and_stable():
    names = [f"s{i}" for i in range(20)]
    before, after = sharding.fill(names, 10_007), sharding.fill(names[:-1], 10_007)
    sizes = collections.Counter(before)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    old, new = sorted(names), sorted(names[:-1])
    moved = sum(old[a] != new[b] for a, b in zip(before, after, strict=True) if old[a] != "s19")
    assert moved / 10_007 < 0.12
    weighted = collections.Counter(sharding.fill({"a": 3, "b": 1}, 101))
    assert 70 <= weighted[0] <= 80
    for bad in (dict(shards=[]), dict(shards=names, slots=100), dict(shards=names, slots=13)):
        with pytest.raises(ValueError):
            sharding.fill(**bad)


def test_table_is_what_turns_give():
    """The rule, slot by slot: in turn each shard takes the first free slot of its own order."""
    import hashlib

    for names, slots in (["a", "b", "c"], 17), ([f"n{i}" for i in range(9)], 101):
        orders, taken = [], {}
        for name in names:
            h = hashlib.sha256(name.encode()).digest()
            offset, step = int.from_bytes(h[:8], "big") % slots, int.from_bytes(h[8:16], "big") % (slots - 1) + 1
            orders.append([(offset + j * step) % slots for j in range(slots)])
        while len(taken) < slots:
            for shard, order in enumerate(orders):
                free = [s for s in order if s not in taken]
                if free:
                    taken[free[0]] = shard
        assert sharding.fill(names, slots) == [taken[s] for s in range(slots)]


def test_placing(odd, clashing, empty):
    import hashlib

    names = [f"s{i}" for i in range(5)]
    table = sharding.fill(names)
    for r in sharding.place(odd, names).collect():
        slot = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r["slot"], r["shard"]) == (slot, names[table[slot]])
    assert sharding.place(clashing, names).where("shard is null").count() == 0 and sharding.place(empty, names).count() == 0


# toxicity


def toxic_rows(n, seed):
    r, rows = random.Random(seed), []
    for i in range(n):
        text = r.choices([f"w{k}" for k in range(400)], k=r.randint(20, 200))
        toxic = r.random() < 0.25
        insult, group = r.random() < 0.4, r.random() < 0.4
        if toxic:
            insult = group = True
        elif insult and group:
            insult = False
        text += ["grubling"] * insult + ["martians"] * group
        r.shuffle(text)
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_machine_learns_pairs(spark):
    """Insult and group are harmless alone; only the pair is toxic."""
    rows = toxic_rows(1200, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    fold = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in rows}
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, model).collect()}
    held = [(got[i] >= 0.5) == bool(y) for i, _, y in rows if fold[i]]
    assert sum(held) / len(held) > 0.95
    marked = {r["doc_id"]: r["h"] for r in docs.select("doc_id", toxicity.held_out().alias("h")).collect()}
    assert marked == fold


def test_machine_learns_what_no_sum_of_weights_can(spark):
    """Either term alone is toxic, both or none are not; a linear model must miss the rarest of the four kinds, about an eighth of the rows."""
    r, rows = random.Random(9), []
    for i in range(3000):
        a, b = r.random() < 0.6, r.random() < 0.3
        text = r.choices([f"w{k}" for k in range(300)], k=30) + ["grubling"] * a + ["martians"] * b
        r.shuffle(text)
        rows.append((i, " ".join(text), int(a != b)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int").where(~toxicity.held_out())

    def accuracy(**options):
        got = {x["doc_id"]: x["toxicity"] for x in toxicity.score(docs, toxicity.fit(docs, labels, **options)).collect()}
        held = [(got[i] >= 0.5) == bool(y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
        return sum(held) / len(held)

    assert accuracy() > 0.97 and accuracy(rank=0) < 0.93


def test_margin_is_the_sum_over_pairs():
    r = np.random.default_rng(4)
    model = toxicity.Model(np.sort(r.choice(2**32, 30, replace=False)).astype(np.uint32), r.normal(size=30).astype(np.float32), r.normal(size=(30, 6)).astype(np.float32), -0.3)
    for _ in range(20):
        have = np.flatnonzero(r.random(30) < 0.4)
        terms = np.sort(np.concatenate((model.terms[have], r.choice(2**32, 5).astype(np.uint32))))
        have = np.flatnonzero(np.isin(model.terms, terms))
        plain = model.bias + sum(float(model.linear[i]) for i in have) + sum(float(model.factors[i].astype(float) @ model.factors[j].astype(float)) for n, i in enumerate(have) for j in have[n + 1 :])
        assert math.isclose(toxicity.margins(model, terms, np.zeros(len(terms), np.int64), 1)[0], plain, rel_tol=1e-5, abs_tol=1e-5)


def test_machine_odd_tables(spark, odd, clashing, empty):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (9, 0), (9, 0), (3, 5)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    rows = toxicity.score(clashing, model).collect()
    assert len(rows) == clashing.count() and all(0 <= r["toxicity"] <= 1 for r in rows)
    assert toxicity.score(empty, model).count() == 0
    constant = toxicity.fit(empty, labels.limit(0))
    assert {r["toxicity"] for r in toxicity.score(odd, constant).collect()} == {0.5}
    assert toxicity.without_toxic(clashing, labels).columns == clashing.columns


# URLs


def test_urls(spark):
    urls = [
        (1, "https://WWW.Example.com/en/7?x"), (2, "http://a.net/de/1#y"), (3, "ftp://example.net/de/88"), (4, None), (5, "example.com/en/7"), (6, "x://org"), (7, "http://notcom/en/7"),
        (8, "http://com/en/"), (9, "http://h.org/es/1://x"), (10, "http://h.org\n/es/"), (11, ""),
    ] + [(100 + i, f"https://site{i}.example.com/en/{7 if i % 2 else 3}{i}") for i in range(60)]
    rules = url_filter.rules_of("block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/")
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(urls, "page_id long, url string").repartition(3), rules).collect()}
    for i, url in urls:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        end = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host, path = rest[:end].lower(), rest[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path] + [len(path)])]
        fit = max((r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)), key=lambda r: len(r.text), default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, fit and fit.text), url
        assert got[i]["verdict"] == fit.verdict if fit else got[i]["verdict"] in ("allow", "block")


def test_url_models_separate():
    good = [f"news.example.com/articles/{i}/story".encode() for i in range(300)]
    bad = [f"cheap-pills{i}.example.net/buy-now?x={i * 37}".encode() for i in range(300)]
    model = url_filter.fit_texts(good[:200], bad[:200])
    right = (url_filter.ratios(model, *url_filter.joined(good[200:])) >= model.threshold).mean(), (url_filter.ratios(model, *url_filter.joined(bad[200:])) < model.threshold).mean()
    assert min(right) > 0.95


def plain_ratio(accepted, rejected, url, order=4, strength=3.0):
    """Smoothed Markov models over dictionaries of strings; a text starts after `order` blanks."""
    def counts(texts):
        grams, contexts = collections.Counter(), collections.Counter()
        for t in texts:
            full = "\0" * order + t
            for i in range(order, len(full)):
                for k in range(order + 1):
                    grams[full[i - k : i + 1]] += 1
                    contexts[k, full[i - k : i]] += 1
        return grams, contexts

    total = 0.0
    for sign, (grams, contexts) in zip((1, -1), map(counts, (accepted, rejected)), strict=True):
        full = "\0" * order + url
        for i in range(order, len(full)):
            p = 1 / 256
            for k in range(order + 1):
                p = (grams[full[i - k : i + 1]] + strength * p) / (contexts[k, full[i - k : i]] + strength)
            total += sign * math.log(p)
    return total / max(len(url), 1)


def test_ratio_equals_plain_models():
    r = random.Random(2)
    make = lambda letters: "http://" + "".join(r.choices(letters, k=r.randint(1, 25)))
    good, bad = sorted({make("abc/") for _ in range(40)}), sorted({make("bcd-?") for _ in range(40)})
    model = url_filter.fit_texts([t.encode() for t in good], [t.encode() for t in bad])
    learnt = [[t for i, t in enumerate(c) if i % 5] for c in (good, bad)]
    urls = [make("abcd/-") for _ in range(30)] + ["", "x"]
    got = url_filter.ratios(model, *url_filter.joined([u.encode() for u in urls]))
    assert np.allclose(got, [plain_ratio(*learnt, u) for u in urls], atol=1e-9)
    # The threshold parts the calibrating texts as well as any place between two of them does.
    a, b = ([plain_ratio(*learnt, t) for t in c[::5]] for c in (good, bad))
    value = lambda x: sum(s >= x for s in a) / len(a) + sum(s < x for s in b) / len(b)
    assert value(model.threshold) >= max(value(x + d) for x in a + b for d in (-1e-9, 1e-9)) - 1e-9


def test_a_repeated_url_is_learnt_once(spark):
    """One URL a thousand times must not fill a class of 50."""
    rows = [(i, "http://com/en/same") for i in range(1000)] + [(2000 + i, f"http://com/en/{i * 7919 % 1000}") for i in range(40)] + [(3000 + i, f"http://net/de/{i}") for i in range(40)] + [(4000, "http://com/en/" + "x" * 5000)]
    pages = spark.createDataFrame([(u, "allow" if "net" in u else "block") for _, u in rows], "text string, label string")
    model, plain = url_filter.fit(pages, "text", "label", sample=50), url_filter.fit(pages.distinct(), "text", "label", sample=50)
    assert all((x == y).all() for x, y in zip(model.counts, plain.counts, strict=True)) and model.threshold == plain.threshold
    assert model.totals[0].sum() == sum(len(u) for side in ("en", "de") for i, u in enumerate(sorted({u for _, u in rows if f"/{side}/" in u and len(u) < 4096})) if i % 5)


def test_urls_without_rules(spark):
    pages = spark.createDataFrame([(1, "http://a/b"), (None, None)], "page_id long, url string")
    assert {r["verdict"] for r in url_filter.judge(pages, []).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), url_filter.rules_of("block a/")).count() == 0


# language model


def test_scores(odd):
    got = {r["doc_id"]: r for r in language_model.score_documents(odd).collect()}
    texts, counts = {i: words(t) for i, t in ODD}, collections.Counter()
    total = sum(map(len, texts.values()))
    for w in texts.values():
        for n in (1, 2, 3):
            counts.update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    for i, w in texts.items():
        score, used = 0.0, [0, 0, 0]
        for k in range(len(w)):
            factor = 1.0
            for n in (3, 2, 1):
                gram = tuple(w[max(0, k - n + 1) : k + 1])
                if len(gram) < n:
                    continue
                if n == 1:
                    score += math.log(factor * max(counts[gram] - 1, 0.5) / (total - 1))
                    used[0] += 1
                elif counts[gram] > 1:
                    score += math.log(factor * (counts[gram] - 1) / (counts[gram[:-1]] - 1))
                    used[n - 1] += 1
                    break
                else:
                    factor *= 0.4
        assert got[i]["n_words"] == len(w) and got[i]["by_order"] == used and math.isclose(got[i]["log_score"], score, rel_tol=1e-9, abs_tol=1e-9)
        assert (got[i]["mean_log_score"] is None) == (not w)


def test_scores_odd_tables(clashing, empty):
    assert language_model.score_documents(empty).count() == 0
    assert language_model.score_documents(clashing).count() == clashing.count()


def test_counts_are_not_cut():
    """Ten years of crawls hold more of a word than 32 bits can say."""
    x = np.array([1, 254, 255, 2**32 - 1, 2**33, 10**13], dtype=np.int64)
    assert language_model.unpack_counts(language_model.pack_counts(x), len(x)).tolist() == x.tolist()


def test_scores_are_alike_in_any_blocks(odd, monkeypatch):
    rows = lambda: {r["doc_id"]: (r["n_words"], r["by_order"], round(r["log_score"], 9)) for r in language_model.score_documents(odd).collect()}
    whole = rows()
    monkeypatch.setattr(language_model, "BUCKET_ENTRIES", 3)
    assert rows() == whole


# licenses


def test_license_scan(odd, clashing, empty):
    got = {r["doc_id"]: r for r in license_scan.scan(odd).collect()}
    for i, t in ODD:
        assert got[i]["n_words"] == len(words(t))
    r = got[15]
    start = len(words(PARTS[2])) + 2
    assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["score"]) == (2, start, start + 5, "cc-by,reserved", 1.0)
    assert r["labels"] == "cc-by,cc-by-nc,reserved" and got[1]["labels"] == "" and got[1]["first_word"] is None
    assert license_scan.scan(empty).count() == 0 and license_scan.scan(clashing).count() == clashing.count()


def plain_scan(text, slack=3, least=0.8):
    """(share of the best run of diagonals of each template that counts, base places), over all pairs of positions."""
    own, labels, base = words(text), set(), 0
    for t in license_scan.TEMPLATES:
        w = words(t.text)
        grams = [tuple(w[i : i + 2]) for i in range(len(w) - 1)]
        votes = collections.defaultdict(set)
        for i in range(len(own) - 1):
            for j, g in enumerate(grams):
                if tuple(own[i : i + 2]) == g:
                    votes[i - j].add(j)
        if t.base:
            n = sum(len(v) == len(grams) for v in votes.values())
            base += n
            labels |= {t.label} if n else set()
        elif any(len(set().union(*(votes[e] for e in votes if d <= e <= d + slack))) >= least * len(grams) for d in list(votes)):
            labels.add(t.label)
    return ",".join(sorted(labels)), base


def test_votes_equal_all_pairs_of_positions(spark):
    r, rows = random.Random(6), []
    for i in range(150):
        text = []
        for _ in range(r.randint(0, 4)):
            w = words(r.choice(license_scan.TEMPLATES).text)
            for _ in range(r.randint(0, 2)):
                at = r.randrange(len(w))
                w = w[:at] + r.choice([[], ["extra"], [w[at], "so"], ["the"]]) + w[at + 1 :]
            text += w + r.choices(["the", "of", "license", "by", "x"], k=r.randint(0, 5))
        rows.append((i, " ".join(text)))
    for x in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert (x["labels"], x["n_base"]) == plain_scan(rows[x["doc_id"]][1]), rows[x["doc_id"]][1]


def test_license_diagonals_bear_an_edit(spark):
    text = "intro words. This work is licensed under the famous GNU General Public License, version 3. outro"
    r = license_scan.scan(spark.createDataFrame([(1, text), (2, "of the in the to the " * 3000)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert r[0]["labels"] == "gpl" and r[0]["n_base"] == 1 and any(s["start"] == 2 for s in r[0]["spans"])
    assert r[1]["labels"] == "" and r[1]["score"] < 0.5


def test_license_phrases_are_counted(spark):
    text = "cc by cc by cc cc by All Rights\nReserved general public licenses"
    r = license_scan.scan(spark.createDataFrame([(None, text)], "doc_id long, text string")).first()
    assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (4, 0, 7, "cc-by,reserved")
