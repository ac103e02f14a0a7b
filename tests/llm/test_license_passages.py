"""License passages with stray words of the template around them."""

from folioflow.llm import license_scan


def test_stray_words_before_a_passage_do_not_split_it(spark):
    passage = "licensed under the apache license X version 2.0"
    rows = [(1, f"under the {passage}"), (2, passage), (3, f"under the {passage} and so on with more words here {passage}")]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {r["labels"] for r in got.values()} == {"apache"} and {round(r["score"], 6) for r in got.values()} == {round(6 / 7, 6)}
    assert [s["start"] for s in got[1]["spans"]] == [2] and [s["start"] for s in got[2]["spans"]] == [0] and len(got[3]["spans"]) == 2


def sentence(r, n):
    return " ".join(f"{a}{b}" for a, b in zip(r.choice(["lic", "war", "cop", "use", "dis"], n), r.integers(0, 400, n), strict=True))


def test_whole_licenses_of_any_length(spark, tmp_path):
    """Licenses of 2,000 to 6,000 words from files, found whole, edited, with words put in and left out, inside other text; and not by half."""
    import numpy as np

    r = np.random.default_rng(12)
    texts = {"first": sentence(r, 2000), "second": sentence(r, 6000), "brief": "all that is in here may be used by anyone", "middle": sentence(r, 66)}
    for name, text in texts.items():
        (tmp_path / f"{name}.txt").write_text(text)
    templates = license_scan.templates_of(spark, str(tmp_path))
    assert {(t.label, len(t.text.split())) for t in templates} == {(n, len(t.split())) for n, t in texts.items()}
    first = texts["first"].split()
    edited = first[:700] + ["other", "words", "here"] + first[700:1200] + first[1202:1500] + ["once"] + first[1500:]
    changed = [w if i % 40 else "changed" for i, w in enumerate(first)]
    rows = [
        (1, texts["first"]), (2, "before it " + " ".join(edited) + " after"), (3, " ".join(changed)), (4, " ".join(first[:1000])), (5, texts["second"].upper() + "\\n" + texts["brief"]),
        (6, "we say " + texts["brief"] + " today"), (7, None), (8, ""), (9, texts["middle"]), (10, " ".join(sorted(first))),
    ]
    got = {x["doc_id"]: x for x in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=templates).collect()}
    assert {i: x["labels"] for i, x in got.items()} == {1: "first", 2: "first", 3: "first", 4: "", 5: "brief,second", 6: "brief", 7: "", 8: "", 9: "middle", 10: ""}
    assert [(s["start"], s["end"]) for s in got[1]["spans"]] == [(0, 2000)] and got[1]["score"] == 1.0
    assert [(s["start"], s["end"]) for s in got[2]["spans"]] == [(2, 2004)] and 0.98 < got[2]["score"] < 1
    assert 0.85 < got[3]["score"] < 0.9 and 0.45 < got[4]["score"] < 0.55


def test_published_licenses(spark):
    """The texts that a system keeps, where it does: each is found as itself, in a file that quotes it."""
    import os

    import pytest

    folder = "/usr/share/common-licenses"
    names = [n for n in ("Apache-2.0", "GPL-3", "MPL-2.0", "CC0-1.0") if os.path.isfile(f"{folder}/{n}")]
    if not names:
        pytest.skip("no license texts here")
    templates = tuple(license_scan.Template(n, open(f"{folder}/{n}").read()) for n in names)
    rows = [(i, "Notice of this package. " + t.text.replace("License", "Licence", 20) + " End of the notice.") for i, t in enumerate(templates)]
    got = {x["doc_id"]: x["labels"] for x in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=templates).collect()}
    assert got == dict(enumerate(names))
