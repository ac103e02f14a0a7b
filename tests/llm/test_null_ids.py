"""Near copies in rows without an id."""

from folioflow.llm import jaccard_join


def test_near_copies_with_null_ids_are_linked(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (None, text + " end"), (None, text + " end"), (None, "start " + text), (4, "nothing like the others at all in here"), (None, None)]
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted(((r["doc_id"], r["class_id"], r["class_size"], r["n_links"], r["n_set_links"], r["kept"]) for r in got), key=repr)
    assert found == sorted([(1, 1, 4, 3, 2, True), *[(None, 1, 4, 3, 2, False)] * 3, (4, 4, 1, 0, 0, True), (None, None, 1, 0, 0, True)], key=repr)
