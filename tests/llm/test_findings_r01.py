"""Cases of the first review."""

from tablarium.llm import decontamination, licenses


def test_notice_inside_a_longer_line(spark):
    common = "pages hold many ordinary words like these here"
    rows = [(k, f"h/{k}", f"{common}\n{k}") for k in range(200)] + [(200, "h/200", f"Released under the MIT License. {common}"), (201, "h/201", f"{common} only a license of some kind")]
    got = {r.id: r.license for r in licenses.license_scan(spark.createDataFrame(rows, "id long, path string, text string"), "id", "path", "text").collect()}
    assert got == {k: "MIT" if k == 200 else None for k in range(202)}


def test_proximity_with_a_late_anchor(spark):
    words = [f"t{k}" for k in range(10)]
    near = ["t0", "x", *words[1:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "t9 " + " ".join(words[:9])), (3, " ".join(near)), (4, "t0 t1 t2 t3 t4 t5 t6 t7 t8 " * 3)], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.n_near_items, r.contaminated) for r in decontamination.decontaminate(docs, items, gap=2).collect()}
    assert got == {1: (10, 1, 1, True), 2: (0, 0, 0, False), 3: (0, 0, 1, False), 4: (0, 0, 0, False)}
    assert "n_near_items" not in decontamination.decontaminate(docs, items).columns
