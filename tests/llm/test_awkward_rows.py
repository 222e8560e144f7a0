"""Null and repeated doc_ids, and empty tables, in the stages and op4."""

import edge

import corpus_pipeline
from tablarium.llm import decontamination

TEST = " ".join(f"exam{k}" for k in range(12))


def test_stages(spark, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = edge.table(spark).select(*columns)
    again = spark.createDataFrame([(None, edge.PASSAGE, "en", "s", 1), (8, edge.PASSAGE, "en", "s", 1), (8, edge.PASSAGE, "en", "s", 1), (None, f"a {TEST} b", "en", "s", 1), (3, f"a {TEST} b c", "en", "s", 1)], docs.schema)
    docs = docs.unionByName(again)
    spark.createDataFrame([(1, TEST)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["near_duplicates"](spark, docs, str(tmp_path)).collect()
    assert sum(edge.PASSAGE in (r.text or "") for r in kept) == 1
    assert sum(r.text == "one" for r in kept) == 1 == sum((r.text or "").startswith("no id here") for r in kept)
    clean = stages["decontamination"](spark, docs, str(tmp_path)).collect()
    assert len(clean) == docs.count() - 2 and not any(TEST in (r.text or "") for r in clean)
    for table in (docs, edge.empty(spark).select(*columns), edge.table(spark)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path)).collect()
            assert len(out) >= 1 or table is not docs


def test_null_ids_are_searched(spark):
    docs = spark.createDataFrame([(None, TEST), (None, "clean"), (4, TEST), (4, "clean")], "doc_id long, text string")
    got = decontamination.decontaminate(docs, spark.createDataFrame([(1, TEST)], "item_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_hit, r.contaminated) for r in got) == [("4", 0, False), ("4", 12, True), ("None", 0, False), ("None", 12, True)]
