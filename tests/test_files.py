import json

from tablarium.operators.agreement import bootstrap_f1
from tablarium.sources import files


def test_corpus_with_sidecars(spark, tmp_path):
    for name, text in {"a/x.txt": "<b>Merhaba</b>", "a/y.txt": " ", "b/z.txt": "Merhaba", "b/w.txt": "Başka"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "a/x.meta.json").write_text(json.dumps({"source_url": "https://b.example/x", "content_hash": "h"}))
    (tmp_path / "b/z.meta.json").write_text("{broken")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in files.read_corpus(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["w.txt", "x.txt", "z.txt"]
    assert rows["x.txt"]["source_url"] == "https://b.example/x" and rows["x.txt"]["content_hash"] == "h" and rows["x.txt"]["text"] == "Merhaba"
    assert rows["z.txt"]["source_url"] == rows["z.txt"]["path"] and len(rows["z.txt"]["content_hash"]) == 64
    assert files.read_raw_docs(spark, str(tmp_path), 1).count() == 3


def test_records_in_three_forms(spark, tmp_path):
    want = [(1, "a"), (2, None)]
    for k, text in enumerate(['[{"id": 1, "s": "a"}, {"id": 2}]', '{"records": [{"id": 1, "s": "a"}, {"id": 2}]}', '{"id": 1, "s": "a"}\n\n{"id": 2}\n']):
        (tmp_path / f"{k}.json").write_text(text)
        assert sorted(map(tuple, files.read_records(spark, str(tmp_path / f"{k}.json"), "id int, s string").collect())) == want


def test_review_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("d1", 'a;"b"', "çok"), ("d2", None, "")], "doc_id string, snippet string, note string")
    files.write_review(rows, str(tmp_path / "r"))
    got = {r["doc_id"]: (r["snippet"], r["note"] or "") for r in files.read_review(spark, str(tmp_path / "r")).collect()}
    assert got == {"d1": ('a;"b"', "çok"), "d2": (None, "")}


def test_saved_names_differ(spark, tmp_path):
    files.save_docs(spark.createDataFrame([("b", "x", "u2"), ("b", "x", "u1"), ("c", "x", "u3")], "bank_slug string, stem string, url string"), str(tmp_path / "d"))
    assert sorted((r["url"], r["name"]) for r in spark.read.parquet(str(tmp_path / "d")).collect()) == [("u1", "x"), ("u2", "x-2"), ("u3", "x")]


def test_bootstrap_covers_the_estimate(spark):
    docs = spark.range(200).selectExpr("id", "cast(id % 4 > 0 as int) as tp", "cast(id % 4 = 0 as int) as fp", "cast(id % 4 = 0 as int) as fn")
    low, high = bootstrap_f1(docs).first()
    assert 0.66 < low < 0.72 < 0.78 < high < 0.83
    assert bootstrap_f1(docs.repartition(3)).first() == (low, high)
