"""Growth of time and of a task's memory that the review of round 3 projected."""

from pyspark.sql import functions as F

from tablarium.functions import spread
from tablarium.operators import agreement, ask, gold, model_output

SMALL = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(spread, "PART_ROWS", 10)
    got = spread.dealt(spark.range(1000).select((F.col("id") % 50).alias("k")), "k")
    parts = got.select("k", F.spark_partition_id().alias("p")).distinct()
    assert got.rdd.getNumPartitions() == 100 and got.count() == 1000 and parts.count() == 50


def test_closed_objects_of_any_depth(spark):
    deep = ["{" * n + 'x"}\\"{"' + "}" * n + "}" for n in (1, 7, 8, 9, 20)]
    texts = [*deep, "} {}", '{"a": "\\\\"} {', '{"a": "\\"}', "{\n'}", "", None, "ğ{😀}", '"{"}', "{" * 12, "{" + '"a", ' * 5000 + "}"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", model_output.balanced(F.col("t")).alias("a"), model_output._counted(F.col("t"), "{", "}").alias("b")).collect():
        assert r.a == r.b, r.t
    deep_value = '{"f": ' + '{"a": ' * 12 + '1, "value" : 77' + "}" * 12 + "}"
    got = df.limit(1).select(model_output.value_span(F.lit(deep_value), "f").alias("x"), model_output.value_span(F.lit('{"f": 3, "g": {"f": {"value": 1}}}'), "f").alias("y")).first()
    assert deep_value[got.x.s : got.x.e] == "77" and got.y is None


def test_token_confidences_reads_its_rows_twice_and_meets_none(spark):
    from tablarium.plans import dialogue

    plan = _plan(dialogue.token_confidences(spark, SMALL))
    assert plan.count("Relation [") == 2 and "Join" not in plan


def test_equal_questions_are_read_once(spark):
    said = ["kampanya metni", "Bu kampanya CAİZ mi?", None, "", "Konut kampanyalarında en yüksek vade nedir?", "Bugün hava nasıl?"]
    asked = spark.range(60).select("id", F.get(F.array(*map(F.lit, said)), (F.col("id") % 6).cast("int")).alias("question"))
    value = F.struct(*[F.lit(x).cast("double").alias(n) for n, x in (("num", 24), ("min", None), ("max", None), ("value", None))], F.lit(None).cast("string").alias("currency"), F.lit(None).cast("boolean").alias("has_fee"), F.lit(None).cast("double").alias("amount"))
    stored = spark.createDataFrame([(1, "b", "Konut Finansmanı", "vade_ay", 1)], "campaign_id long, bank string, campaign_type string, field string, seq long").withColumn("value", value)
    texts = spark.createDataFrame([(1, "b", "kampanya metni burada")], "id long, bank string, text string")
    answers = ask.ask(asked, stored, texts, {"b bank": "b"}, ["kampanya", "vade"])
    got = {r.id: r for r in answers.collect()}
    assert len(got) == 60 and all(got[k].answer == got[k % 6].answer and got[k].sources == got[k % 6].sources for k in got)
    assert [(got[k].handler, got[k].sources, got[k].abstained) for k in range(6)] == [("rag", 1, False), ("safety", 1, False), ("safety", 1, True), ("safety", 1, True), ("structured", 1, False), ("safety", 1, True)]
    assert got[0].answer == "İlgili kampanya (b): kampanya metni burada" and "24 ay" in got[4].answer
    # what is read of a question stands over distinct ones only
    plan = answers._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [copy" in plan.rsplit("faiz(?!siz)", 1)[1]


def test_verdicts_are_merged_in_one_shuffle(spark):
    rows = [
        (1, "campaign_type", "Absent ", "m", "g"), (1, "vade_ay", "", "12", "g"), (2, "vade_ay", None, "12", "g"), (2, "vade_ay", "ok", "12", "h"), (2, "oran", "fix", "1", "2"), (2, "oran", "ok", "1", "2"),
        (3, "oran", "fix", "1", None), (3, "vade_ay", "unclear", "1", "1"), (3, "x", "ok", "", "1"), (3, "x", "absent", "1", "1"), (None, "campaign_type", "absent", "1", "1"), (None, "x", "ok", "1", "1"), (3, None, "fix", "1", ""), (4, "campaign_type", "absent", "1", "1"), (4, "campaign_type", "ok", "k", "1"),
    ]
    got = gold.merge_verdicts(spark.createDataFrame(rows, "doc_id long, field string, verdict string, model_value string, gold_value string"))
    assert {(r.doc_id, r.field): (r.decision, r.value) for r in got.collect()} == {
        (2, "vade_ay"): ("value", "12"), (2, "oran"): ("conflict", None), (3, "oran"): ("absent", None), (3, "vade_ay"): ("unclear", None), (3, "x"): ("absent", None),
        (None, "campaign_type"): ("absent", None), (None, "x"): ("value", "1"), (3, None): ("value", ""),
    }
    plan = _plan(got)
    assert "Join" not in plan and "Expand" not in plan and "RepartitionByExpression [doc_id" in plan


def test_ratio_alpha_deals_units(spark):
    rows = [(u, v) for u in range(40) for v in ([1.0, 2.0, 0.0] if u % 3 else [3.0, 3.0, 5.0, None])] + [(None, 1.0), (None, 2.0), (99, 7.0)]
    labels = spark.createDataFrame(rows, "unit int, value double")
    units = [[v for x, v in rows if x == u and v is not None] for u in range(40)]
    every = [v for vs in units for v in vs]
    far = lambda a, b: ((a - b) / (a + b)) ** 2 if a + b else 0.0
    observed = sum(far(a, b) / (len(vs) - 1) for vs in units for a in vs for b in vs) / len(every)
    expected = sum(far(a, b) for a in every for b in every) / len(every) / (len(every) - 1)
    df = agreement.krippendorff_ratio(labels)
    assert tuple(df.first()) == (len(every), round(1 - observed / expected, 6))
    assert "RepartitionByExpression [unit" in _plan(df)
    assert tuple(agreement.krippendorff_ratio(labels.filter("unit = 99")).first()) == (None, 1.0)


def test_rewards_are_read_on_all_cores(spark):
    from tablarium.plans import pages

    df = pages.extract_reward(spark, SMALL)
    assert df.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
