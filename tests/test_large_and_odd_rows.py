"""Operators that the registered queries don't reach, or reach in one case only."""

from pyspark.sql import functions as F

from tablarium.operators import evaluate, invariants, passages, rank


def test_rank_of_a_large_table(spark):
    rows = spark.range(400_000).select(F.col("id"), (F.col("id") * 7919 % 400_009).alias("seq"), F.when(F.col("id") % 3 == 0, 1.0).otherwise((F.col("id") * 31 % 1000).cast("double")).alias("num"), F.lit(None).cast("double").alias("min"), F.lit(None).cast("double").alias("max"), F.lit(None).cast("string").alias("currency"), F.repeat(F.lit("w"), 50).alias("wide"))
    got = rank.rank(rows).join(rows.select("id", "seq", "num"), "id").orderBy("position").select("position", "num", "seq").collect()
    assert [r.position for r in got] == list(range(1, 400_001))
    assert [(r.num, r.seq) for r in got] == sorted((r.num, r.seq) for r in got)


def test_mcnemar():
    assert abs(evaluate.mcnemar(121, 59)[0] - 20.672) < 0.001 and evaluate.mcnemar(121, 59)[1] < 1e-4
    assert evaluate.mcnemar(1, 3)[1] == 0.625 and evaluate.mcnemar(0, 0) == (0.0, 1.0)


def test_invariants_find_a_violation(spark):
    docs = spark.createDataFrame([(1, "Finansman 5.000 TL"), (2, "Masrafsız. Tahsis ücreti 5 TL."), (3, None)], "id int, text string")
    assert invariants.check(docs).filter("id = 3").count() == 0
    assert invariants.report(docs).first().documents == 3


def test_vectors_of_another_size(spark):
    one = spark.createDataFrame([(1, 0, [1.0, 2.0])], "campaign_id long, chunk_index int, vector array<double>")
    assert passages.replace_vectors(one, one, 2).count() == 1
    try:
        passages.replace_vectors(one, one, 3).collect()
        raise AssertionError("the size wasn't checked")
    except Exception as e:
        assert "doesn't have 3 numbers" in str(e)
