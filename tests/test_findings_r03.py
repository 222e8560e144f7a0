"""Faults that the review of round 3 found."""

from pyspark.sql import functions as F

from tablarium.functions import text
from tablarium.functions.spread import spread
from tablarium.operators import ask, embed, rank


def test_one_partition_is_dealt_to_all_cores(spark):
    one = spark.range(100).coalesce(1)
    assert spread(one).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in spread(one).collect()) == list(range(100))


def test_fold_of_odd_letters(spark):
    odd = ["", None, "IİŞĞÇÖÜ ÂÎÛ", "ΑΒΓΣ ΟΔΟΣ", "ÉÀ×÷ẞǅⅠⒶ", "😀 K₺ “x”", "i̇I"]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    for got, want in df.select(text.tr_fold(F.col("t")), F.lower(F.translate("t", "Iİ", "ıi"))).collect():
        assert got == want


def test_places_of_matches(spark):
    df = spark.createDataFrame([("😀 ab\nx ab",), ("none",), (None,)], "t string")
    got = df.select(text.first_match(F.col("t"), "(?i)AB|cd").alias("f"), text.match_spans(F.col("t"), "ab|cd").alias("m")).collect()
    assert (got[0].f.s, got[0].f.e, got[0].f.m) == (2, 4, "ab") and [(m.s, m.e) for m in got[0].m] == [(2, 4), (7, 9)]
    assert got[1].f is None and got[1].m == [] and got[2].f is None and got[2].m is None


def test_nearest_and_quoted_with_copies_and_ties(spark):
    texts = ["a b c", "a b d", "a b c", "x y", "a b", "d b a", "", None, "a b c"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = embed.nearest(rows, rows.select(F.col("id").alias("campaign_id"), F.lit(0).alias("chunk_index"), F.col("text").alias("chunk_text")), 4).collect()
    bags = {r.id: r.b for r in rows.select("id", embed.hashed_bag(F.col("text")).alias("b")).collect()}
    for i in bags:
        scores = [(j, sum(x * bags[j].get(p, 0) for p, x in bags[i].items())) for j in bags]
        want = sorted([(-round(s, 9), j) for j, s in scores if s > 0])[:4]
        assert sorted((-round(r.score, 9), r.campaign_id) for r in got if r.id == i) == want
    quoted = ask.quoted(rows.select("id", F.col("text").alias("question")), rows.withColumn("bank", F.lit("B")))
    assert {r.id: (r.body.split(": ")[1], r.sources) for r in quoted.collect()} == {0: ("a b c", 3), 1: ("a b d", 3), 2: ("a b c", 3), 3: ("x y", 1), 4: ("a b c", 3), 5: ("a b d", 3), 8: ("a b c", 3)}
    plan = embed.dense(embed.hashed_bag(F.col("text")), 4)
    assert [len(r[0]) for r in rows.select(plan).collect()] == [4] * len(texts)


def test_parts_and_best_of_types(spark):
    bounds = [1.0, 2.0, 2.0, 5.0] + [float(k) for k in range(6, 257)]
    df = spark.createDataFrame([(x / 2,) for x in range(0, 530)], "k double")
    for k, n in df.select("k", rank._part(F.col("k"), F.array(*map(F.lit, bounds)))).collect():
        assert n == sum(b < k for b in bounds)
    rows = spark.createDataFrame([(1, "a", 0.5, 1.0, True), (2, "a", 0.5, 1.0, True), (3, "a", 0.9, 1.0, False), (4, "b", 0.1, 0.2, False)], "id long, campaign_type string, score double, coverage double, comparable boolean")
    best = rank.best_by_type(rows)
    assert {tuple(r) for r in best.collect()} == {("a", 1, 0.5), ("b", None, None)}
    assert best._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1  # the scores are computed once
