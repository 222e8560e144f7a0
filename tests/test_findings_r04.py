"""Faults that the review of round 4 found."""

from pyspark.sql import functions as F

from tablarium.functions import text
from tablarium.operators import fields
from tablarium.plans import fields as plans

SMALL = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fields_are_found_once_and_on_all_cores(spark):
    plan = _plan(plans.long_fields(spark, SMALL))
    # no inferred filter on the number of fields, which finds them in the few tasks that read the file
    assert "Filter (size" not in plan and plan.count("Filter") == 1


def test_rows_without_fields(spark):
    docs = spark.createDataFrame([(1, "Kampanya 31.12.2026"), (2, ""), (3, None), (4, "12 ay vade, 3 taksit")], "id int, text string")
    got = fields.long_fields(fields.campaigns(docs), ["id"])
    assert sorted((r.id, r.field) for r in got.collect()) == [(1, "kampanya_suresi"), (4, "taksit_sayisi"), (4, "vade_ay")]


def test_folds_of_all_letters(spark):
    letters = spark.range(1, 0x110000).filter("id not between 55296 and 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    want = F.lower(F.translate("c", "Iİ", "ıi"))
    differing = letters.filter(~text.tr_fold(F.col("c")).eqNullSafe(want) | ~text.tr_fold_ascii(F.col("c")).eqNullSafe(F.translate(want, text.MARKED, text.PLAIN)))
    assert differing.count() == 0


def test_small_letters_are_those_that_patterns_take_for_the_same(spark):
    wanted = "abcdefghijklmnopqrstuvwxyzçğıöşüâ₺"
    letters = spark.range(1, 0x110000).filter("id not between 55296 and 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c")).filter(F.col("c").rlike(f"(?iu)^[{wanted}]$"))
    low = text.tr_fold(F.col("c"))
    got = letters.select("c", text.plain_letters(text.unmarked(low)).alias("plain"), text.small_letters(low).alias("small"), F.filter(F.array(*map(F.lit, wanted)), lambda x: F.regexp_like(F.col("c"), F.concat(F.lit("(?iu)^"), x, F.lit("$")))).alias("same")).collect()
    assert {r.c for r in got} >= set(wanted + "İIKſŞ")
    for r in got:
        for x in r.same:
            assert r.plain == x.translate(str.maketrans(text.MARKED, text.PLAIN)) and r.small == x.replace("ı", "i"), r


ODD = [
    "", None, "Vade Kâr Payı Oranı: 3 %1,95 %0,50 36 %2,10 %0,50", "%2,54 KÂR PAYI ORANI İLE 24 AY VADE, İLK 3 AY ödemesiz, 5 yıl", "kar payı oranı 2,05 ile 3,05 ￿￾ kredi ￿ 5.000 TL",
    "😀 Tahsis ücreti 500 TL. MASRAFSIZDIR; dosya masrafı yok", "Masraf 5 TL Yıllık Maliyet Oranı yok", "taſit 6 taKſit 7 takſit", "1.2.3 ay 12ay5 ay 405.323,91 ay,5 yıl 7 sene", "12 ay\n" * 40,
    "En az 5.000 TL harcama şartı ile 100 TL bonus, %20 indirim ve 50 chip-para yeni müşterilere 1 Ocak 2027 tarihine kadar",
]


def test_columns_and_folds_find_the_same(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "id int, text string")
    every = {r.id: r.f for r in docs.select("id", fields.extract_all(F.col("text")).alias("f")).collect()}
    assert {r.id: r.fields for r in fields.campaigns(docs).collect()} == every and sum(map(len, every.values())) == 18
    plain = {r.id: r.fields for r in fields.campaigns(docs, evidence=False).collect()}
    last = ("s", "e", "raw", "window", "confidence")
    for k, found in every.items():
        assert [{p: v for p, v in f.asDict().items() if p not in last} for f in found] == [{p: v for p, v in f.asDict().items() if p not in last} for f in plain[k]]
        assert all(f[p] is None for f in plain[k] for p in last)
        assert all(f.raw == ODD[k][f.s : f.e] for f in found if f.s is not None and f.field != "kampanya_kosullari")


def test_a_marked_text_keeps_its_letters(spark):
    df = spark.createDataFrame([("a￿b x￿😀 a￿b",)], "t string")
    got = df.select(text.first_match(F.col("t"), "(a)[^b]b", 1).alias("f"), text.match_spans(F.col("t"), "a[^b]b").alias("m")).first()
    assert (got.f.s, got.f.e, got.f.m, got.f.g1, got.f.n) == (0, 3, "a￿b", "a", 2) and [(x.s, x.e, x.m) for x in got.m] == [(0, 3, "a￿b"), (8, 11, "a￿b")]
