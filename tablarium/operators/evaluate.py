"""Evaluation: confusion counts, precision and recall, agreement, percentiles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablarium.operators.rank import ordinal


def score_decisions(decisions: DataFrame) -> DataFrame:
    """Confusion counts by field of decisions (field, gold, pred, absent). A wrong value is a false positive and a false negative."""
    has, gold = F.col("pred").isNotNull(), F.col("gold").isNotNull()
    right = has & gold & (F.col("pred") == F.col("gold"))
    n = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).alias(name)
    return decisions.groupBy("field").agg(
        n(right, "tp"), n((has & gold & ~right) | (has & F.col("absent")), "fp"), n(gold & (~has | (F.col("pred") != F.col("gold"))), "fn"),
        n(~has & F.col("absent"), "tn"), n(has & F.col("absent"), "hallucinated"),
    )


def rates(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 (0 where empty), hallucination rate (null where empty)."""
    p = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    return counts.select(
        "*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"),
        F.round(F.try_divide("hallucinated", F.col("hallucinated") + F.col("tn")), 6).alias("hallucination_rate"),
    )


def micro(counts: DataFrame) -> DataFrame:
    """One row of counts over all fields, with their rates."""
    names = ("tp", "fp", "fn", "tn", "hallucinated")
    return rates(counts.agg(*[F.sum(c).alias(c) for c in names]))


def macro_f1(counts: DataFrame) -> DataFrame:
    """Mean F1 of the fields that the gold data have values of; none: 0."""
    return rates(counts).agg(F.round(F.coalesce(F.avg(F.when(F.col("tp") + F.col("fn") > 0, F.col("f1"))), F.lit(0.0)), 6).alias("macro_f1"))


def select_split(records: DataFrame, split: str) -> DataFrame:
    """All, hard (with hard_tags) or easy records."""
    if split not in ("all", "hard", "easy"):
        raise ValueError(f"unknown split {split!r}")
    hard = F.coalesce(F.size("hard_tags") > 0, F.lit(False))
    return records if split == "all" else records.filter(hard if split == "hard" else ~hard)


def by_hard_tag(decisions: DataFrame) -> DataFrame:
    """Counts by tag and field of decisions (hard_tags, field, gold, pred, absent); a document counts for each of its tags."""
    tagged = decisions.withColumn("tag", F.explode(F.array_distinct("hard_tags")))
    return score_decisions(tagged.withColumn("field", F.struct("tag", "field"))).select("field.tag", "field.field", "tp", "fp", "fn", "tn", "hallucinated")


def percentiles(df: DataFrame, column: str, at: list[float]) -> DataFrame:
    """Interpolated and nearest-rank percentiles, from the values' counts, which are ordered in parts; nulls don't count."""
    order = ordinal(df.filter(F.col(column).isNotNull()), [], column)
    rows = order.crossJoin(order.agg(F.sum("n").alias("size")))  # one row
    value = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col(column)))
    out = []
    for q in at:
        h = (F.col("size") - 1) * F.lit(q)
        low = value(F.floor(h))
        share = F.max(h - F.floor(h))
        out.append((low + (value(F.ceil(h)) - low) * share).alias(f"p{round(q * 100)}"))
    out += [value(F.greatest(F.ceil(F.col("size") * F.lit(q)) - 1, F.lit(0))).alias(f"d{round(q * 100)}") for q in at]
    return rows.agg(*out)


def paired_counts(pairs: DataFrame) -> DataFrame:
    """Both, only_a, only_b, neither of pairs (a, b boolean)."""
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return pairs.agg(n(F.col("a") & F.col("b"), "both"), n(F.col("a") & ~F.col("b"), "only_a"), n(~F.col("a") & F.col("b"), "only_b"), n(~F.col("a") & ~F.col("b"), "neither"))


def mcnemar(b: int, c: int) -> tuple[float, float]:
    """Statistic and two-sided p: exact below 25 discordant pairs, else chi-square with continuity correction."""
    n = b + c
    if not n:
        return 0.0, 1.0
    if n < 25:
        return float(min(b, c)), min(1.0, 2 * sum(math.comb(n, k) for k in range(min(b, c) + 1)) / 2**n)
    x = (abs(b - c) - 1) ** 2 / n
    return x, math.erfc(math.sqrt(x / 2))


def cohen_kappa(pairs: DataFrame) -> DataFrame:
    """N, po, pe, kappa of labels a and b; rows with a null are left out."""
    rows = pairs.filter("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("n"))  # a row for each pair of labels
    total = rows.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left, right = (rows.groupBy(F.col(k).alias("label")).agg(F.sum("n").alias(f"n{k}")) for k in ("a", "b"))
    chance = left.join(right, "label").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("chance"))
    po, pe = F.col("same") / F.col("total"), F.col("chance") / F.col("total") / F.col("total")
    return total.join(chance).select(F.col("total").alias("n"), F.round(po, 6).alias("po"), F.round(pe, 6).alias("pe"), F.round(F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)), 6).alias("kappa"))
