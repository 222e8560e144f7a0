"""Arms of an experiment: each one's score, and all pairs of them on the decisions that both have made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablarium.operators.evaluate import mcnemar, score_decisions


def measured(arms: DataFrame, decisions: DataFrame) -> DataFrame:
    """Arm, measured, reason, documents, tp, fp, fn, f1 of arms (arm, reason: null if it could be run).

    decisions: arm, document, field, gold, pred, absent. An arm that couldn't be run, or has no decisions, keeps its row, without figures.
    """
    with_arm = decisions.withColumn("field", F.struct("arm", "field"))
    counts = score_decisions(with_arm).select("field.arm", "tp", "fp", "fn").groupBy("arm").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    documents = decisions.groupBy("arm").agg(F.countDistinct("document").alias("documents"))
    scored = arms.join(counts.join(documents, "arm"), "arm", "left")
    live = F.col("reason").isNull() & F.col("documents").isNotNull()
    f1 = F.round(F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)), 6)
    reason = F.when(live, F.lit(None)).otherwise(F.coalesce("reason", F.lit("no decisions")))
    return scored.select("arm", live.alias("measured"), reason.alias("reason"), *[F.when(live, F.col(c)).alias(c) for c in ("documents", "tp", "fp", "fn")], F.when(live, f1).alias("f1"))


def compared(decisions: DataFrame, level: float = 0.05) -> DataFrame:
    """A, b, scope, decisions, only_a, only_b, statistic, p, winner of each pair of arms (a < b), over all documents and the hard ones.

    decisions: arm, document, field, right, hard. Decisions are paired by document and field; one that an arm lacks doesn't count
    for its pairs. Arms are few, so those of a decision are paired in place, and the counts of all pairs reach the driver for
    the test.
    """
    met = decisions.groupBy("document", "field").agg(F.collect_list(F.struct("arm", "right")).alias("arms"), F.max(F.coalesce("hard", F.lit(False))).alias("hard"))
    each = met.select("hard", F.explode("arms").alias("x"), "arms").select("hard", "x", F.explode("arms").alias("y")).filter("x.arm < y.arm")
    scoped = each.select(F.explode(F.when(F.col("hard"), F.array(F.lit("all"), F.lit("hard"))).otherwise(F.array(F.lit("all")))).alias("scope"), F.col("x.arm").alias("a"), F.col("y.arm").alias("b"), F.col("x.right").alias("ra"), F.col("y.right").alias("rb"))
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    counts = scoped.groupBy("a", "b", "scope").agg(F.count("*").alias("decisions"), n(F.col("ra") & ~F.col("rb"), "only_a"), n(~F.col("ra") & F.col("rb"), "only_b"))
    rows = []
    for r in counts.orderBy("a", "b", "scope").collect():
        statistic, p = mcnemar(r.only_a, r.only_b)
        winner = None if p >= level or r.only_a == r.only_b else r.a if r.only_a > r.only_b else r.b
        rows.append((*r, statistic, p, winner))
    return decisions.sparkSession.createDataFrame(rows, "a string, b string, scope string, decisions long, only_a long, only_b long, statistic double, p double, winner string")


