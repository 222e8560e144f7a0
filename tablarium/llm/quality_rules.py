"""Quality rules: decision lists that sequential covering learns from labelled text statistics.

Rules are ordered conjunctions of thresholds. Each is grown on two thirds of the labelled rows by
information gain, then pruned on the rest. All statistics are native columns; what reaches the driver
are those of a bounded number of labelled rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablarium.llm.common import SPACE_CHARS, read, words

SYMBOLS = "#*$%&|<>"
FEATURES = ["n_words", "mean_word_chars", "symbols_per_word", "dup_line_share", "repeat_share", "distinct_share", "digits_per_word", "words_per_line"]


@dataclass(frozen=True)
class Rule:
    """If all conditions (feature, "<=" or ">", threshold) hold, the row is rejected."""

    conditions: tuple[tuple[str, str, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for feature, op, at in self.conditions:
            out = out & (F.col(feature) <= at if op == "<=" else F.col(feature) > at)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{f} {op} {at:.6g}" for f, op, at in self.conditions)


def text_statistics(docs: DataFrame, text: str = "text", window: int = 5) -> DataFrame:
    """docs with the base counts and FEATURES; words of null text: none.

    A repeated window is told by a 64-bit hash of its words. Sorting is done only in texts that have one.
    """
    ws = SPACE_CHARS
    df = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumns({
        "_h": F.transform(words(F.col("_t")), lambda x: F.xxhash64(x)),
        "_lines": F.filter(F.split(F.col("_t"), "\n"), lambda x: F.length(F.translate(x, ws, "")) > 0),
        "word_chars": F.length(F.translate(F.col("_t"), ws, "")).cast("long"),
        "n_symbols": (F.length("_t") - F.length(F.translate(F.col("_t"), SYMBOLS, ""))).cast("long"),
        "_digits": F.length("_t") - F.length(F.translate(F.col("_t"), "0123456789", "")),
    })
    df = df.withColumns({
        "n_words": F.size("_h").cast("long"),
        "_n_lines": F.size("_lines"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_distinct": F.size(F.array_distinct("_h")),
        "_g": F.when(
            F.size("_h") >= window,
            F.transform(F.sequence(F.lit(0), F.size("_h") - window), lambda i: F.xxhash64(*[F.get(F.col("_h"), i + k) for k in range(window)])),
        ).otherwise(F.array().cast("array<bigint>")),
    }).drop("_t", "_lines", "_h")
    df = df.withColumn("_s", F.when(F.size("_g") > F.size(F.array_distinct("_g")), F.array_sort(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_g")
    same = lambda x, k: F.coalesce(F.get(F.col("_s"), k)["h"] == x["h"], F.lit(False))
    again = F.filter("_s", lambda x, k: same(x, k - 1) | same(x, k + 1))
    df = df.withColumn("_p", F.array_sort(F.transform(again, lambda x: x["i"]))).drop("_s")
    covered = F.aggregate(
        "_p",
        F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(window), x - a["last"])).alias("n"), x.alias("last")),
        lambda a: a["n"],
    )
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_p")
    n = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("_n_lines"), F.lit(1))
    return df.withColumns({
        "mean_word_chars": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "repeat_share": F.col("n_repeat_words") / n,
        "distinct_share": F.col("_distinct") / n,
        "digits_per_word": F.col("_digits") / n,
        "words_per_line": F.col("n_words") / lines,
    }).drop("_distinct", "_digits", "_n_lines")


def learn_rules(
    labelled: DataFrame, bad: str = "bad", key: str = "doc_id", features: list[str] = FEATURES, *,
    max_rules: int = 8, max_conditions: int = 4, min_precision: float = 0.95, min_covered: int = 3, cuts: int = 32,
) -> list[Rule]:
    """Rules that tell rows with bad = 1, best first; none if a class is missing.

    labelled, of a size that its maker bounds, comes to the driver as numbers only. Rows are held for pruning by a
    hash of the key. A rule must keep min_precision on those, and cover min_covered bad rows there.
    """
    got = labelled.select(F.col(bad).alias("y"), (F.pmod(F.xxhash64(key), F.lit(3)) != 0).alias("grow"), *features).orderBy(key).collect()
    rows = [(r["y"], r["grow"], [float(r[f]) for f in features]) for r in got]
    if {y for y, _, _ in rows} != {0, 1}:
        return []
    thresholds = [_quantiles(rows, k, cuts) for k in range(len(features))]
    binned = [(y, grow, values, [bisect_left(t, v) for t, v in zip(thresholds, values, strict=True)]) for y, grow, values in rows]
    rules: list[Rule] = []
    while len(rules) < max_rules:
        grown: list[tuple[int, str, float]] = []
        now = [r for r in binned if r[1]]
        while len(grown) < max_conditions and (best := _best_cut(now, thresholds)):
            grown.append(best)
            now = [r for r in now if _holds([best], r[2])]
        # prune: the prefix with the best (p - n) / (p + n) on the held rows
        held, scored = [r for r in binned if not r[1]], []
        for k in range(len(grown)):
            held = [r for r in held if _holds([grown[k]], r[2])]
            p, n = sum(r[0] for r in held), len(held)
            scored.append(((2 * p - n) / n if n else -1, p, -k, n))
        if not scored:
            break
        _, p, k, n = max(scored)
        if p < min_covered or p < min_precision * n:
            break
        taken = grown[: 1 - k]
        rules.append(Rule(tuple((features[f], op, at) for f, op, at in taken)))
        binned = [r for r in binned if not _holds(taken, r[2])]
    return rules


def _quantiles(rows: list, feature: int, cuts: int) -> list[float]:
    """Distinct quantiles of a feature within either class."""
    out: set[float] = set()
    for y in (0, 1):
        values = sorted(r[2][feature] for r in rows if r[0] == y)
        out |= {values[len(values) * k // cuts] for k in range(1, cuts)}
    return sorted(out)


def _holds(conditions: list[tuple[int, str, float]], values: list[float]) -> bool:
    return all(values[f] <= at if op == "<=" else values[f] > at for f, op, at in conditions)


def _best_cut(rows: list, thresholds: list[list[float]]) -> tuple[int, str, float] | None:
    """The (feature, operator, threshold) with the largest FOIL gain."""
    total_p, total = sum(r[0] for r in rows), len(rows)
    if not total_p or total_p == total:
        return None
    base, best, found = math.log2(total_p / total), 1e-9, None
    for f, cuts in enumerate(thresholds):
        bad, every = [0] * (len(cuts) + 1), [0] * (len(cuts) + 1)
        for y, _, _, bins in rows:
            bad[bins[f]] += y
            every[bins[f]] += 1
        p = n = 0
        for b, x in enumerate(cuts):  # bin b holds values in (cuts[b - 1], cuts[b]]
            p, n = p + bad[b], n + every[b]
            for op, pp, nn in (("<=", p, n), (">", total_p - p, total - n)):
                if pp and nn < total and (gain := pp * (math.log2(pp / nn) - base)) > best:
                    best, found = gain, (f, op, x)
    return found


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional: the number of the first rule that holds, else 0."""
    out = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule.column(), F.lit(k)).otherwise(out)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """doc_id, FEATURES and bad of at most max_labelled labelled documents, picked by a hash of the id."""
    picked = (
        labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("q"))
        .select("doc_id", (F.col("q") == 0).cast("int").alias("bad"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # max_labelled rows at most
    return text_statistics(texts).select("doc_id", "bad", *FEATURES)


def _failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of docs, with all their columns, that pass the base test and meet no rule."""
    packed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    # a column that is not deterministic keeps Spark from pushing the filter below the statistics, which it would then compute twice
    stats = text_statistics(packed).withColumns({"_good": ~_failed() & (verdict(rules) == 0), "_any": F.monotonically_increasing_id()})
    return stats.filter("_good and _any >= 0").select("_row.*")


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule of each row of docs.

    Empty and null texts have no words and fail the base test. Repeated rows are judged row by row.
    """
    stats = text_statistics(docs.select("doc_id", "text")).withColumn("rule", verdict(rules))
    # not deterministic, so that a filter on the result isn't pushed below the statistics, which Spark would then compute twice
    failed = _failed() & (F.monotonically_increasing_id() >= 0)
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~_failed() & (F.col("rule") == 0)).alias("kept"), F.when(~_failed(), F.col("rule")).otherwise(0).alias("rule"),
    )


def quality_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, **learn) -> DataFrame:
    """Learn a decision list from labels (doc_id, quality 0 or 1) and judge every row of docs with it.

    max_labelled bounds the labelled rows that rules are fitted on; all rows of docs are judged.
    Null ids, labels without a document and documents without a label are fine. No labels: base test only.
    """
    return apply_rules(docs, learn_rules(labelled_sample(docs, labels, max_labelled), **learn))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {"op1_quality_rules": op1_quality_rules}
