"""Agreement of several annotators, tolerant matching, bootstrap intervals and stratified splits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablarium.functions.spread import dealt
from tablarium.functions.text import tr_fold_ascii


def is_close(a: Column, b: Column, relative: float = 0.01, absolute: float = 1e-9) -> Column:
    """Numbers that differ by no more than either tolerance; two nulls are equal."""
    within = F.abs(a - b) <= F.greatest(relative * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(within)


def rate_match(pred: Column, gold: Column, tolerant: bool) -> Column:
    """Rates (struct num, min, max). Strict: equal in form and value. Tolerant: 1 % off, or a number within the other's range."""
    relative = 0.01 if tolerant else 0.0
    same = is_close(pred["num"], gold["num"], relative) & is_close(pred["min"], gold["min"], relative) & is_close(pred["max"], gold["max"], relative)
    within = lambda n, r: F.coalesce(n["num"].between(r["min"] * (1 - relative), r["max"] * (1 + relative)), F.lit(False))
    equal = same | within(pred, gold) | within(gold, pred) if tolerant else same
    return F.when(pred.isNull() | gold.isNull(), pred.isNull() & gold.isNull()).otherwise(equal)


def money_match(pred: Column, gold: Column, tolerant: bool) -> Column:
    """Struct value, currency: one currency, and equal numbers or 1 % off."""
    return _both(pred, gold, lambda p, g: (p["currency"] == g["currency"]) & is_close(p["value"], g["value"], 0.01 if tolerant else 0.0))


def fee_match(pred: Column, gold: Column, tolerant: bool) -> Column:
    """Struct has_fee, amount. Strict: both alike. Tolerant: a fee whose amount one side doesn't know is the same fee."""
    amounts = lambda p, g: is_close(p["amount"], g["amount"], 0.01 if tolerant else 0.0)
    unknown = lambda p, g: (p["amount"].isNull() | g["amount"].isNull()) if tolerant else F.lit(False)
    return _both(pred, gold, lambda p, g: (p["has_fee"] == g["has_fee"]) & (amounts(p, g) | unknown(p, g)))


def day_match(pred: Column, gold: Column, tolerant: bool) -> Column:
    """Dates that are equal, or a day apart."""
    return _both(pred, gold, lambda p, g: F.abs(F.datediff(p, g)) <= (1 if tolerant else 0))


def kind_match(pred: Column, gold: Column, tolerant: bool) -> Column:
    """Struct kind, value: one kind, and equal numbers or 1 % off."""
    return _both(pred, gold, lambda p, g: (p["kind"] == g["kind"]) & is_close(p["value"], g["value"], 0.01 if tolerant else 0.0))


def list_match(pred: Column, gold: Column, tolerant: bool, least: float = 0.5) -> Column:
    """Arrays of texts. Strict: the same set. Tolerant: of folded texts at least half of either set's union is shared."""

    def alike(p: Column, g: Column) -> Column:
        if not tolerant:
            return (F.size(F.array_except(p, g)) == 0) & (F.size(F.array_except(g, p)) == 0)
        folded = lambda x: F.array_distinct(F.transform(x, lambda t: F.btrim(tr_fold_ascii(t), F.lit(" .,;:!?"))))
        shared, every = F.size(F.array_intersect(folded(p), folded(g))), F.size(F.array_union(folded(p), folded(g)))
        return (every == 0) | (shared >= least * every)

    return _both(pred, gold, alike)


def _both(pred: Column, gold: Column, f) -> Column:
    return F.when(pred.isNull() | gold.isNull(), pred.isNull() & gold.isNull()).otherwise(F.coalesce(f(pred, gold), F.lit(False)))


def fleiss_kappa(labels: DataFrame) -> DataFrame:
    """Units, p_bar, p_expected, kappa of rows (unit, label); units with one label are left out, no unit gives nulls."""
    counts = labels.filter("label is not null").groupBy("unit", "label").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("unit").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("sq")).filter("m >= 2")
    observed = sizes.agg(F.count("*").alias("units"), F.avg((F.col("sq") - F.col("m")) / (F.col("m") * (F.col("m") - 1))).alias("p_bar"), F.sum("m").alias("total"))
    shares = counts.join(sizes.select("unit"), "unit", "left_semi").groupBy("label").agg(F.sum("n").alias("n"))
    expected = shares.agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("sq"))
    p = F.col("sq") / F.col("total") / F.col("total")
    kappa = F.when(F.abs(p - 1) < 1e-9, 1.0).otherwise((F.col("p_bar") - p) / (1 - p))
    return observed.join(expected).select("units", F.round("p_bar", 6).alias("p_bar"), F.round(p, 6).alias("p_expected"), F.round(kappa, 6).alias("kappa"))  # one row each


def krippendorff_alpha(labels: DataFrame, interval: bool) -> DataFrame:
    """N, alpha of rows (unit, value), nominal or interval. Sums over pairs come from counts and moments, so no pairs are made."""
    known = labels.filter("value is not null").select("unit", "value")
    several = known.groupBy("unit").agg(F.count("*").alias("m"), F.sum(F.col("value").cast("double")).alias("s"), F.sum(F.col("value").cast("double") ** 2).alias("q")).filter("m >= 2")
    total = several.agg(F.sum("m").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(2 * (F.col("m") * F.col("q") - F.col("s") ** 2) / (F.col("m") - 1)).alias("o"))
    if interval:
        both = total.withColumn("e", 2 * (F.col("n") * F.col("q") - F.col("s") ** 2))
    else:
        kept = known.join(several.select("unit", "m"), "unit").groupBy("unit", "m", "value").agg(F.count("*").alias("c"))
        unit = kept.groupBy("unit", "m").agg(F.sum(F.col("c") * F.col("c")).alias("sq")).agg(F.sum((F.col("m") * F.col("m") - F.col("sq")) / (F.col("m") - 1)).alias("o"))
        bag = kept.groupBy("value").agg(F.sum("c").alias("c")).agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("sq"))
        both = total.select("n").join(unit).join(bag).withColumn("e", F.col("n").cast("double") * F.col("n") - F.col("sq"))  # one row each
    alpha = F.when(F.col("e") == 0, 1.0).otherwise(1 - (F.col("o") / F.col("n")) / (F.col("e") / F.col("n") / (F.col("n") - 1)))
    return both.select("n", F.round(alpha, 6).alias("alpha"))


def interpret_kappa(k: Column) -> Column:
    """E16"""
    return F.when(k.isNull() | F.isnan(k), "undefined").when(k >= 0.80, "reliable").when(k >= 0.67, "tentative").otherwise("unreliable")


def _poisson(ids: np.ndarray, first: int, rounds: int, seed: int) -> np.ndarray:
    """Poisson(1) weights of each id (rows) in `rounds` rounds from `first` on, from a hash of seed, round and id."""
    of_round = np.arange(first, first + rounds, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0xD1B54A32D192ED03) & (2**64 - 1))
    x = ids[:, None] ^ of_round[None, :]
    for by in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(by)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)
    below = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])  # the rest has a probability of 1e-9
    return np.searchsorted(below, u, side="right")


def resampled(documents: DataFrame, counts: list[str], rounds: int, seed: int) -> DataFrame:
    """round and the sums of the counts of documents (id, counts) weighted for it; the weights follow from seed, round and id alone.

    A task adds up all rounds over its rows, so that the shuffle has a row a round and task, however many documents there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rounds, len(counts)))
        for batch in batches:
            ids = batch.column(0).to_numpy().view(np.uint64)
            values = np.stack([c.fill_null(0).to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:]], 1)
            for k in range(0, len(ids), 4096):
                for r in range(0, rounds, 256):
                    w = _poisson(ids[k : k + 4096], r, min(256, rounds - r), seed)
                    total[r : r + 256] += w.T @ values[k : k + 4096]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rounds, dtype=np.int32)), *map(pa.array, total.T)], ["round", *counts])

    keyed = documents.select(F.xxhash64("id").alias("id"), *counts)
    parts = keyed.mapInArrow(run, "round int, " + ", ".join(f"{c} double" for c in counts))
    return parts.groupBy("round").agg(*[F.sum(c).alias(c) for c in counts])


def _f1(suffix: str = "") -> Column:
    tp, fp, fn = (F.col(c + suffix) for c in ("tp", "fp", "fn"))
    return F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def bootstrap_f1(documents: DataFrame, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """Low, high of micro F1 over documents (id, tp, fp, fn), 95 %."""
    f1 = resampled(documents, ["tp", "fp", "fn"], rounds, seed).select(_f1().alias("f1"))
    return f1.agg(F.percentile("f1", F.lit(0.025)).alias("low"), F.percentile("f1", F.lit(0.975)).alias("high"))


def bootstrap_difference(documents: DataFrame, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """Low, high of the difference of two micro F1 over documents (id, tp_a, fp_a, fn_a, tp_b, fp_b, fn_b), which both arms share in each round."""
    names = [f"{c}_{arm}" for arm in "ab" for c in ("tp", "fp", "fn")]
    d = resampled(documents, names, rounds, seed).select((_f1("_a") - _f1("_b")).alias("d"))
    return d.agg(F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"))


def hard_tags(note: Column, known: list[str]) -> Column:
    """Distinct known tags of a note (#tag), in order."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(note), F.lit("#([\\w-]+)"), F.lit(1)), lambda t: t.isin(*known)))


#: Distinct values whose pairs are summed one by one, and bins of the logarithms of more.
FEW_VALUES, BINS = 4096, 1 << 20


def _ratio_pairs(bag: DataFrame) -> tuple[int, float]:
    """The sums of c, and of c c' ((v - v') / (v + v'))**2 over all ordered pairs, of the values of bag (value, c), which aren't negative.

    The square is tanh((ln v - ln v') / 2)**2, so it depends on the difference of logarithms only: of many values the logarithms
    are binned, and how often each difference occurs comes from one convolution. With BINS bins the mean square is off by
    0.39 ln(largest / smallest) / BINS at most; a zero is at distance 1 of all others.
    """
    few = bag.orderBy("value").limit(FEW_VALUES + 1).collect()
    if len(few) <= FEW_VALUES:
        v, c = np.array([r.value for r in few], float), np.array([r.c for r in few], float)
        total = v[:, None] + v[None, :]
        apart = np.divide(v[:, None] - v[None, :], total, out=np.zeros((len(v), len(v))), where=total != 0) ** 2
        return sum(r.c for r in few), float(c @ apart @ c)
    ends = bag.filter("value > 0").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("c").alias("n")).first()
    zeros = bag.filter("value = 0").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    width = math.log(ends.high / ends.low) / (BINS - 1)
    at = F.least(F.floor(F.ln(F.col("value") / ends.low) / width + 0.5), F.lit(BINS - 1)).cast("int").alias("bin")
    rows = bag.filter("value > 0").groupBy(at).agg(F.sum("c").alias("c")).toArrow()  # BINS rows at most
    c = np.zeros(BINS)
    c[rows["bin"].to_numpy()] = rows["c"].to_numpy()
    times = np.fft.irfft(np.abs(np.fft.rfft(c, 2 * BINS)) ** 2)[:BINS]
    return ends.n + zeros, float(2 * (times * np.tanh(np.arange(BINS) * width / 2) ** 2).sum() + 2.0 * zeros * ends.n)


def krippendorff_ratio(labels: DataFrame) -> DataFrame:
    """N, alpha of rows (unit, value) on a ratio scale, whose values aren't negative. Pairs are made within units only, of distinct values with their counts."""
    known = dealt(labels.filter("value is not null and unit is not null").select("unit", F.col("value").cast("double").alias("value")), "unit")
    counted = known.groupBy("unit", "value").agg(F.count("*").alias("c"))
    cells = counted.withColumn("m", F.sum("c").over(Window.partitionBy("unit"))).filter("m >= 2")
    apart = lambda a, b: F.coalesce(((a - b) / F.nullif(a + b, F.lit(0.0))) ** 2, F.lit(0.0))
    other = counted.select("unit", F.col("value").alias("w"), F.col("c").alias("k"))
    within = cells.join(other, "unit").filter("value < w").agg(F.sum(2 * F.col("c") * F.col("k") * apart(F.col("value"), F.col("w")) / (F.col("m") - 1)).alias("o"))
    n, e = _ratio_pairs(cells.groupBy("value").agg(F.sum("c").alias("c")))
    alpha = F.lit(1.0) if e == 0 else 1 - (F.coalesce("o", F.lit(0.0)) / F.lit(n)) / F.lit(e / n / (n - 1))
    return within.select(F.lit(n or None).cast("long").alias("n"), F.round(alpha, 6).alias("alpha"))
