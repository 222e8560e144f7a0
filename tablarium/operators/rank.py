"""Fair ranking on one field, and a composite score of average ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Weights of the composite score, fields where less is better, least share of weight, least group.
WEIGHTS = {"kar_payi_orani": 0.40, "masraf_durumu": 0.20, "odul_miktari": 0.15, "vade_ay": 0.15, "finansman_tutari": 0.10}
LOWER_IS_BETTER = ("kar_payi_orani", "masraf_durumu", "tahsis_ucreti")
MIN_COVERAGE, MIN_GROUP = 0.5, 3


HIGHER_IS_BETTER = ("vade_ay", "finansman_tutari", "odul_miktari", "indirim_orani", "alisveris_puani", "taksit_sayisi")
RATIONALE = {
    "kar_payi_orani": "largest effect on the total cost", "masraf_durumu": "paid at once, whatever the term", "odul_miktari": "a benefit that not every customer gets",
    "vade_ay": "lowers the instalment but not the cost", "finansman_tutari": "a limit rather than a price",
}

#: Rows that one task puts in order; more are dealt into parts.
FEW_ROWS = 200_000
#: Parts into which keys are dealt before they are ordered, and the accuracy of the bounds between them.
PARTS, ACCURACY = 256, 10_000


def numeric_key(v: Column) -> Column:
    """Struct key, comparable, note of a canonical value (num, min, max, value, currency, has_fee, amount)."""
    key = lambda k, ok, note: F.struct(k.cast("double").alias("key"), F.lit(ok).alias("comparable"), F.lit(note).cast("string").alias("note"))
    wide = v["min"].isNotNull() & v["max"].isNotNull()
    return (
        F.when(wide & (v["min"] == v["max"]), key(v["min"], True, None)).when(wide, key(v["min"], False, "range"))
        .when(v["value"].isNotNull() & (v["currency"] != "TRY"), key(F.lit(None), False, "currency")).when(v["value"].isNotNull(), key(v["value"], True, None))
        .when(v["has_fee"].isNotNull(), key(F.coalesce(v["amount"], F.lit(0.0)), True, None)).when(v["num"].isNotNull(), key(v["num"], True, None))
        .when(v.isNull(), key(F.lit(None), False, "missing")).otherwise(key(F.lit(None), False, "not numeric"))
    )


def composite_key(field: Column, v: Column) -> Column:
    """Number that the composite score takes: a fee without amount has none, a range gives its better end, a fee as a rate none."""
    lower = field.isin(*LOWER_IS_BETTER)
    return (
        F.when(v["has_fee"].isNotNull(), F.when(~v["has_fee"], F.lit(0.0)).otherwise(v["amount"])).when(v["min"].isNotNull() & v["max"].isNotNull(), F.when(lower, v["min"]).otherwise(v["max"]))
        .when(v["value"].isNotNull(), F.when(F.coalesce(v["currency"], F.lit("TRY")) == "TRY", v["value"])).otherwise(v["num"])
    )


def direction(field: Column) -> Column:
    """X21"""
    return F.when(field.isin(*LOWER_IS_BETTER), "lower_is_better").when(field.isin(*HIGHER_IS_BETTER), "higher_is_better").otherwise("unranked")


def manifest(spark: SparkSession, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Field, weight, rationale, direction, the heaviest first."""
    rows = spark.createDataFrame([(k, w, RATIONALE.get(k)) for k, w in weights.items()], "field string, weight double, rationale string")
    return rows.withColumn("direction", direction(F.col("field"))).orderBy(F.col("weight").desc(), "field")


def _bounds(df: DataFrame, key: str) -> Column:
    """An array of about PARTS values that part the rows evenly; they are the plan's constants, so each branch deals rows alike."""
    at = F.array(*[F.lit(k / PARTS) for k in range(1, PARTS)])
    return F.array(*map(F.lit, sorted(set(df.agg(F.percentile_approx(key, at, F.lit(ACCURACY)).alias("b")).first()["b"] or []))))


def _part(key: Column, bounds: Column) -> Column:
    """How many of the sorted bounds, fewer than PARTS, are below key: halved, not compared one by one."""
    steps = F.array(*[F.lit(PARTS >> k) for k in range(1, PARTS.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(bounds, n + step - 1) < key, n + step).otherwise(n))


def rank(rows: DataFrame, descending: bool = False) -> DataFrame:
    """Position of rows (id, num, min, max, currency, seq): ranges and other currencies have no position.

    Rows are dealt by their key, and rows of a part with one key only also by seq, so that no task orders all of them;
    a row's part follows from its values, not from where it lies. Equal keys are ordered by seq.
    """
    comparable = F.col("num").isNotNull() & F.coalesce(F.col("currency") == "TRY", F.lit(True))
    key = F.coalesce("num", "min")
    df = rows.select("id", "seq", F.when(comparable | F.col("min").isNotNull(), key).alias("sort_key"), comparable.alias("comparable"))
    good = df.filter("comparable").withColumn("k", (-1 if descending else 1) * F.col("sort_key"))
    rest = df.filter("not comparable").select("id", "sort_key", "comparable", F.lit(None).cast("bigint").alias("position"))
    if good.limit(FEW_ROWS + 1).count() <= FEW_ROWS:
        return good.select("id", "sort_key", "comparable", F.row_number().over(Window.orderBy("k", "seq")).cast("bigint").alias("position")).unionByName(rest)
    dealt = good.withColumn("p", _part(F.col("k"), _bounds(good, "k")))
    single = dealt.groupBy("p").agg((F.min("k") == F.max("k")).alias("single"))  # a row for each part, as below
    dealt = dealt.join(F.broadcast(single), "p").withColumn("q", F.when(F.col("single"), _part(F.col("seq"), _bounds(good, "seq"))).otherwise(0))
    sizes = dealt.groupBy("p", "q").agg(F.count("*").alias("size"))
    before = sizes.select("p", "q", (F.sum("size").over(Window.orderBy("p", "q")) - F.col("size")).alias("before"))
    n = F.row_number().over(Window.partitionBy("p", "q").orderBy("k", "seq"))
    placed = dealt.withColumn("n", n).join(F.broadcast(before), ["p", "q"]).select("id", "sort_key", "comparable", (F.col("n") + F.col("before")).alias("position"))
    return placed.unionByName(rest)


def best(rows: DataFrame, descending: bool = False) -> DataFrame:
    """The first comparable row."""
    good = rows.filter(F.col("num").isNotNull() & F.coalesce(F.col("currency") == "TRY", F.lit(True)))
    return good.orderBy(F.col("num").desc() if descending else F.col("num"), "seq").select("id", F.col("num").alias("sort_key")).limit(1)


def ordinal(df: DataFrame, group: list[str], key: str) -> DataFrame:
    """group, key, n (rows with that key) and before (rows of the group with a smaller key), one row for each key.

    Rows are counted before they are ordered, and the keys of a group are ordered in parts.
    """
    cells = df.groupBy(*group, key).agg(F.count("*").alias("n"))
    if cells.limit(FEW_ROWS + 1).count() <= FEW_ROWS:
        return cells.withColumn("before", F.sum("n").over(Window.partitionBy(*group).orderBy(key)) - F.col("n"))
    at = F.array(*[F.lit(k / PARTS) for k in range(1, PARTS)])
    bounds = cells.groupBy(*group).agg(F.percentile_approx(key, at, F.lit(1000)).alias("bounds"))
    dealt = (cells.join(bounds, group) if group else cells.join(bounds)).withColumn("part", _part(F.col(key), F.col("bounds"))).drop("bounds")  # one row without groups
    sizes = dealt.groupBy(*group, "part").agg(F.sum("n").alias("size"))
    start = sizes.select(*group, "part", (F.sum("size").over(Window.partitionBy(*group).orderBy("part")) - F.col("size")).alias("start"))
    within = F.sum("n").over(Window.partitionBy(*group, "part").orderBy(key)) - F.col("n")
    return dealt.withColumn("within", within).join(start, [*group, "part"]).select(*group, key, "n", (F.col("within") + F.col("start")).alias("before"))


def rank_normalized(long: DataFrame, group: list[str]) -> DataFrame:
    """Long (…, value, lower) with norm: 1 for the best average rank of a group, 0 for the worst; ties share; alone: 1. Groups aren't null."""
    signed = long.withColumn("signed", F.when(F.col("lower"), F.col("value")).otherwise(-F.col("value")))
    order = ordinal(signed, group, "signed")
    # from the rows, not from their order, which the plan would hold twice
    sizes = signed.groupBy(*group).agg(F.count("*").alias("size"), (F.min("signed") == F.max("signed")).alias("alone"))
    norms = order.join(sizes, group).select(*group, "signed", F.when(F.col("alone"), 1.0).otherwise(1 - (F.col("before") + (F.col("n") - 1) / 2) / (F.col("size") - 1)).alias("norm"))
    return signed.join(norms, [*group, "signed"]).select(*long.columns, "norm")


def composite(rows: DataFrame, by_type: bool = False, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Id, campaign_type, score, coverage, comparable of rows (id, campaign_type, a column for each weight).

    The score is the weighted mean norm of the fields present; coverage is their share of the weight of all fields that
    anyone (of the type) has. Below MIN_COVERAGE, or in groups of under MIN_GROUP, a row isn't comparable.
    """
    kind = F.coalesce("campaign_type", F.lit("Sınıflandırılamadı")) if by_type else F.lit("all")
    base = rows.select("id", kind.alias("campaign_type"), *weights)
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(w).alias("w"), F.lit(f in LOWER_IS_BETTER).alias("lower"), F.col(f).cast("double").alias("value")) for f, w in weights.items()]))
    long = base.select("id", "campaign_type", cells.alias("c")).select("id", "campaign_type", "c.*").filter("value is not null")
    scored = rank_normalized(long, ["campaign_type", "field"])
    active = long.groupBy("campaign_type", "field").agg(F.max("w").alias("w")).groupBy("campaign_type").agg(F.sum("w").alias("active"))
    each = scored.groupBy("id", "campaign_type").agg(F.sum(F.col("w") * F.col("norm")).alias("s"), F.sum("w").alias("present"))
    sizes = base.groupBy("campaign_type").agg(F.count("*").alias("size"))
    out = base.select("id", "campaign_type").join(each, ["id", "campaign_type"], "left").join(F.broadcast(active), "campaign_type", "left").join(F.broadcast(sizes), "campaign_type")
    coverage = F.coalesce(F.col("present") / F.col("active"), F.lit(0.0))
    enough = (F.col("size") >= MIN_GROUP) if by_type else F.lit(True)
    return out.select(
        "id", "campaign_type", F.when(enough, F.round(F.col("s") / F.col("present"), 6)).alias("score"), F.round(coverage, 6).alias("coverage"),
        (enough & (F.round(coverage, 9) >= MIN_COVERAGE)).alias("comparable"),
    )


def best_composite(scored: DataFrame) -> DataFrame:
    """The best comparable row of composite(); ties go to the larger coverage, then the smaller id."""
    return scored.filter("comparable").orderBy(F.col("score").desc(), F.col("coverage").desc(), "id").limit(1)


def best_by_type(scored: DataFrame) -> DataFrame:
    """The best comparable id of each type, or null."""
    key = F.when(F.col("comparable"), F.struct(F.col("score"), F.col("coverage"), -F.col("id")))  # rows without a key don't count
    return scored.groupBy("campaign_type").agg(F.max_by("id", key).alias("id"), F.max(F.when(F.col("comparable"), F.col("score"))).alias("score"))
