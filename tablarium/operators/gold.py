"""Gold data: values as text, their validation, review rows, decisions of several annotators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablarium.functions.normalize import normalize_date, normalize_fee_status, normalize_money, normalize_rate, normalize_term_months, parse_tr_number
from tablarium.functions.spread import dealt
from tablarium.functions.text import let, normalize_whitespace
from tablarium.operators.classify import TYPES
from tablarium.operators.fields import FIELDS
from tablarium.operators.offers import AUDIENCES

#: Fields by the form of their values, tags of hard cases, verdicts, bounds and widths of review rows.
RATES, MONEY, COUNTS = ("kar_payi_orani", "indirim_orani"), ("finansman_tutari", "tahsis_ucreti", "odul_miktari"), ("vade_ay", "taksit_sayisi")
HARD_TAGS = ("terminoloji", "format_varyant", "eksik_bilgi", "celiskili", "kosullu_aralik", "tr_ortografi", "legacy")
VERDICTS = ("ok", "fix", "absent", "unclear")
LOW, HIGH, PAD, CONTEXT = 0.60, 0.85, 120, 240
#: The parts of a canonical value, as JSON has them.
VALUE = "num double, min double, max double, value double, currency string, has_fee boolean, amount double, kind string, day string, items array<string>"


def format_value(v: Column) -> Column:
    """A canonical value (struct of VALUE) as text without loss: its JSON without nulls; null stays null."""
    return F.when(v.isNotNull(), F.to_json(v))


def parse_value(field: Column, text: Column) -> Column:
    """Struct of VALUE from JSON, or from text as annotators write it (`%1,89`, `500 TL`, `1 yıl`, `puan=1000`, `a|b`); null if it can't be read."""

    def typed(x: Column) -> Column:
        f, t = x["f"], x["t"]
        rate, money, fee = normalize_rate(t), normalize_money(t), normalize_fee_status(t)
        months = F.when(f == "vade_ay", normalize_term_months(t))
        points = "(?i)^(rate|oran|points|puan)\\s*[:=]\\s*(.+)$"
        items = F.filter(F.transform(F.split(t, "\\|"), lambda p: F.trim(p)), lambda p: p != "")
        written = (
            F.when(f.isin(*RATES), let(rate, lambda r: _value(r.isNotNull(), num=r["num"], min=r["min"], max=r["max"])))
            .when(f.isin(*MONEY), let(money, lambda m: _value(m.isNotNull(), value=m["value"], currency=m["currency"])))
            .when(f.isin(*COUNTS), let(F.coalesce(months, F.bround(parse_tr_number(t))), lambda n: _value(n.isNotNull(), num=n)))
            .when(f == "kampanya_suresi", let(normalize_date(t), lambda d: _value(d.isNotNull(), day=d.cast("string"))))
            .when(f == "masraf_durumu", let(fee, lambda m: _value(m.isNotNull(), has_fee=m["has_fee"], amount=m["amount"])))
            .when(f == "alisveris_puani", let(parse_tr_number(F.regexp_extract(t, points, 2)), lambda n: _value(n.isNotNull(), value=n, kind=F.when(F.lower(F.regexp_extract(t, points, 1)).isin("rate", "oran"), "rate").otherwise("points"))))
            .otherwise(_value(F.size(items) > 0, items=items))
        )
        return F.when(t.startswith("{"), F.from_json(t, VALUE)).when(t != "", written)

    return let(F.struct(field.alias("f"), F.trim(text).alias("t")), typed)


def _value(when: Column, **parts: Column) -> Column:
    columns = [parts.get(n, F.lit(None)).cast(t).alias(n) for n, t in (p.strip().split(" ", 1) for p in VALUE.split(","))]
    return F.when(when, F.struct(*columns))


def validate_value(field: Column, v: Column) -> Column:
    """What is wrong with a canonical value (struct of VALUE), or null."""
    given = lambda *names: [n for n in ("num", "min", "max", "value", "currency", "has_fee", "amount", "kind", "day", "items") if n not in names]
    only = lambda *names: F.coalesce(*[v[n].cast("string") if n != "items" else F.array_join(v[n], "") for n in given(*names)]).isNull()
    whole = F.when(~only("num") | v["num"].isNull() | (v["num"] != F.floor(v["num"])), "not a whole number").when(v["num"] <= 0, "not positive")
    range_ = F.when(v["min"] > v["max"], "min above max").when(v["min"] == v["max"], "min equals max")
    rate = F.when(only("num") & v["num"].isNotNull(), F.lit(None)).when(only("min", "max") & v["min"].isNotNull() & v["max"].isNotNull(), range_).otherwise("not a rate")
    money = F.when(~only("value", "currency") | v["value"].isNull(), "not money").when(F.coalesce(v["currency"] != "TRY", F.lit(True)), "currency")
    fee = F.when(~only("has_fee", "amount") | v["has_fee"].isNull(), "not a fee").when(~v["has_fee"] & F.coalesce(v["amount"] != 0, F.lit(True)), "amount without a fee")
    points = F.when(~only("kind", "value") | v["value"].isNull() | ~F.coalesce(v["kind"].isin("rate", "points"), F.lit(False)), "not points")
    day = F.when(~only("day") | v["day"].isNull() | (F.coalesce(normalize_date(v["day"]).cast("string"), F.lit("")) != v["day"]), "not an ISO date")
    empty = ~only("items") | (F.coalesce(F.size(v["items"]), F.lit(0)) <= 0)
    labels = F.when(empty, "no labels").when(F.size(F.array_except(v["items"], F.array(*map(F.lit, AUDIENCES)))) > 0, "unknown label").when(F.size(F.array_distinct(v["items"])) < F.size(v["items"]), "repeated label")
    texts = F.when(empty, "no texts").when(F.exists(v["items"], lambda x: x.isNull() | (F.trim(x) == "")), "empty text")
    return (
        F.when(~field.isin(*FIELDS), "unknown field").when(v.isNull(), "no value").when(field.isin(*RATES), rate).when(field.isin(*MONEY), money).when(field.isin(*COUNTS), whole)
        .when(field == "kampanya_suresi", day).when(field == "masraf_durumu", fee).when(field == "alisveris_puani", points).when(field == "hedef_kitle", labels).otherwise(texts)
    )


def validate_records(records: DataFrame) -> DataFrame:
    """Id, error of records (id, text, campaign_type, hard_tags, fields as array<struct<field, value>>, absent_fields, unclear_fields).

    Values, names, tags and types are checked; a field has a value or is absent or unclear; ids occur once (counted, not collected).
    """
    names = F.transform("fields", lambda f: f["field"])
    unknown = lambda c, known: F.array_except(F.coalesce(c, F.array().cast("array<string>")), F.array(*map(F.lit, known)))
    each = F.transform(unknown("hard_tags", HARD_TAGS), lambda t: F.concat(F.lit("unknown tag "), t))
    wrong = F.array_compact(F.transform("fields", lambda f: let(validate_value(f["field"], f["value"]), lambda e: F.when(e.isNotNull(), F.concat(f["field"], F.lit(": "), e)))))
    both = F.transform(F.array_intersect(names, F.coalesce("absent_fields", F.array().cast("array<string>"))), lambda n: F.concat(n, F.lit(" has a value and is absent")))
    vague = F.transform(F.array_intersect(names, F.coalesce("unclear_fields", F.array().cast("array<string>"))), lambda n: F.concat(n, F.lit(" has a value and is unclear")))
    absent = F.transform(unknown("absent_fields", FIELDS), lambda n: F.concat(F.lit("unknown absent field "), n))
    whole = F.array_compact(F.array(
        F.when(F.coalesce("id", F.lit("")) == "", "no id"), F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "no text"),
        F.when(F.col("campaign_type").isNotNull() & ~F.col("campaign_type").isin(*TYPES), "unknown type"),
    ))
    found = records.select("id", F.explode_outer(F.concat(whole, each, wrong, absent, both, vague)).alias("error")).filter("error is not null")
    again = records.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit("repeated id").alias("error"))
    return found.unionByName(again)


def layer_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Both layers' values (keys, field, value) side by side; disagreement where both have one and they differ."""
    x, y = (df.select(*keys, "field", F.col("value").alias(n)) for df, n in ((a, "first"), (b, "second")))
    both = x.join(y, [*keys, "field"], "full_outer")
    return both.withColumn("disagreement", F.coalesce(F.col("first") != F.col("second"), F.lit(False)))


def snippet(text: Column, start: Column, end: Column, raw: Column, pad: int = PAD) -> Column:
    """The value in brackets between up to `pad` characters each side; without place or value the text's beginning."""

    def cut(x: Column) -> Column:
        t, s, e = x["t"], x["s"], x["e"]
        left, right = F.greatest(s - pad, F.lit(0)), F.least(e + pad, F.length(t))
        part = lambda i, j: F.substring(t, i + 1, j - i)
        marked = F.concat(F.when(left > 0, "…").otherwise(""), part(left, s), F.lit("["), part(s, e), F.lit("]"), part(e, right), F.when(right < F.length(t), "…").otherwise(""))
        head = F.concat(normalize_whitespace(F.substring(t, 1, CONTEXT)), F.when(F.length(t) > CONTEXT, " …").otherwise(""))
        return F.when(s.isNotNull(), normalize_whitespace(marked)).otherwise(head)

    inside = F.coalesce((start >= 0) & (start <= end) & (end <= F.length(text)), F.lit(False))
    at = F.position(F.nullif(raw, F.lit("")), text) - 1
    s = F.when(inside, start).when(at >= 0, at)
    return let(F.struct(text.alias("t"), s.alias("s"), F.when(inside, end).when(at >= 0, at + F.length(raw)).alias("e")), cut)


def review_bucket(has_value: Column, disagreement: Column, confidence: Column) -> Column:
    """The order of review: 0 layers differ, 1 middling, 2 low, 3 high confidence, 4 no value."""
    c = F.coalesce(confidence, F.lit(0.0))
    return F.when(~has_value, 4).when(F.coalesce(disagreement, F.lit(False)), 0).when(c >= HIGH, 3).when(c >= LOW, 1).otherwise(2)


def review_order(rows: DataFrame) -> DataFrame:
    """Rows (bucket, doc_id, field) in the order of review."""
    place = F.array_position(F.array(F.lit("campaign_type"), *map(F.lit, FIELDS)), F.col("field"))
    return rows.orderBy("bucket", "doc_id", F.when(place == 0, 99).otherwise(place))


def merge_verdicts(rows: DataFrame) -> DataFrame:
    """doc_id, field, decision (value, absent, unclear, conflict), value of reviewed rows (doc_id, field, verdict, model_value, gold_value).

    Documents that someone finds without a campaign type are no campaigns, and are left out. A blank verdict is ok; fix takes the gold value; ok without a model's value is absent. Annotators who differ make a conflict.
    """
    verdict = F.coalesce(F.nullif(F.lower(F.trim("verdict")), F.lit("")), F.lit("ok"))
    value = F.when(verdict == "fix", F.col("gold_value")).when(verdict == "ok", F.nullif("model_value", F.lit("")))
    kind = F.when(verdict == "unclear", "unclear").when((verdict == "absent") | value.isNull(), "absent").otherwise("value")
    outside = F.coalesce((F.col("field") == "campaign_type") & (verdict == "absent") & F.col("doc_id").isNotNull(), F.lit(False))
    one = dealt(rows.select("doc_id", "field", kind.alias("kind"), F.when(kind == "value", value).alias("value"), outside.alias("outside")), "doc_id")
    # kinds and values in one order, so two that are equal at both ends are all equal
    said = F.struct("kind", F.coalesce("value", F.lit("")).alias("value"))
    both = one.groupBy("doc_id", "field").agg(F.min(said).alias("low"), F.max(said).alias("high"), F.bool_or("outside").alias("outside"))
    kept = both.withColumn("outside", F.bool_or("outside").over(Window.partitionBy("doc_id"))).filter("not outside")  # a document has a few fields
    agree = F.col("low") == F.col("high")
    return kept.select("doc_id", "field", F.when(agree, F.col("low.kind")).otherwise("conflict").alias("decision"), F.when(agree & (F.col("low.kind") == "value"), F.col("low.value")).alias("value"))


def midpoint(v: Column) -> Column:
    """The number that annotators' values are compared by; a range counts as its middle."""
    return F.coalesce(v["num"], (v["min"] + v["max"]) / 2, v["value"], v["amount"])


def align(labels: DataFrame, least: int = 2) -> DataFrame:
    """Unit, annotators, values (sorted by annotator) of labels (unit, annotator, value) that at least `least` annotators share; one has a label or two."""
    one = labels.groupBy("unit", "annotator").agg(F.min("value").alias("value"))
    grouped = one.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("annotator", "value"))).alias("x"))  # as many as there are annotators
    return grouped.filter(F.size("x") >= least).select("unit", F.transform("x", lambda p: p["annotator"]).alias("annotators"), F.transform("x", lambda p: p["value"]).alias("values"))


def split_balance(rows: DataFrame) -> DataFrame:
    """Split, stratum, n of split rows."""
    return rows.groupBy("split", "stratum").agg(F.count("*").alias("n"))


def accesses(log: DataFrame, frozen: DataFrame) -> DataFrame:
    """Split, reads, changed of a log (split, digest) of reads of frozen splits (split, digest): how often each was read, and how often it wasn't what was frozen."""
    seen = log.select("split", F.col("digest").alias("read")).join(frozen.select("split", "digest"), "split")
    return seen.groupBy("split").agg(F.count("*").alias("reads"), F.count(F.when(~F.col("read").eqNullSafe(F.col("digest")), 1)).alias("changed"))


def freeze(rows: DataFrame, key: str) -> DataFrame:
    """Split, n, digest: a checksum of each split's keys that doesn't depend on their order, to be kept and compared later."""
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.hex(F.bit_xor(F.xxhash64(F.col(key).cast("string")))).alias("digest"))
