"""Registered queries on evidence of fields, questions and their answers, and model output, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablarium.operators import ask, fields, guard, model_output
from tablarium.plans.catalogue import cents, query, table, tr
from tablarium.plans.fields import _choose, _say


def _evidence_pages(spark, d) -> DataFrame:
    """k, id, text: a rate, a term at a distance of its trigger, instalments once or twice, a date without a trigger nearby."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("int")
    return table(spark, d, "part").select(
        k.alias("id"),
        _say(
            F.when(k % 4 == 0, "😀 ").otherwise(""), "Kâr payı oranı %", tr(cents("p_retailprice") % 3000 + 100), ". Vade", F.repeat(F.lit(" x"), size), " ", (12 + size).cast("string"), " ay. ",
            F.when(k % 3 == 0, "Peşin 3 taksit ya da 6 taksit. ").otherwise("Peşin 3 taksit. "), "31.12.2026", F.repeat(F.lit(" son"), size), " kampanya.",
        ).alias("text"),
    )


_NEAR = "CASE WHEN {0} <= 15 THEN 0.25 WHEN {0} <= 60 THEN 0.12 ELSE -0.15 END"


@query(f"""
WITH p AS (SELECT p_partkey AS id, CAST(p_size AS INTEGER) AS n, CAST(round(p_retailprice * 100) AS BIGINT) % 3000 + 100 AS c FROM part),
q AS (SELECT *, CAST(c // 100 AS VARCHAR) || ',' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS r, CASE WHEN id % 4 = 0 THEN 2 ELSE 0 END AS o FROM p)
SELECT id, 'kar_payi_orani' AS field, '%' || r || '. ' AS raw, o + 15 AS s, o + 15 + length(r) + 3 AS e, CAST(round(0.95 - CASE WHEN c > 1500 THEN 0.45 ELSE 0 END, 3) AS DOUBLE) AS confidence FROM q
UNION ALL SELECT id, 'vade_ay', (12 + n) || ' ay', o + 15 + length(r) + 1 + 6 + 2 * n + 1, o + 15 + length(r) + 1 + 6 + 2 * n + 1 + 5, round(0.70 + {_NEAR.format('(5 + 2 * n)')}, 3) FROM q
UNION ALL SELECT id, 'taksit_sayisi', '3 taksit', o + 15 + length(r) + 1 + 6 + 2 * n + 1 + 5 + 8, o + 15 + length(r) + 1 + 6 + 2 * n + 1 + 5 + 16, CASE WHEN id % 3 = 0 THEN 0.85 ELSE 0.95 END FROM q
UNION ALL SELECT id, 'kampanya_suresi', '31.12.2026', o + 15 + length(r) + 1 + 6 + 2 * n + 1 + 5 + 18 + CASE WHEN id % 3 = 0 THEN 15 ELSE 0 END, o + 15 + length(r) + 1 + 6 + 2 * n + 1 + 5 + 28 + CASE WHEN id % 3 = 0 THEN 15 ELSE 0 END,
 round(0.70 + {_NEAR.format('(11 + 4 * n)')}, 3) FROM q""")
def field_evidence(spark, d):
    """Where each field stands, the text there, and its confidence: by the distance to its trigger, rivals, and plausibility."""
    return fields.long_fields(fields.campaigns(_evidence_pages(spark, d)), ["id"]).select("id", "field", "raw", "s", "e", "confidence")


@query(r"""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Kâr payı ' || o_clerk_ || ' KÂR PAYINI aldı' WHEN 1 THEN 'Faizsiz ' || o_clerk_ WHEN 2 THEN o_clerk_ || ' konvansiyonel getiriden farkı nedir' WHEN 3 THEN 'kâr payı ' || o_clerk_ ELSE o_clerk_ END AS text,
 CASE o_orderkey % 5 WHEN 0 THEN 'faiz,faizini' WHEN 2 THEN 'faizden' WHEN 3 THEN 'interest' ELSE '' END AS terms FROM (SELECT o_orderkey, o_orderpriority AS o_clerk_ FROM orders)""")
def sanitized_answers(spark, d):
    """QA16: words of interest become others, in their case and as the text means them."""
    c = F.col("o_orderpriority")
    rows = table(spark, d, "orders").withColumn("k", F.col("o_orderkey"))
    text = _choose(5, _say("Faiz ", c, " FAİZİNİ aldı"), _say("Faizsiz ", c), _say(c, " faizden farkı nedir"), _say("interest ", c), c)
    done = rows.select("o_orderkey", guard.sanitize(text).alias("x"))
    return done.select("o_orderkey", "x.text", F.array_join(F.transform("x.violations", lambda v: v["term"]), ",").alias("terms"))


_ASKED = 8
_SHOW = "replace(regexp_replace(printf('%.6f', rate), '[.]?0+$', ''), '.', ',')"
_QUOTE = {k: v.replace("'", "''") for k, v in {"no_source": guard.NO_SOURCE, "rated": guard.DISCLAIMERS["guarantee"], "ruling": guard.RULING_REPLY, "outside": guard.OUT_OF_SCOPE, "terms": guard.NOTICES["terminology"]}.items()}


def _stored(spark, d) -> DataFrame:
    """Two fields of each supplier's campaign; every seventh rate is a range."""
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    value = lambda num, low=None, high=None: F.struct(*[(F.lit(None) if c is None else c).cast("double").alias(n) for n, c in (("num", num), ("min", low), ("max", high), ("value", None))], F.lit(None).cast("string").alias("currency"), F.lit(None).cast("boolean").alias("has_fee"), F.lit(None).cast("double").alias("amount"))
    rate, wide = (100 + k * 37 % 400) / 100, k % 7 == 0
    both = F.array(
        F.struct(F.lit("kar_payi_orani").alias("field"), value(F.when(~wide, rate), F.when(wide, rate), F.when(wide, rate + 1)).alias("value"), (2 * k).alias("seq")),
        F.struct(F.lit("vade_ay").alias("field"), value(12 + k % 48).alias("value"), (2 * k + 1).alias("seq")),
    )
    kind = F.when(k % 3 == 0, "Konut Finansmanı").when(k % 3 == 1, "Taşıt Finansmanı")
    return s.select(k.alias("campaign_id"), F.lower("n_name").alias("bank"), kind.alias("campaign_type"), F.explode(both).alias("f")).select("campaign_id", "bank", "campaign_type", "f.*")


@query(f"""
WITH s AS (SELECT s_suppkey AS k, lower(n_name) AS bank, (100 + s_suppkey * 37 % 400) / 100.0 AS rate, s_suppkey % 7 = 0 AS wide, 12 + s_suppkey % 48 AS months FROM supplier JOIN nation ON s_nationkey = n_nationkey),
b AS (SELECT bank, least(count(*), 20) AS n, arg_min(rate, (rate, k)) FILTER (NOT wide) AS rate FROM s GROUP BY 1),
low AS (SELECT * FROM s WHERE NOT wide ORDER BY rate, k LIMIT 1), far AS (SELECT bank, months FROM s WHERE k % 3 = 0 ORDER BY months DESC, k LIMIT 1),
l AS (SELECT *, row_number() OVER (ORDER BY wide, CASE WHEN NOT wide THEN rate END, k) AS place FROM s WHERE k % 3 = 1 AND months >= 36),
list AS (SELECT least(count(*), 20) AS n, string_agg('- ' || bank || ': %' || {_SHOW} || CASE WHEN wide THEN '–%' || {_SHOW.replace('rate', 'rate + 1')} || '  _(not: range)_' ELSE '' END, chr(10) ORDER BY place) FILTER (place <= 20) AS lines FROM l),
c AS (SELECT c_custkey, c_custkey % {_ASKED} AS q, lower(n_name) AS bank, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2 FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN part ON p_partkey = 1 + c_custkey % 200),
v AS (SELECT 1 + i % 200 AS p, i FROM range(0) r(i)),
o AS (SELECT c_custkey, q, CASE q WHEN 0 THEN coalesce(b.n, 0) WHEN 1 THEN (SELECT least(count(*), 20) FROM s WHERE k % 3 = 0) WHEN 2 THEN (SELECT n FROM list) WHEN 7 THEN (SELECT least(count(*), 20) FROM s) ELSE 1 END AS sources, b.rate, c.bank FROM c LEFT JOIN b ON b.bank = c.bank)
SELECT c_custkey AS id, CASE WHEN q IN (3, 4) THEN 'safety' ELSE 'structured' END AS handler, sources,
 CASE q WHEN 0 THEN CASE WHEN sources = 0 THEN '{_QUOTE["no_source"]}' WHEN rate IS NULL THEN '{ask.INCOMPARABLE}' || chr(10) || chr(10) || '{_QUOTE["rated"]}' ELSE 'en düşük kâr payı oranı: **' || bank || '** (%' || {_SHOW} || ').' || chr(10) || chr(10) || '{_QUOTE["rated"]}' END
  WHEN 1 THEN CASE WHEN sources = 0 THEN '{_QUOTE["no_source"]}' ELSE (SELECT 'en yüksek vade: **' || bank || '** (' || months || ' ay).' FROM far) END
  WHEN 2 THEN CASE WHEN sources = 0 THEN '{_QUOTE["no_source"]}' ELSE 'Taşıt Finansmanı — kâr payı oranı (uygun kampanyalar):' || chr(10) || (SELECT lines FROM list) || chr(10) || chr(10) || '{_QUOTE["rated"]}' END
  WHEN 3 THEN '{_QUOTE["ruling"]}' WHEN 4 THEN '{_QUOTE["outside"]}'
  WHEN 7 THEN '{_QUOTE["terms"]}' || chr(10) || chr(10) || (SELECT 'en düşük kâr payı oranı: **' || bank || '** (%' || {_SHOW} || ').' FROM low) || chr(10) || chr(10) || '{_QUOTE["rated"]}' END AS answer,
 CASE q WHEN 0 THEN CASE WHEN sources = 0 THEN 'abstention' ELSE 'guarantee' END WHEN 1 THEN CASE WHEN sources = 0 THEN 'abstention' ELSE '' END WHEN 2 THEN CASE WHEN sources = 0 THEN 'abstention' ELSE 'guarantee' END WHEN 3 THEN 'ruling' WHEN 4 THEN 'abstention' WHEN 7 THEN 'terminology,guarantee' END AS gates
FROM o WHERE q NOT IN (5, 6)""")
def answered_questions(spark, d):
    """QA14, QA16, QA17: questions on stored fields, answered at once; those that are quoted from texts are in quoted_questions."""
    return _answered(spark, d).filter("id % 8 not in (5, 6)").select("id", "handler", "sources", "answer", F.array_join("gates", ",").alias("gates"))


def _answered(spark, d) -> DataFrame:
    nations = table(spark, d, "nation")
    c = table(spark, d, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("k", F.col("c_custkey"))  # 25 nations
    question = _choose(
        _ASKED, _say(F.lower("n_name"), " bankasında en düşük kâr payı oranı nedir?"), "Konut kampanyalarında en yüksek vade nedir?", "36 ay ve üzeri veren Taşıt kampanyalarının kâr payı nedir?", "Bu kampanya CAİZ mi?", "Bugün hava nasıl?",
        "kampanya metni", "kampanya", "Kampanyada faiz en düşük hangi bankada?",
    )
    aliases = {n.lower(): n.lower() for (n,) in nations.select("n_name").collect()}
    texts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("bank"), F.col("p_name").alias("text"))
    return ask.ask(c.select(F.col("k").alias("id"), question.alias("question")), _stored(spark, d), texts, aliases, ["kampanya", "banka", "kar payi", "vade"])


@query("""
WITH t AS (SELECT p_partkey AS id, p_brand AS bank, p_name AS text, list_distinct(regexp_extract_all(replace(lower(p_name), 'i̇', 'i'), '[a-zçğıöşü0-9]+')) AS w FROM part),
q AS (SELECT DISTINCT p_type, list_distinct(regexp_extract_all(replace(replace(p_name, 'I', 'ı'), 'İ', 'i'), '[a-zçğıöşü0-9]+')) AS w, p_partkey AS id FROM part WHERE p_partkey % 5 = 0),
o AS (SELECT q.id, t.id AS text_id, t.bank, t.text, len(list_intersect(q.w, t.w)) AS n FROM q, t), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, text_id) AS place FROM o WHERE n >= 2)
SELECT id, 'İlgili kampanya (' || min(bank) FILTER (place = 1) || '): ' || min(text) FILTER (place = 1) AS body, count(*) FILTER (place <= 3) AS sources FROM r GROUP BY 1""")
def quoted_questions(spark, d):
    """QA7, QA13: the names of parts as questions over the names of all parts; every fifth part asks."""
    p = table(spark, d, "part")
    texts = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("bank"), F.col("p_name").alias("text"))
    return ask.quoted(p.filter("p_partkey % 5 = 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("question")), texts)


_READ = """
SELECT o_orderkey, CASE WHEN q < 6 THEN o_orderkey END AS key, CASE WHEN q IN (0, 1, 2, 4, 5) THEN 'a{"}b' WHEN q = 3 THEN 'ab' END AS note, CASE q WHEN 6 THEN 'not closed' WHEN 7 THEN 'no object' WHEN 8 THEN 'not JSON' WHEN 9 THEN 'empty' END AS error
FROM (SELECT o_orderkey, o_orderkey % 10 AS q FROM orders)"""


@query(_READ)
def model_objects(spark, d):
    """Objects with brackets and quotes in strings, behind thoughts, in fences, with commas too many, in single quotes, cut off, or none."""
    rows = table(spark, d, "orders").withColumn("k", F.col("o_orderkey"))
    key = F.col("k").cast("string")
    whole = _say('{"key": ', key, ', "in": {"note": "a{\\"}b"}}')
    text = _choose(
        10, whole, _say("<think>{ x }</think> cevap: ", whole, " } {"), _say("```json\n", whole, "\n``` son"), _say("{'key': ", key, ", 'in': {'note': 'ab'},}"), _say('{"key": ', key, ', "in": {"note": "a{\\"}b",}, }'), _say(whole, whole),
        _say('{"key": ', key, ', "in": {"note": "a}"}'), "cevap yok", _say("{key: ", key, "}"), " ",
    )
    read = rows.select("o_orderkey", model_output.read_object(text).alias("x"))
    parts = F.from_json("x.json", "key bigint, in struct<note: string>")
    return read.select("o_orderkey", parts["key"].alias("key"), parts["in"]["note"].alias("note"), "x.error")


@query("""
WITH x AS (SELECT l_orderkey AS id, l_linenumber AS n, -l_discount AS lp FROM lineitem), v AS (SELECT id, avg(lp) FILTER (n <= 3) AS a, avg(lp) FILTER (n > 3) AS b FROM x GROUP BY 1)
SELECT id, 'vade_ay' AS field, round(greatest(least(exp(a), 0.99), 0.01), 9) AS confidence FROM v WHERE a IS NOT NULL UNION ALL SELECT id, 'kar_payi_orani', round(greatest(least(exp(b), 0.99), 0.01), 9) FROM v WHERE b IS NOT NULL""")
def token_confidences(spark, d):
    """Lines of an order as the tokens of two values in an answer; tokens around them don't count."""
    x = table(spark, d, "lineitem").filter("l_linenumber is not null").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), (-F.col("l_discount")).alias("logprob"))
    short, long = F.col("short"), F.col("long")
    said = lambda pos, text, when=F.lit(True): F.when(when, F.struct(F.lit(pos).alias("pos"), F.lit(text).alias("token"), F.lit(-50.0).alias("logprob")))
    around = F.array_compact(F.array(
        said(0, '<think>"vade_ay": {"value": 9}</think>'), said(1, "{"), said(2, '"vade_ay": {"value": ', short), said(20, ', "unit": "ay"}', short),
        said(21, ",", short & long), said(22, '"kar_payi_orani" : { "value":', long), said(50, "}", long), said(60, "}"),
    ))
    orders = x.groupBy("id").agg(F.bool_or(F.col("n") <= 3).alias("short"), F.bool_or(F.col("n") > 3).alias("long"))
    values = x.select("id", (F.col("n") + F.when(F.col("n") <= 3, 10).otherwise(30)).alias("pos"), F.col("n").cast("string").alias("token"), "logprob")
    every = orders.select("id", F.explode_outer(around).alias("t")).select("id", "t.*").unionByName(values)
    # the thought holds an object of its own, so it is cut off, as an answer's is
    return model_output.field_confidences(every.filter("pos > 0"), ["vade_ay", "kar_payi_orani"]).select("id", "field", F.round("confidence", 9).alias("confidence"))
