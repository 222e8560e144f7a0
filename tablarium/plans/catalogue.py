"""Registered queries and their SQL. Texts are rendered from numeric columns; the SQL selects those columns, not the texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablarium.functions import normalize as N
from tablarium.functions import text as T
from tablarium.functions.spread import spread
from tablarium.operators import classify, contradict, evaluate, extract, fields, rank, retrieve, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


def tr(c: Column) -> Column:
    """Cents as Turkish text: 1.500,00."""
    whole = F.regexp_replace((c - c % 100).cast("string"), "00$", "")
    return F.concat(F.when(c < 100, "0").otherwise(F.regexp_replace(whole, "(?<=\\d)(?=(\\d{3})+$)", ".")), F.lit(","), F.lpad((c % 100).cast("string"), 2, "0"))


@query("SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) / 100.0 AS value FROM lineitem")
def tr_number_parse(spark, d):
    """N01"""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", N.parse_tr_number(tr(cents("l_extendedprice"))).alias("value"))


def _rates(spark, d) -> DataFrame:
    lo, width = 100 + F.col("l_linenumber") * 7, cents("l_discount")
    text = F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("%"), tr(lo), F.lit(" - %"), tr(lo + width))).otherwise(F.concat(F.lit("%"), tr(lo)))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.alias("rate"))


_RATE_SQL = """
SELECT l_orderkey, l_linenumber, CASE WHEN w > 0 THEN NULL ELSE lo / 100.0 END AS num,
  CASE WHEN w > 0 THEN lo / 100.0 END AS min, CASE WHEN w > 0 THEN (lo + w) / 100.0 END AS max
FROM (SELECT l_orderkey, l_linenumber, 100 + l_linenumber * 7 AS lo, CASE WHEN l_orderkey % 3 = 0 THEN CAST(round(l_discount * 100) AS BIGINT) ELSE 0 END AS w FROM lineitem)"""


@query(_RATE_SQL)
def tr_rate_range(spark, d):
    """N02, N03"""
    return _rates(spark, d).select("l_orderkey", "l_linenumber", N.normalize_rate(F.col("rate")).alias("r")).select("l_orderkey", "l_linenumber", "r.*")


@query(_RATE_SQL)
def extract_rate(spark, d):
    """The rate before or after the phrase, with a term that must not be taken for it."""
    before = F.concat(F.col("rate"), F.lit(" kâr payı oranı ile 120 aya kadar"))
    after = F.concat(F.lit("Konut finansmanında KÂR PAYI oranı: "), F.col("rate"), F.lit(" ve 36 ay vade"))
    text = F.when(~F.col("rate").contains("-") & (F.col("l_orderkey") % 2 == 0), before).otherwise(after)
    return _rates(spark, d).select("l_orderkey", "l_linenumber", extract.profit_rate(text).alias("r")).select("l_orderkey", "l_linenumber", "r.*")


@query("SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) / 100.0 AS value, 'TRY' AS currency FROM orders")
def tr_money(spark, d):
    """N04"""
    unit = F.element_at(F.array(F.lit(" TL"), F.lit("₺"), F.lit(" Türk Lirası")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", N.normalize_money(F.concat(tr(cents("o_totalprice")), unit)).alias("m")).select("o_orderkey", "m.*")


@query("SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) / 100.0 AS value FROM orders")
def extract_amount(spark, d):
    """X05"""
    text = F.concat(F.lit("Kampanyada azami Finansman tutarı "), tr(cents("o_totalprice")), F.lit(" TL, 12 taksit."))
    return table(spark, d, "orders").select("o_orderkey", extract.amount(text)["value"].alias("value"))


@query("SELECT p_partkey, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_size WHEN p_partkey % 3 = 1 THEN p_size * 12 ELSE round_even((p_size + 0.5) * 12, 0) END AS INTEGER) AS months FROM part")
def tr_term_months(spark, d):
    """N05"""
    n = F.col("p_size").cast("string")
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(n, F.lit(" aya kadar"))).when(F.col("p_partkey") % 3 == 1, F.concat(n, F.lit(" YIL"))).otherwise(F.concat(n, F.lit(",5 yıl")))
    return table(spark, d, "part").select("p_partkey", N.normalize_term_months(text).alias("months"))


@query("SELECT p_partkey, CAST(p_size AS INTEGER) AS months FROM part")
def extract_term(spark, d):
    """Not the months without payment, but the term."""
    text = F.concat(F.lit("İlk 3 ay ödemesiz, "), F.col("p_size").cast("string"), F.lit(" ay vade ile. Son 99 ay için geçerli değildir."))
    return table(spark, d, "part").select("p_partkey", extract.term(text)["months"].alias("months"))


@query("SELECT p_partkey, CAST(p_size AS INTEGER) AS n FROM part")
def extract_instalments(spark, d):
    """X06"""
    n = F.col("p_size").cast("string")
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(n, F.lit(" TAKSİT fırsatı"))).otherwise(F.concat(F.lit("Taksit sayısı: "), n))
    return table(spark, d, "part").select("p_partkey", extract.instalments(F.regexp_replace(text, "TAKSİT", "taksit")).alias("n"))


_DATE_SQL = "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders"


def _dates() -> Column:
    day = F.col("o_orderdate").cast("date")
    month = F.element_at(F.array(*map(F.lit, ["Ocak", "Şubat", "Mart", "Nisan", "Mayıs", "Haziran", "Temmuz", "Ağustos", "Eylül", "Ekim", "KASIM", "Aralık"])), F.month(day))
    forms = [F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "dd.MM.yyyy"), F.date_format(day, "d/M/yyyy"), F.concat_ws(" ", F.dayofmonth(day).cast("string"), month, F.year(day).cast("string"))]
    text = F.element_at(F.array(*forms), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return F.when(F.col("o_orderkey") % 11 == 0, "31.06.2026").otherwise(text)


@query(_DATE_SQL)
def tr_date(spark, d):
    """N06"""
    return table(spark, d, "orders").select("o_orderkey", N.normalize_date(_dates()).alias("day"))


@query(_DATE_SQL)
def extract_deadline(spark, d):
    """The first date decides, even if it is impossible."""
    text = F.concat(F.lit("Kampanya "), _dates(), F.lit(" tarihine kadar; yeni dönem 01.01.2031."))
    return table(spark, d, "orders").select("o_orderkey", extract.deadline(text).alias("day"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 2 THEN NULL ELSE CAST(round(l_discount * 100) AS BIGINT) * 1.0 END AS rate FROM lineitem")
def extract_discount(spark, d):
    """X13"""
    n = cents("l_discount").cast("string")
    text = (
        F.when(F.col("l_linenumber") == 2, F.concat(F.lit("%"), n, F.lit(" puan ve indirim")))
        .when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("Mağazalarda %"), n, F.lit("'e varan indirim")))
        .otherwise(F.concat(F.lit("indirim oranı %"), n))
    )
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", extract.discount(text)["num"].alias("rate"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN true WHEN 4 THEN true END AS has_fee,
  CASE o_orderkey % 6 WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 WHEN 2 THEN CAST(round(o_totalprice * 100) AS BIGINT) / 100.0 END AS amount FROM orders""")
def fee_status(spark, d):
    """N07"""
    k = F.col("o_orderkey") % 6
    text = (
        F.when(k == 0, "MASRAFSIZ finansman").when(k == 1, "Dosya ücreti alınmaz").when(k == 2, F.concat(F.lit("tahsis ücreti "), tr(cents("o_totalprice")), F.lit(" TL")))
        .when(k == 3, "ücret alınır").when(k == 4, "masraf tahsil edilir").otherwise("Ücret Tarifesi")
    )
    return table(spark, d, "orders").select("o_orderkey", N.normalize_fee_status(text).alias("f")).select("o_orderkey", "f.*")


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Konut Finansmanı' WHEN 1 THEN 'Taşıt Finansmanı' WHEN 2 THEN 'Kart' WHEN 3 THEN 'Yatırım Ürünü' END AS type,
  CASE p_partkey % 5 WHEN 0 THEN 0.7 WHEN 1 THEN 0.7 WHEN 2 THEN 0.7 WHEN 3 THEN 0.6 ELSE 0.0 END AS confidence FROM part""")
def classify_type(spark, d):
    """K01"""
    texts = ["EV için konut kredisi, devam", "TAŞIT ve araç kredisi", "Bonus kartınız", "yatırım hesabı", "Seviye ve devam"]
    text = F.element_at(F.array(*map(F.lit, texts)), (F.col("p_partkey") % 5 + 1).cast("int"))
    kind = classify.campaign_type(text)
    return table(spark, d, "part").select("p_partkey", kind["type"].alias("type"), F.round(kind["confidence"], 6).alias("confidence"))


@query("""
SELECT l_orderkey, l_linenumber, extractor, confidence FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY p DESC, confidence DESC, l_linenumber) AS n FROM
 (SELECT l_orderkey, l_linenumber, CASE (l_partkey + l_linenumber) % 3 WHEN 0 THEN 'rule' WHEN 1 THEN 'ner' ELSE 'llm' END AS extractor,
   CASE (l_partkey + l_linenumber) % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS p, l_discount AS confidence FROM lineitem)) WHERE n = 1""")
def reconcile_layers(spark, d):
    """The strongest layer of each order."""
    layer = F.element_at(F.array(F.lit("rule"), F.lit("ner"), F.lit("llm")), ((F.col("l_partkey") + F.col("l_linenumber")) % 3 + 1).cast("int"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", layer.alias("extractor"), F.col("l_discount").alias("confidence"), F.col("l_linenumber").alias("seq"))
    return classify.reconcile(rows, ["l_orderkey"]).drop("seq")


def _store(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Banks from nations, campaigns from all customers, fields from orders."""
    banks = table(spark, d, "nation").select(F.col("n_nationkey").alias("bank_id"), F.col("n_name").alias("name"), F.lower("n_name").alias("slug"))
    campaigns = table(spark, d, "customer").select(F.col("c_custkey").alias("campaign_id"), F.col("c_nationkey").alias("bank_id"), F.col("c_mktsegment").alias("campaign_type"))
    extractor = F.when(F.col("o_orderkey") % 3 == 0, "rule").otherwise("llm")
    fields = table(spark, d, "orders").select(F.col("o_custkey").alias("campaign_id"), F.col("o_orderpriority").alias("field_name"), F.col("o_totalprice").alias("value"), extractor.alias("extractor"), F.col("o_orderkey").alias("seq"))
    return banks, campaigns, fields


@query("""
SELECT o_orderkey AS seq, c_custkey AS campaign_id, lower(n_name) AS slug, c_mktsegment AS campaign_type, o_totalprice AS value
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT'""")
def query_fields_join(spark, d):
    """S01"""
    banks, campaigns, fields = _store(spark, d)
    return store.query_fields(fields, campaigns, banks, "1-URGENT").select("seq", "campaign_id", "slug", "campaign_type", "value")


@query("""
SELECT (SELECT count(*) FROM nation) AS banks, (SELECT count(*) FROM customer) AS campaigns,
  count(*) AS fields, count(DISTINCT o_orderpriority) AS field_names, count(DISTINCT o_custkey) AS campaigns_with_fields FROM orders""")
def counts(spark, d):
    """S06"""
    return store.counts(*_store(spark, d))


@query("SELECT o_orderpriority AS field_name, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
def field_coverage(spark, d):
    """S07"""
    return store.field_coverage(_store(spark, d)[2])


@query("SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'rule' ELSE 'llm' END AS extractor, count(*) AS n FROM orders GROUP BY 1")
def by_extractor(spark, d):
    """S08"""
    return store.fields_by_extractor(_store(spark, d)[2])


@query("SELECT lower(n_name) AS slug, count(c_custkey) AS n FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY 1")
def per_bank_left(spark, d):
    """S09"""
    banks, campaigns, _ = _store(spark, d)
    return store.campaigns_per_bank(banks, campaigns)


@query("""
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM (SELECT l_orderkey, min({'a': l_linenumber, 'b': l_quantity}).b AS t FROM lineitem GROUP BY 1) WHERE t >= 24)""")
def filter_semi_join(spark, d):
    """QA5: orders whose first line has a quantity of at least 24, as a term."""
    fields = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("campaign_id"), F.lit("vade_ay").alias("field_name"), F.col("l_quantity").alias("value"), F.col("l_linenumber").alias("seq"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("campaign_id"), "o_custkey")
    return store.with_minimum_term(rows, fields, 24).select(F.col("campaign_id").alias("o_orderkey"), "o_custkey")


def _rank_rows(spark, d) -> DataFrame:
    """Suppliers; every seventh is a range, every fifth in another currency."""
    s = table(spark, d, "supplier")
    wide = F.col("s_suppkey") % 7 == 0
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("seq"), F.when(~wide, F.col("s_acctbal")).alias("num"), F.when(wide, F.col("s_acctbal")).alias("min"), F.when(F.col("s_suppkey") % 5 == 0, "USD").otherwise("TRY").alias("currency"))


_RANK_SQL = """
SELECT id, CASE WHEN c OR w THEN x END AS sort_key, c AS comparable, CASE WHEN c THEN row_number() OVER (PARTITION BY c ORDER BY {sign} x, id) END AS position
FROM (SELECT s_suppkey AS id, s_acctbal AS x, s_suppkey % 7 = 0 AS w, s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0 AS c FROM supplier)"""


@query(_RANK_SQL.format(sign=""))
def rank_lowest(spark, d):
    """C01, C02"""
    return rank.rank(_rank_rows(spark, d))


@query(_RANK_SQL.format(sign="-"))
def rank_highest(spark, d):
    """C04"""
    return rank.rank(_rank_rows(spark, d), descending=True)


@query("SELECT s_suppkey AS id, s_acctbal AS sort_key FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0 ORDER BY s_acctbal, s_suppkey LIMIT 1")
def rank_best(spark, d):
    """C03"""
    return rank.best(_rank_rows(spark, d))


@query("""
SELECT p_partkey, round(CASE WHEN min(v) OVER g = max(v) OVER g THEN 1.0 ELSE 1 - (rank() OVER (PARTITION BY p_brand ORDER BY v) - 1 + (count(*) OVER (PARTITION BY p_brand, v) - 1) / 2.0) / (count(*) OVER g - 1) END, 6) AS norm
FROM (SELECT p_partkey, p_brand, p_size AS v FROM part) WINDOW g AS (PARTITION BY p_brand)""")
def avg_rank_norm(spark, d):
    """C06"""
    long = table(spark, d, "part").select("p_partkey", "p_brand", F.col("p_size").alias("value"), F.lit(True).alias("lower"))
    return rank.rank_normalized(long, ["p_brand"]).select("p_partkey", F.round("norm", 6).alias("norm"))


def _offers(spark, d) -> DataFrame:
    p, k = table(spark, d, "part"), F.col("p_partkey")
    kind = F.when(k % 13 == 0, None).when(k <= 2, "rare").otherwise(F.col("p_brand"))
    return p.select(
        k.alias("id"), kind.alias("campaign_type"), F.when(k % 3 != 0, F.col("p_size")).alias("kar_payi_orani"), F.when(k % 4 != 0, k % 7).alias("masraf_durumu"),
        F.when(k % 5 == 0, k % 11).alias("odul_miktari"), F.when(k % 2 == 0, k % 17).alias("vade_ay"), F.col("p_retailprice").alias("finansman_tutari"),
    )


_COMPOSITE_SQL = """
WITH o AS (SELECT p_partkey AS id, {kind} AS campaign_type, p_partkey AS k, p_size, p_retailprice FROM part),
l AS (SELECT id, campaign_type, 'r' AS f, 0.40 AS w, 1 AS s, CAST(CASE WHEN k % 3 <> 0 THEN p_size END AS DOUBLE) AS v FROM o
 UNION ALL SELECT id, campaign_type, 'm', 0.20, 1, CASE WHEN k % 4 <> 0 THEN k % 7 END FROM o UNION ALL SELECT id, campaign_type, 'o', 0.15, -1, CASE WHEN k % 5 = 0 THEN k % 11 END FROM o
 UNION ALL SELECT id, campaign_type, 'v', 0.15, -1, CASE WHEN k % 2 = 0 THEN k % 17 END FROM o UNION ALL SELECT id, campaign_type, 'f', 0.10, -1, p_retailprice FROM o),
n AS (SELECT *, CASE WHEN min(v) OVER g = max(v) OVER g THEN 1.0 ELSE 1 - (rank() OVER (PARTITION BY campaign_type, f ORDER BY s * v) - 1 + (count(*) OVER (PARTITION BY campaign_type, f, v) - 1) / 2.0) / (count(*) OVER g - 1) END AS norm
 FROM l WHERE v IS NOT NULL WINDOW g AS (PARTITION BY campaign_type, f)),
a AS (SELECT campaign_type, sum(w) AS active FROM (SELECT DISTINCT campaign_type, f, w FROM n) GROUP BY 1),
e AS (SELECT id, sum(CAST(w AS DOUBLE) * norm) AS x, sum(CAST(w AS DOUBLE)) AS present FROM n GROUP BY 1), z AS (SELECT campaign_type, count(*) AS size FROM o GROUP BY 1),
r AS (SELECT o.id, o.campaign_type, CASE WHEN {enough} THEN round(x / present, 6) END AS score, round(coalesce(present / active, 0), 6) AS coverage,
 ({enough}) AND round(coalesce(present / active, 0), 9) >= 0.5 AS comparable FROM o LEFT JOIN e USING (id) LEFT JOIN a USING (campaign_type) JOIN z USING (campaign_type))
"""
_BY_TYPE = {"kind": "CASE WHEN p_partkey % 13 = 0 THEN 'Sınıflandırılamadı' WHEN p_partkey <= 2 THEN 'rare' ELSE p_brand END", "enough": "size >= 3"}


@query(_COMPOSITE_SQL.format(kind="'all'", enough="true") + "SELECT * FROM r")
def composite(spark, d):
    """C07"""
    return rank.composite(_offers(spark, d))


@query(_COMPOSITE_SQL.format(**_BY_TYPE) + "SELECT * FROM r")
def composite_by_type(spark, d):
    """C09"""
    return rank.composite(_offers(spark, d), by_type=True)


@query(_COMPOSITE_SQL.format(**_BY_TYPE) + "SELECT campaign_type, (array_agg(id ORDER BY score DESC, coverage DESC, id) FILTER (comparable))[1] AS id, max(score) FILTER (comparable) AS score FROM r GROUP BY 1")
def best_of_type(spark, d):
    """C10"""
    return rank.best_by_type(rank.composite(_offers(spark, d), by_type=True))


@query("SELECT l_orderkey, CAST(min(l_shipdate) AS DATE) AS first, CAST(max(l_shipdate) AS DATE) AS last FROM lineitem GROUP BY 1 HAVING count(DISTINCT CAST(l_shipdate AS DATE)) > 1")
def end_date_conflict(spark, d):
    """Texts that name several end dates."""
    claim = F.concat(F.lit("Kampanya "), F.date_format("l_shipdate", "dd.MM.yyyy"), F.lit(" tarihine kadar geçerlidir."))
    texts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.concat_ws(" ", F.collect_list(claim)).alias("text"))  # a few lines an order
    found = texts.select("l_orderkey", contradict.conflicting_end_dates(F.col("text")).alias("c")).filter("c is not null")
    return found.select("l_orderkey", F.col("c.low").cast("date").alias("first"), F.col("c.high").cast("date").alias("last"))


@query("SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) / 100.0 AS amount FROM orders WHERE o_orderkey % 3 = 0")
def fee_contradiction(spark, d):
    """Texts that deny and state a fee."""
    fee = F.concat(F.lit("tahsis ücreti "), tr(cents("o_totalprice")), F.lit(" TL"))
    denial = F.when(F.col("o_orderkey") % 3 == 0, "Masrafsız kampanya.").otherwise("Avantajlı kampanya.")
    texts = spread(table(spark, d, "orders").select("o_orderkey", F.concat(denial, F.lit(" "), fee).alias("text")))
    found = fields.extract_all(F.col("text"))
    rows = texts.select("o_orderkey", F.explode_outer(let_fees(found)).alias("c")).filter("c is not null")
    return rows.select("o_orderkey", F.col("c.high").cast("double").alias("amount"))


def let_fees(found: Column) -> Column:
    return T.let(found, lambda f: contradict.fee_contradictions(fields.field(f, "masraf_durumu"), fields.field(f, "tahsis_ucreti")))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS hash, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 2")
def sha_dedupe(spark, d):
    """The first document of each content hash."""
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", T.content_hash(F.col("text")).alias("hash"))
    return docs.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).select("doc_id", "hash", "n")


#: The references that occur in the given pages.
_ENTITIES_SQL = "regexp_replace(regexp_replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&quot;?', '\"', 'g'), '&amp;?', '&', 'g')"


@query("""
SELECT p_partkey, '<' || chr(n) || '> ' || chr(n) || chr(n) || 'ü &' || p_brand || ';& ©right &' || CASE WHEN p_partkey % 2 = 0 THEN '€' ELSE chr(8211) END AS text FROM (SELECT *, CAST(192 + p_partkey AS INTEGER) AS n FROM part)""")
def html_references(spark, d):
    """Decimal and hexadecimal references, named ones, unknown ones, and names without a semicolon."""
    p, n = table(spark, d, "part"), (F.col("p_partkey") + 192)
    dec, low, up = n.cast("string"), F.lower(F.hex(n)), F.hex(n)
    last = F.when(F.col("p_partkey") % 2 == 0, "&#128;").otherwise("&ndash;")
    text = F.concat(F.lit("&lt;&#"), dec, F.lit(";&gt; &#x"), low, F.lit(";&#X"), up, F.lit(";&uuml; &"), F.col("p_brand"), F.lit(";&amp; &copyright &amp;"), last)
    return p.select("p_partkey", T.strip_html(text).alias("text"))


@query(rf"""
SELECT page_id, {_ENTITIES_SQL} AS text
FROM (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS x FROM pages)""")
def html_strip(spark, d):
    """All pages, with their entities."""
    return table(spark, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


@query(rf"""
SELECT page_id, trim(regexp_replace({_ENTITIES_SQL}, '[\s\x{{0B}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g')) AS text
FROM (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS x FROM pages)""")
def html_strip_all(spark, d):
    """All pages, with their entities."""
    return table(spark, d, "pages").select("page_id", T.normalize_whitespace(T.strip_html(F.col("html"))).alias("text"))


_QUESTION = ["the", "that", "was", "with", "shall"]


@query("""
SELECT doc_id AS id, round(n / (sqrt(5.0) + 1), 3) AS score FROM (SELECT doc_id, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-zçğıöşü0-9]+')), ['the','that','was','with','shall'])) AS n FROM
 (SELECT doc_id, replace(replace(text, 'I', 'ı'), 'İ', 'i') AS text FROM documents)) WHERE n >= 2 ORDER BY score DESC, id LIMIT 10""")
def tokens_topk(spark, d):
    """P12, QA7"""
    return retrieve.keyword_topk(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), _QUESTION, 10)


_VECTOR = [((7 * k) % 13 - 6) / 6 for k in range(64)]


@query(f"SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_VECTOR}::DOUBLE[]), 4) AS score FROM embeddings ORDER BY score DESC, id LIMIT 20")
def vector_topk(spark, d):
    """QA9"""
    return retrieve.vector_topk(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), _VECTOR, 20)


@query("SELECT doc_id, lang, turn FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, lang LIMIT 50")
def round_robin(spark, d):
    """E21"""
    return retrieve.round_robin(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 50).withColumn("turn", F.col("turn").cast("bigint"))


_CONFUSION_SQL = """
WITH x AS (SELECT lang AS field, CASE WHEN quality = 1 THEN toxic END AS gold, CASE WHEN n_chars > 400 THEN CASE WHEN n_chars > 5000 THEN 1 ELSE 0 END END AS pred, quality = 0 AS absent FROM labels JOIN documents USING (doc_id)),
c AS (SELECT field, count(*) FILTER (pred = gold) AS tp, count(*) FILTER (pred <> gold OR (pred IS NOT NULL AND absent)) AS fp, count(*) FILTER (gold IS NOT NULL AND (pred IS NULL OR pred <> gold)) AS fn,
 count(*) FILTER (pred IS NULL AND absent) AS tn, count(*) FILTER (pred IS NOT NULL AND absent) AS hallucinated FROM x GROUP BY 1),
r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS q FROM c)
SELECT field, tp, fp, fn, tn, hallucinated, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q = 0 THEN 0 ELSE 2 * p * q / (p + q) END, 6) AS f1,
 round(CASE WHEN hallucinated + tn = 0 THEN NULL ELSE hallucinated / (hallucinated + tn) END, 6) AS hallucination_rate FROM r"""


def _labelled(spark, d) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")


@query(_CONFUSION_SQL)
def prf_by_field(spark, d):
    """E03 to E05"""
    pred = F.when(F.col("n_chars") > 400, F.when(F.col("n_chars") > 5000, 1).otherwise(0))
    rows = _labelled(spark, d).select(F.col("lang").alias("field"), F.when(F.col("quality") == 1, F.col("toxic")).alias("gold"), pred.alias("pred"), (F.col("quality") == 0).alias("absent"))
    return evaluate.rates(evaluate.score_decisions(rows))


@query("""
SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b, count(*) FILTER (NOT a AND NOT b) AS neither
FROM (SELECT (n_chars > 500) = (quality = 1) AS a, (n_chars > 2000) = (quality = 1) AS b FROM labels JOIN documents USING (doc_id))""")
def mcnemar_pairs(spark, d):
    """E10, E11"""
    right = lambda n: (F.col("n_chars") > n) == (F.col("quality") == 1)
    return evaluate.paired_counts(_labelled(spark, d).select(right(500).alias("a"), right(2000).alias("b")))


@query("""
WITH x AS (SELECT quality AS a, CAST(n_chars > 500 AS INTEGER) AS b FROM labels JOIN documents USING (doc_id)), t AS (SELECT count(*) AS n, avg(CAST(a = b AS INTEGER)) AS po FROM x),
e AS (SELECT sum(na * nb) / (SELECT n * n FROM t) AS pe FROM (SELECT a AS k, count(*) AS na FROM x GROUP BY 1) JOIN (SELECT b AS k, count(*) AS nb FROM x GROUP BY 1) USING (k))
SELECT n, round(po, 6) AS po, round(pe, 6) AS pe, round(CASE WHEN pe = 1 THEN 1.0 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM t, e""")
def cohen_kappa(spark, d):
    """E13"""
    return evaluate.cohen_kappa(_labelled(spark, d).select(F.col("quality").alias("a"), (F.col("n_chars") > 500).cast("int").alias("b")))


@query("SELECT quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, quantile_disc(value, 0.5) AS d50, quantile_disc(value, 0.95) AS d95, quantile_disc(value, 0.99) AS d99 FROM events")
def percentiles(spark, d):
    """E07, E08"""
    return evaluate.percentiles(table(spark, d, "events"), "value", [0.5, 0.95, 0.99])


@query("SELECT s_suppkey, sentences FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 3 ELSE 2 END AS sentences FROM supplier)")
def sentence_counts(spark, d):
    """A full stop after an abbreviation doesn't end a sentence."""
    text = F.when(F.col("s_suppkey") % 2 == 0, "Bir cümle. İkinci cümle! Üçüncü mü?").otherwise("Ücret vb. Masraflar yoktur. Sn. müşterimiz.")
    return table(spark, d, "supplier").select("s_suppkey", F.size(T.split_sentences(text)).alias("sentences"))
