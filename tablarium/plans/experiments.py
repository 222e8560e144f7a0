"""Registered queries on splits, loads, arms, tolerant matches, discovery, vectors and safety, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablarium.functions import text as T
from tablarium.operators import agreement, arms, contradict, embed, evaluate, gold, rank, rubric, splits, store
from tablarium.plans.catalogue import ORACLES, _labelled, _offers, _store, query, table
from tablarium.plans.dialogue import _answered
from tablarium.plans.fields import _doubtful_pages
from tablarium.sources import crawl

#: Counts (stratum, n) to the number of test rows: rounded shares, then a row at a time from the largest.
_APPORTIONED = """
r AS (SELECT stratum, n, CASE WHEN n >= 2 THEN greatest(1, least(n - 1, round_even(n * 0.6, 0))) ELSE round_even(n * 0.6, 0) END AS t FROM counts), d AS (SELECT sum(t) - round_even(sum(n) * 0.6, 0) AS drift FROM r),
steps AS (SELECT stratum, row_number() OVER (ORDER BY CASE WHEN drift > 0 THEN t ELSE n - t END - i DESC, stratum) AS place, drift FROM r, d, range(64) g(i) WHERE CASE WHEN drift > 0 THEN t ELSE n - t END - i >= 2),
moved AS (SELECT stratum, count(*) AS m FROM steps WHERE place <= abs(drift) GROUP BY 1)
SELECT r.stratum, CAST(n AS BIGINT) AS n, CAST(t - sign(drift) * coalesce(m, 0) AS BIGINT) AS test FROM r LEFT JOIN moved USING (stratum), d"""


def _sizes(split: DataFrame, stratum) -> DataFrame:
    return split.groupBy(stratum.alias("stratum")).agg(F.count("*").alias("n"), F.count(F.when(F.col("split") == "test", 1)).alias("test"))


@query(f"WITH counts AS (SELECT c_mktsegment AS stratum, count(*) AS n FROM customer GROUP BY 1), {_APPORTIONED}")
def split_sizes(spark, d):
    """The share holds over all rows."""
    return _sizes(splits.stratified_split(table(spark, d, "customer"), ["c_mktsegment"], "c_custkey"), F.col("c_mktsegment"))


@query(f"""
WITH counts AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'range+table' WHEN 1 THEN 'range' ELSE 'easy' END || ' | ' || CASE WHEN p_size > 25 AND p_partkey % 2 = 0 THEN 'kar_payi_orani+tahsis_ucreti' WHEN p_partkey % 2 = 0 THEN 'kar_payi_orani' WHEN p_size > 25 THEN 'tahsis_ucreti' ELSE 'common' END || ' | ' || p_brand AS stratum, count(*) AS n
 FROM part GROUP BY 1), {_APPORTIONED}""")
def split_strata(spark, d):
    """Many small strata of tags and rare fields (and brands), whose rounding adds up."""
    k = F.col("p_partkey") % 3
    names = lambda *n: F.array(*map(F.lit, n)).cast("array<string>")
    tags = F.when(k == 0, names("table", "range")).when(k == 1, names("range", "range"))
    held = F.array_compact(F.array(F.lit("vade_ay"), F.when(F.col("p_size") > 25, "tahsis_ucreti"), F.when(F.col("p_partkey") % 2 == 0, "kar_payi_orani")))
    rows = table(spark, d, "part").withColumn("stratum", F.concat(splits.stratum(tags, held), F.lit(" | "), F.col("p_brand")))
    return _sizes(splits.stratified_split(rows, ["stratum"], "p_partkey"), F.col("stratum"))


@query("""
WITH RECURSIVE o AS (SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS s, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS n FROM part),
w(n, id, who, a, b, c) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), 'x', CAST(5 AS BIGINT), CAST(0 AS BIGINT), CAST(9 AS BIGINT)
 UNION ALL SELECT o.n, o.id, CASE WHEN a <= b AND a <= c THEN 'ann' WHEN b <= c THEN 'bob' ELSE 'cem' END, a + CASE WHEN a <= b AND a <= c THEN s ELSE 0 END, b + CASE WHEN NOT (a <= b AND a <= c) AND b <= c THEN s ELSE 0 END, c + CASE WHEN NOT (a <= b AND a <= c) AND b > c THEN s ELSE 0 END FROM w JOIN o ON o.n = w.n + 1)
SELECT id AS doc_id, who AS annotator FROM w WHERE n > 0""")
def balanced_loads(spark, d):
    """Documents of as many rows as their parts' size, to three annotators with loads of their own."""
    return splits.balanced(table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_size").alias("rows")), ["ann", "bob", "cem"], [5, 0, 9])


_ARMS = ["short", "middle", "long"]


def _by_arm(spark, d) -> DataFrame:
    """Three arms call a text good by its length; the third has no decisions on German texts."""
    right = lambda n: (F.col("n_chars") > n) == (F.col("quality") == 1)
    parts = F.array(*[F.struct(F.lit(a).alias("arm"), (F.col("n_chars") > n).alias("pred"), right(n).alias("right")) for a, n in zip(_ARMS, (500, 2000, 4000), strict=True)])
    rows = _labelled(spark, d).select(F.col("doc_id").alias("document"), F.col("lang").alias("field"), (F.col("quality") == 1).alias("gold"), F.lit(False).alias("absent"), (F.col("toxic") == 1).alias("hard"), F.explode(parts).alias("x"))
    return rows.select("document", "field", "gold", "absent", "hard", "x.*").filter("not (arm = 'long' and field = 'de')")


_ARM_SQL = """
WITH x AS (SELECT doc_id, lang, toxic = 1 AS hard, quality = 1 AS gold, n_chars FROM labels JOIN documents USING (doc_id)), a AS (SELECT 'short' AS arm, 500 AS n UNION ALL SELECT 'middle', 2000 UNION ALL SELECT 'long', 4000),
y AS (SELECT arm, doc_id, lang, hard, gold, n_chars > n AS pred FROM x, a WHERE NOT (arm = 'long' AND lang = 'de'))"""


@query(_ARM_SQL + """
SELECT p.arm AS a, q.arm AS b, scope, count(*) AS decisions, count(*) FILTER (p.pred = p.gold AND q.pred <> q.gold) AS only_a, count(*) FILTER (p.pred <> p.gold AND q.pred = q.gold) AS only_b
FROM y p JOIN y q ON p.doc_id = q.doc_id AND p.lang = q.lang AND p.arm < q.arm, (VALUES ('all'), ('hard')) s(scope) WHERE scope = 'all' OR p.hard GROUP BY ALL""")
def arms_compared(spark, d):
    """All pairs of arms, over all and hard texts; the tests of these counts are in tests/."""
    return arms.compared(_by_arm(spark, d)).select("a", "b", "scope", "decisions", "only_a", "only_b")


@query(_ARM_SQL + """, c AS (SELECT arm, count(DISTINCT doc_id) AS documents, count(*) FILTER (pred = gold) AS tp, count(*) FILTER (pred <> gold) AS fp FROM y GROUP BY 1)
SELECT arm, documents, tp, fp, fp AS fn, round(2 * tp / (2 * tp + fp + fp), 6) AS f1, true AS measured, NULL AS reason FROM c UNION ALL SELECT 'model', NULL, NULL, NULL, NULL, NULL, false, 'no model'""")
def arms_measured(spark, d):
    """An arm that couldn't be run keeps its row."""
    every = spark.createDataFrame([(a, None) for a in _ARMS] + [("model", "no model")], "arm string, reason string")
    return arms.measured(every, _by_arm(spark, d))


@query("""
SELECT o_orderkey, k, CASE k WHEN 0 THEN x = 0 WHEN 1 THEN x = 0 WHEN 2 THEN x = 0 WHEN 3 THEN x = 0 ELSE x < 2 END AS strict, CASE k WHEN 0 THEN x * 0.4 <= 1.0 WHEN 1 THEN true WHEN 2 THEN x <= 1 WHEN 3 THEN x * 0.4 <= 1.0 ELSE x < 4 END AS tolerant
FROM (SELECT o_orderkey, CAST(o_orderkey % 5 AS INTEGER) AS k, o_custkey % 5 AS x FROM orders)""")
def match_families(spark, d):
    """Money, fees, dates, kinds and lists, strict and tolerant, at growing distance."""
    k, x = (F.col("o_orderkey") % 5).cast("int"), F.col("o_custkey") % 5
    n, near = F.lit(1000.0), 1000.0 - 4.0 * x
    money = lambda v: F.struct(v.alias("value"), F.lit("TRY").alias("currency"))
    fee = lambda v: F.struct(F.lit(True).alias("has_fee"), v.alias("amount"))
    kind = lambda v: F.struct(F.lit("rate").alias("kind"), v.alias("value"))
    one, other = F.array(F.lit("Bir"), F.lit("İki"), F.lit("üç")), F.when(x == 0, F.array(F.lit("Bir"), F.lit("İki"), F.lit("üç"))).when(x == 1, F.array(F.lit("üç"), F.lit("Bir"), F.lit("İki"))).when(x == 2, F.array(F.lit("BİR"), F.lit("İki."), F.lit("dört"))).when(x == 3, F.array(F.lit("iki"), F.lit("bir"))).otherwise(F.array(F.lit("başka")))
    day = F.col("o_orderdate").cast("date")

    def match(t: bool):
        return (
            F.when(k == 0, agreement.money_match(money(n), money(near), t)).when(k == 1, agreement.fee_match(fee(n), fee(F.when(x == 0, n)), t)).when(k == 2, agreement.day_match(day, F.date_add(day, x.cast("int")), t))
            .when(k == 3, agreement.kind_match(kind(n), kind(near), t)).otherwise(agreement.list_match(one, other, t))
        )

    return table(spark, d, "orders").select("o_orderkey", k.alias("k"), match(False).alias("strict"), match(True).alias("tolerant"))


@query("""
SELECT field, weight, direction, n FROM (VALUES ('kar_payi_orani', 0.40::DOUBLE, 'lower_is_better'), ('masraf_durumu', 0.20, 'lower_is_better'), ('odul_miktari', 0.15, 'higher_is_better'), ('vade_ay', 0.15, 'higher_is_better'), ('finansman_tutari', 0.10, 'higher_is_better')) v(field, weight, direction)
JOIN (SELECT unnest(['kar_payi_orani', 'masraf_durumu', 'odul_miktari', 'vade_ay', 'finansman_tutari']) AS field, unnest([count(*) FILTER (k % 3 <> 0), count(*) FILTER (k % 4 <> 0), count(*) FILTER (k % 5 = 0), count(*) FILTER (k % 2 = 0), count(*)]) AS n FROM (SELECT p_partkey AS k FROM part)) USING (field)""")
def weight_manifest(spark, d):
    """The weights of the composite score, and how many offers each field tells apart."""
    offers = _offers(spark, d)
    n = offers.agg(*[F.count(f).alias(f) for f in rank.WEIGHTS]).unpivot([], list(rank.WEIGHTS), "field", "n")
    return rank.manifest(spark).drop("rationale").join(n, "field")


@query("SELECT s_suppkey, regexp_replace(regexp_replace(lower(replace(s_name, '#', '-')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') || '-' || CASE WHEN s_suppkey % 2 = 0 THEN 'cilginca-isik' ELSE 'og' END AS slug FROM supplier")
def turkish_slugs(spark, d):
    """P08"""
    more = F.when(F.col("s_suppkey") % 2 == 0, " ÇILGINCA işık!").otherwise(" (Öğ)")
    return table(spark, d, "supplier").select("s_suppkey", T.slugify_tr(F.concat("s_name", more)).alias("slug"))


@query("SELECT lang, CASE WHEN k IS NULL OR isnan(k) THEN 'undefined' WHEN k >= 0.8 THEN 'reliable' WHEN k >= 0.67 THEN 'tentative' ELSE 'unreliable' END AS level FROM (SELECT lang, avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.5 END) AS k FROM labels JOIN documents USING (doc_id) GROUP BY 1) UNION ALL SELECT 'none', 'undefined'")
def kappa_levels(spark, d):
    """E16"""
    k = _labelled(spark, d).groupBy("lang").agg(F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.5)).alias("k"))
    return k.unionByName(k.agg(F.lit("none").alias("lang"), F.lit(None).cast("double").alias("k"))).select("lang", agreement.interpret_kappa(F.col("k")).alias("level"))


@query("SELECT split, count(*) AS n FROM (SELECT 'all' AS split FROM documents UNION ALL SELECT CASE WHEN doc_id % 3 = 0 THEN 'hard' ELSE 'easy' END FROM documents) GROUP BY 1")
def selected_splits(spark, d):
    """E06"""
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("range"))).when(F.col("doc_id") % 3 == 1, F.array().cast("array<string>")).alias("hard_tags"))
    one = lambda s: evaluate.select_split(docs, s).agg(F.lit(s).alias("split"), F.count("*").alias("n"))
    return one("all").unionByName(one("hard")).unionByName(one("easy"))


@query("SELECT lower(n_name) AS slug, n_nationkey AS bank_id FROM nation ORDER BY 1")
def all_banks(spark, d):
    """S04"""
    return store.all_banks(_store(spark, d)[0]).select("slug", "bank_id")


@query("SELECT page_id, true AS own, true AS below, false AS other FROM pages")
def same_sites(spark, d):
    """A page is on its own site, also below another host of it, and not on one whose name ends alike."""
    site = F.concat(F.lit("https://www."), crawl.host(F.col("url")), F.lit("/x"))
    same = lambda prefix: crawl.same_site(F.concat(F.lit(prefix), crawl.host(F.col("url")), F.lit("/p")), site)
    return table(spark, d, "pages").select("page_id", crawl.same_site(F.col("url"), site).alias("own"), same("https://sub.").alias("below"), same("https://not").alias("other"))


def _stored_sites(spark, d) -> DataFrame:
    """url, body, ok: for each supplier an index of two sitemaps and itself, one of which lists pages; and a listing with links."""
    k = F.col("s_suppkey").cast("string")
    url = lambda *p: F.concat(F.lit("https://b"), k, F.lit(".example/"), *[x if not isinstance(x, str) else F.lit(x) for x in p])
    loc = lambda u: F.concat(F.lit("<loc> "), u, F.lit(" </loc>"))
    index = F.concat(F.lit("<sitemapindex>"), loc(url("map-a.xml")), loc(url("index.xml")), loc(url("map-b.xml")), loc(url("gone.xml")), F.lit("</sitemapindex>"))
    pages = F.concat(F.lit("<urlset>"), loc(url("kampanya/", k)), loc(url("kampanya/x/#top")), loc(F.lit("https://other.example/kampanya/y")), loc(url("arsiv/kampanya")), F.lit("</urlset>"))
    more = F.concat(F.lit("<urlset>"), loc(url("finansman/z")), loc(url("kampanya/x")), F.lit("</urlset>"))
    listing = F.concat(F.lit('<a href="/kampanya/x">x</a> <a href="'), k, F.lit('">rel</a> <a href="#a">none</a> <a href="https://www.b'), k, F.lit('.example/kampanya/w/">w</a>'))
    row = lambda u, body: F.struct(u.alias("url"), body.alias("body"), F.lit(True).alias("ok"))
    rows = F.array(row(url("index.xml"), index), row(url("map-a.xml"), pages), row(url("map-b.xml"), more), row(url("kampanya/liste"), listing), F.struct(url("gone.xml").alias("url"), F.lit("").alias("body"), F.lit(False).alias("ok")))
    return table(spark, d, "supplier").select(F.explode(rows).alias("r")).select("r.*")


@query("""
SELECT s_suppkey AS site, 'https://b' || s_suppkey || '.example/' || p AS url, s AS source FROM supplier, (VALUES ('kampanya/x', 'sitemap'), ('kampanya/{k}', 'sitemap'), ('kampanya/liste', 'listing'), ('finansman/z', 'sitemap')) v(q, s), LATERAL (SELECT replace(q, '{k}', CAST(s_suppkey AS VARCHAR)) AS p)
UNION ALL SELECT s_suppkey, 'https://www.b' || s_suppkey || '.example/kampanya/w', 'listing' FROM supplier""")
def discovered_pages(spark, d):
    """A walk over stored sitemaps, whose index names itself and one that is gone, with the links of a listing."""
    k = F.col("s_suppkey")
    base = F.concat(F.lit("https://b"), k.cast("string"), F.lit(".example"))
    sites = table(spark, d, "supplier").select(k.alias("site"), base.alias("base"), F.array(F.concat(base, F.lit("/index.xml"))).alias("sitemaps"), F.array(F.lit("/kampanya/liste"), F.lit("/gone")).alias("listings"), F.lit(None).cast("array<string>").alias("hosts"))
    return crawl.discover(sites, _stored_sites(spark, d), ["/kampanya", "/finansman"], ["/arsiv"])


@query("""
WITH b AS (SELECT p_partkey AS id, CAST(concat('0x', substr(sha256(w), 1, 8)) AS BIGINT) % 1024 AS place, count(*) AS c FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part) WHERE w <> '' GROUP BY ALL),
u AS (SELECT id, place, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS x FROM b), s AS (SELECT q.id, t.id AS campaign_id, round(sum(q.x * t.x), 9) AS score FROM u q JOIN u t USING (place) WHERE q.id % 10 = 0 GROUP BY ALL)
SELECT id, campaign_id, score FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, campaign_id) <= 3""")
def hashed_neighbours(spark, d):
    """QA8, QA11, QA12: the names of parts as hashed bags of words; every tenth part asks for those nearest to it."""
    p = table(spark, d, "part")
    chunks = p.select(F.col("p_partkey").alias("campaign_id"), F.lit(0).alias("chunk_index"), F.col("p_name").alias("chunk_text"))
    near = embed.nearest(p.filter("p_partkey % 10 = 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), chunks, 3)
    return near.select("id", "campaign_id", F.round("score", 9).alias("score"))


@query("""
SELECT p_partkey AS campaign_id, CAST(0 AS INTEGER) AS chunk_index, count(DISTINCT CAST(concat('0x', substr(sha256(w), 1, 8)) AS BIGINT) % 1024) AS places, CAST(1 AS DOUBLE) AS length FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part) WHERE w <> '' GROUP BY 1""")
def built_vectors(spark, d):
    """QA11: chunks with unit vectors."""
    made = embed.build(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")))
    some = F.filter("vector", lambda x: x != 0)
    return made.select("campaign_id", "chunk_index", F.size(some).cast("long").alias("places"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), 5).alias("length"))


@query("""
WITH c AS (SELECT c_custkey % 8 AS q, n_name IN (SELECT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey) AS stored FROM customer JOIN nation ON c_nationkey = n_nationkey),
i AS (SELECT CASE q WHEN 0 THEN 'control' WHEN 3 THEN 'ruling' WHEN 4 THEN 'scope' ELSE 'terms' END AS category, CASE WHEN q = 0 THEN stored WHEN q = 4 THEN false ELSE true END AS ok, q = 0 AND NOT stored AS refused FROM c WHERE q IN (0, 3, 4, 7))
SELECT category, count(*) AS items, count(*) FILTER (ok) AS passed, round(count(*) FILTER (ok) / count(*), 6) AS rate, count(*) FILTER (refused) AS over_refused FROM i GROUP BY ROLLUP (category)""")
def safety_rates(spark, d):
    """QA18: control questions have to be answered, rulings refused, notices given; the criterion on scope is one that can't be met."""
    q, none = F.col("c_custkey") % 8, F.array().cast("array<string>")
    names = lambda *n: F.array(*map(F.lit, n)).cast("array<string>")
    items = table(spark, d, "customer").filter("c_custkey % 8 in (0, 3, 4, 7)").select(
        F.col("c_custkey").alias("id"), F.when(q == 0, rubric.CONTROL).when(q == 3, "ruling").when(q == 4, "scope").otherwise("terms").alias("category"), q.isin(3, 4).alias("refused"),
        F.when(q == 3, names("ruling")).when(q == 4, names("abstention")).when(q == 7, names("terminology", "guarantee")).otherwise(none).alias("gates_needed"), F.when(q == 0, names("ruling", "advice")).alias("gates_barred"),
        F.when(q == 3, names("TKBB", "Danışma KURULU")).when(q == 4, names("such words aren't there")).otherwise(none).alias("needed"), F.when(q == 7, names("garanti getiri")).alias("barred"), (q == 7).alias("no_terms"),
        q.isin(0, 7).alias("sources_needed"), (q == 0).alias("must_answer"),
    )
    return rubric.rates(rubric.checked(items, _answered(spark, d)))


@query("""
WITH f AS (SELECT o_orderpriority AS field_name, o_custkey, o_orderkey % 3 = 0 AS rule FROM orders), b AS (SELECT field_name, count(DISTINCT o_custkey) AS n FROM f WHERE rule GROUP BY 1), a AS (SELECT CASE WHEN field_name LIKE '1%' THEN 'new' ELSE field_name END AS field_name, count(DISTINCT o_custkey) AS n FROM f GROUP BY 1)
SELECT coalesce(a.field_name, b.field_name) AS field_name, coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) AS n_after, coalesce(a.n, 0) - coalesce(b.n, 0) AS change FROM b FULL JOIN a ON a.field_name = b.field_name""")
def coverage_change(spark, d):
    """Fields of the rules only, and of both layers, with one field renamed."""
    rows = _store(spark, d)[2]
    named = rows.withColumn("field_name", F.when(F.col("field_name").startswith("1"), "new").otherwise(F.col("field_name")))
    return store.coverage_change(rows.filter("extractor = 'rule'"), named)


@query(f"""
WITH k AS (SELECT o_orderkey, kind FROM ({ORACLES["detect_contradictions"]})) SELECT o_orderkey, count(*) AS n, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM k GROUP BY 1""")
def campaign_contradictions(spark, d):
    """D15"""
    found = contradict.by_campaign(contradict.detect(_doubtful_pages(spark, d)), "o_orderkey")
    return found.select("o_orderkey", F.col("n").cast("long").alias("n"), F.array_join("kinds", ",").alias("kinds"))


@query("SELECT split, count(*) AS reads, CAST(count(*) FILTER (r = 1) AS BIGINT) AS changed FROM (SELECT CASE WHEN c_custkey % 5 < 3 THEN 'test' ELSE 'dev' END AS split FROM customer GROUP BY 1), range(3) t(r) GROUP BY 1")
def split_accesses(spark, d):
    """Frozen splits are read three times, once with a row changed."""
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 < 3, "test").otherwise("dev").alias("split"))
    frozen = gold.freeze(rows, "c_custkey")
    other = gold.freeze(rows.withColumn("c_custkey", F.when(F.col("c_custkey") % 1000 == F.col("c_custkey"), F.col("c_custkey") + 1_000_000).otherwise(F.col("c_custkey"))), "c_custkey")
    return gold.accesses(frozen.unionByName(frozen).unionByName(other), frozen)
