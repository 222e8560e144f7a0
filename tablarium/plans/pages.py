"""Registered queries on crawl planning, offers, contradictions and agreement, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablarium.functions.spread import spread
from tablarium.operators import agreement, contradict, offers, route, store
from tablarium.plans.catalogue import _store, cents, query, table, tr
from tablarium.sources import crawl, files


def _pick(key: str, *texts: str) -> Column:
    return F.element_at(F.array(*map(F.lit, texts)), (F.col(key) % len(texts) + 1).cast("int"))


@query("SELECT page_id, regexp_replace(regexp_extract(url, '//([^/]*)', 1), '^www[.]', '') AS host, regexp_extract(url, '^[^?#]*') AS url FROM pages")
def url_parts(spark, d):
    """URLs with a slash and a fragment added lose both."""
    u = F.regexp_extract("url", "^[^?#]*", 0)
    return table(spark, d, "pages").select("page_id", crawl.host(F.col("url")).alias("host"), crawl.normalize_url(F.concat(u, F.lit("/#top"))).alias("url"))


@query("""
SELECT page_id, unnest(list_transform(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda x: regexp_extract(url, '^https?://[^/]*') || x)) AS link FROM pages""")
def page_links(spark, d):
    """Pages link from the root."""
    return table(spark, d, "pages").select("page_id", F.explode_outer(crawl.extract_links(F.col("html"), F.col("url"))).alias("link")).filter("link is not null")


@query("SELECT page_id, regexp_extract(url, '^https?://[^/]*') || '/a/c' || CASE WHEN page_id % 2 = 0 THEN '?x=1' ELSE '' END AS link FROM pages")
def relative_links(spark, d):
    """Links with . and .. in them."""
    base = F.concat(F.regexp_extract("url", "^https?://[^/]*", 0), F.lit("/a/b/page?q=../z"))
    return table(spark, d, "pages").select("page_id", crawl.absolute(_pick("page_id", "../c?x=1", "./../c"), base).alias("link"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\s+', ' ', 'g'))[1:200] AS title FROM pages")
def page_titles(spark, d):
    """P10"""
    return table(spark, d, "pages").select("page_id", crawl.page_title(F.col("html")).alias("title"))


@query(r"""
SELECT url, 4 AS priority, length(url) - length(replace(url, '/', '')) AS depth FROM (SELECT DISTINCT regexp_replace(regexp_replace(url, '#.*', ''), '^([^:]+://[^/?]*/[^?]*)/(\?|$)', '\1\2') AS url FROM pages) ORDER BY depth, url LIMIT 25""")
def rank_pages(spark, d):
    """B07, B08"""
    return crawl.rank_urls(table(spark, d, "pages").select("url"), n=25)


@query("SELECT s_suppkey, [0, 1, 2, 3, 4][s_suppkey % 5 + 1] AS priority, s_suppkey % 5 NOT IN (3, 4) AS matches FROM supplier")
def url_priority(spark, d):
    """B05, B08"""
    url = F.concat(F.lit("https://b.example"), _pick("s_suppkey", "/kampanyalar/x", "/yaz-kampanyasi", "/FINANSMAN/ev", "/hediye", "/iletisim"))
    hit = crawl.matches(url, ["kampanya", "finansman", "hediye"], ["hediye"])
    return table(spark, d, "supplier").select("s_suppkey", crawl.priority(url).alias("priority"), hit.alias("matches"))


_ROBOTS = "User-agent: other\nUser-agent: seeker # two names\nDisallow: /a\nAllow: /a/open\nDisallow: /*.pdf$\n\nUser-agent: *\nDisallow: /\nDisallow:"


@query("SELECT s_suppkey, [false, true, false, true, true][s_suppkey % 5 + 1] AS named, false AS others FROM supplier")
def robots_rules(spark, d):
    """B09, B10"""
    target = _pick("s_suppkey", "/a/x", "/a/open/1", "/b.pdf", "/b.pdf?x", "/c")
    rules = crawl.parse_robots(F.lit(_ROBOTS))
    return table(spark, d, "supplier").select("s_suppkey", crawl.allows(rules, target, "Seeker").alias("named"), crawl.allows(rules, target, "unknown").alias("others"))


@query("SELECT c_custkey, ['kampanyalar-sifir-faizsiz-konut', 'ev', 'b-example', 'x-y'][c_custkey % 4 + 1] AS slug FROM customer")
def url_slugs(spark, d):
    """B12"""
    url = F.concat(F.lit("https://b.example"), _pick("c_custkey", "/Kampanyalar/Sıfır Faizsiz_KONUT.aspx", "/Sayfalar/ev.html", "", "/x/y/?q=1"))
    return table(spark, d, "customer").select("c_custkey", crawl.url_to_slug(url).alias("slug"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(round(o_totalprice * 100) AS BIGINT) / 100.0 END AS value FROM orders")
def extract_reward(spark, d):
    """The gift, not the amount to be spent."""
    gift, k = F.concat(tr(cents("o_totalprice")), F.lit(" TL")), F.col("o_orderkey") % 4
    text = (
        F.when(k == 0, F.concat(F.lit("Toplam 500 TL tutarındaki bütün alışverişler için, üstelik hemen "), gift, F.lit(" hediye!"))).when(k == 1, F.concat(F.lit("ÖDÜL: "), gift))
        .when(k == 2, F.concat(F.lit("9 TL ile 30 gün; kazanç: "), gift, F.lit(" bonus"))).otherwise("500 TL üzeri harcamaya indirim")
    )
    rows = spread(table(spark, d, "orders").select("o_orderkey", "o_totalprice"))
    return rows.select("o_orderkey", offers.reward(text)["value"].alias("value"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'rate' WHEN 1 THEN 'points' END AS kind, CASE WHEN p_partkey % 3 < 2 THEN CAST(p_size AS DOUBLE) END AS value FROM part")
def extract_points(spark, d):
    """X14"""
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat(F.lit("Her alışverişte %"), n, F.lit(" puan iadesi"))).when(k == 1, F.concat(n, F.lit(" chip-para kazanın"))).otherwise("Puan yok")
    return table(spark, d, "part").select("p_partkey", offers.points(text).alias("p")).select("p_partkey", "p.*")


@query("SELECT c_custkey, ['belirli_segment,maas_musterisi', 'yeni_musteri', NULL, 'mevcut_musteri'][c_custkey % 4 + 1] AS audience FROM customer")
def extract_audience(spark, d):
    """A segment that is excluded isn't one."""
    text = _pick("c_custkey", "Maaş müşterileri ve EMEKLİ vatandaşlar", "Yeni müşterilere", "Öğrenci olmayanlar", "Mevcut müşterilerimizin bütün harcamalarında; yeni üye hariç")
    return table(spark, d, "customer").select("c_custkey", F.array_join(offers.audience(text), ",").alias("audience"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 2 WHEN s_suppkey % 3 = 1 THEN 8 END AS n FROM supplier")
def extract_conditions(spark, d):
    """At most eight; boilerplate doesn't count."""
    two = "Kampanya için başvuru zorunludur. Bu zorunlu çerez kullanılır hep. Merhaba sevgili dostlar. Sadece mobil kanaldan geçerli olur."
    text = F.when(F.col("s_suppkey") % 3 == 0, two).when(F.col("s_suppkey") % 3 == 1, F.repeat(F.lit("En az 100 TL harcama gerekir. "), 10)).otherwise("Koşul yok. Kısa.")
    return table(spark, d, "supplier").select("s_suppkey", F.size(offers.conditions(text)).alias("n")).withColumn("n", F.when(F.col("n") > 0, F.col("n")))


@query("""
SELECT l_orderkey, l_linenumber, round(greatest(0.05, least(0.98, 0.7 + CASE WHEN l_linenumber = 7 THEN -0.15 WHEN l_linenumber * 10 <= 15 THEN 0.25 WHEN l_linenumber * 10 <= 60 THEN 0.12 ELSE -0.15 END
 - CASE WHEN l_quantity > 15 THEN 0.45 ELSE 0 END - CASE WHEN l_linenumber > 3 THEN 0.1 ELSE 0 END)), 3) AS confidence FROM lineitem""")
def field_confidence(spark, d):
    """X17, X18"""
    n = F.col("l_linenumber")
    score = offers.confidence(F.lit("kar_payi_orani"), F.array(F.col("l_quantity").cast("double")), F.when(n < 7, n * 10), F.when(n > 3, 2).otherwise(1), F.lit(False))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", score.alias("confidence"))


@query("""
SELECT p_partkey, strpos(p_name, split_part(p_name, ' ', 2)) - 1 AS s, strpos(p_name, split_part(p_name, ' ', 2)) - 1 + length(split_part(p_name, ' ', 2)) AS e, split_part(p_name, ' ', 2) = left(p_name, length(split_part(p_name, ' ', 2))) AS stored,
 strpos(substr(p_name, strpos(p_name, split_part(p_name, ' ', 2)) + 1), split_part(p_name, ' ', 2)) > 0 AS ambiguous FROM part""")
def span_checks(spark, d):
    """The second word is found wherever the stored offsets don't hold."""
    raw, text = F.split_part("p_name", F.lit(" "), F.lit(2)), F.col("p_name")
    zero = F.lit(0)
    span = offers.locate_span(text, F.lit(1), F.lit(1), raw, F.lit("?"))
    return table(spark, d, "part").select("p_partkey", span["s"].alias("s"), span["e"].alias("e"), span["ambiguous"].alias("ambiguous"), offers.verify_span(text, zero, F.length(raw), raw).alias("stored"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.085 THEN 'high' WHEN l_discount >= 0.06 THEN 'medium' ELSE 'low' END AS level FROM lineitem")
def confidence_levels(spark, d):
    """N13"""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", offers.confidence_level(F.col("l_discount") * 10).alias("level"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND CAST(o_orderdate AS DATE) < DATE '1996-01-01' THEN CAST(o_orderdate AS DATE) END AS ended FROM orders""")
def expired_pages(spark, d):
    """Not where the page says so or lists two campaigns."""
    day = F.date_format("o_orderdate", "dd.MM.yyyy")
    claim = F.concat(F.lit("Kampanya "), day, F.lit(" tarihine kadar geçerlidir. "))
    text = F.concat(claim, F.when(F.col("o_orderkey") % 3 == 0, "").when(F.col("o_orderkey") % 3 == 1, "Süresi dolmuştur.").otherwise("Kampanya 1 Mart 2030 tarihine kadar sürer."))
    ended = contradict.expired_but_published(F.lit("https://b.example/kampanya/1"), text, F.lit("1996-01-01").cast("date"))
    return table(spark, d, "orders").select("o_orderkey", ended.alias("ended"))


def _product_pages(spark, d):
    """Customers' orders are pages of a product each; the first digit of the price is the rate."""
    url = F.concat(F.lit("https://b.example/urunler/finansman-"), F.char(F.lit(97) + F.col("o_custkey") % 26), F.lit("x/index.html"))
    day = F.date_format("o_orderdate", "dd.MM.yyyy")
    text = F.concat(F.lit("Kampanya "), day, F.lit(" tarihine kadar geçerlidir. No "), F.when(F.col("o_orderkey") % 7 == 0, "emeklilere özel").otherwise(F.col("o_orderkey").cast("string")))
    rate = F.col("o_orderkey") % 5
    return table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("bank"), url.alias("url"), text.alias("text"), F.col("o_orderkey").alias("seq"), rate.alias("lo"), (rate + 1).alias("hi"))


_GROUPS = """
WITH p AS (SELECT o_custkey % 50 AS bank, 'finansman-' || chr(CAST(97 + o_custkey % 26 AS INTEGER)) || 'x' AS product, o_orderkey AS seq, CAST(o_orderdate AS DATE) AS day, o_orderkey % 7 = 0 AS segment, o_orderkey % 5 AS lo,
  CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE o_orderkey END AS t FROM orders),
f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY bank, product, day, t ORDER BY seq) = 1), g AS (SELECT * FROM f QUALIFY count(*) OVER (PARTITION BY bank, product) > 1),
r AS (SELECT *, first(seq) OVER w AS a, first(lo) OVER w AS alo FROM g WHERE NOT segment WINDOW w AS (PARTITION BY bank, product ORDER BY seq)),
e AS (SELECT *, first(seq) OVER w AS a, first(day) OVER w AS aday FROM g WINDOW w AS (PARTITION BY bank, product ORDER BY seq))
"""


@query(_GROUPS + "SELECT bank, product, count(*) AS n, min(seq) AS first FROM g GROUP BY ALL")
def product_group_sizes(spark, d):
    """D09, D10"""
    return contradict.product_groups(_product_pages(spark, d)).groupBy("bank", "product").agg(F.count("*").alias("n"), F.min("seq").alias("first"))


@query(_GROUPS + """SELECT 'capraz_kar_payi_uyusmazligi' AS kind, bank, product, a AS seq_a, seq AS seq_b FROM r WHERE seq > a AND abs(lo - alo) > 1.005
UNION ALL SELECT 'capraz_kampanya_bitisi', bank, product, a, seq FROM e WHERE seq > a AND day <> aday""")
def cross_contradictions(spark, d):
    """D11 to D13"""
    return contradict.detect_across(contradict.product_groups(_product_pages(spark, d)))


@query("SELECT l_orderkey, l_linenumber, l_linenumber * 300 - 300 <= 400 + l_quantity AS near FROM lineitem")
def span_scope(spark, d):
    """D02"""
    b = F.col("l_linenumber") * 300
    near = contradict.in_same_scope(F.lit(0), F.lit(300) + F.col("l_quantity").cast("int"), b, b + 10)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", near.alias("near"))


@query("""
WITH x AS (SELECT l_orderkey AS unit, l_returnflag AS label FROM lineitem), c AS (SELECT unit, label, count(*) AS n FROM x GROUP BY ALL), s AS (SELECT unit, sum(n) AS m, sum(n * n) AS sq FROM c GROUP BY 1 HAVING sum(n) >= 2),
o AS (SELECT count(*) AS units, avg((sq - m) / (m * (m - 1))) AS pb, sum(m) AS t FROM s), e AS (SELECT sum(CAST(k AS DOUBLE) * k) AS q FROM (SELECT label, sum(n) AS k FROM c SEMI JOIN s USING (unit) GROUP BY 1))
SELECT units, round(pb, 6) AS p_bar, round(q / t / t, 6) AS p_expected, round((pb - q / t / t) / (1 - q / t / t), 6) AS kappa FROM o, e""")
def fleiss(spark, d):
    """E14"""
    return agreement.fleiss_kappa(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_returnflag").alias("label")))


_ALPHA = """
WITH x AS (SELECT l_orderkey AS unit, row_number() OVER () AS k, l_linestatus = 'O' AS lbl, l_quantity AS val FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey) >= 2), m AS (SELECT unit, count(*) AS m FROM x GROUP BY 1),
o AS (SELECT sum({d} / (m - 1)) AS o FROM x a JOIN x b ON a.unit = b.unit AND a.k <> b.k JOIN m ON m.unit = a.unit), v AS (SELECT {v} AS v, count(*) AS c FROM x GROUP BY 1), n AS (SELECT count(*) AS n FROM x),
e AS (SELECT sum(CAST(p.c AS DOUBLE) * q.c * {e}) AS e FROM v p, v q) SELECT n, round(1 - (o / n) / (e / n / (n - 1)), 6) AS alpha FROM o, e, n"""


@query(_ALPHA.format(d="CASE WHEN a.lbl = b.lbl THEN 0.0 ELSE 1.0 END", v="lbl", e="CASE WHEN p.v = q.v THEN 0 ELSE 1 END"))
def krippendorff_nominal(spark, d):
    """E15"""
    return agreement.krippendorff_alpha(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit"), (F.col("l_linestatus") == "O").cast("int").alias("value")), interval=False)


@query(_ALPHA.format(d="pow(a.val - b.val, 2)", v="val", e="pow(p.v - q.v, 2)"))
def krippendorff_interval(spark, d):
    """E15"""
    return agreement.krippendorff_alpha(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_quantity").alias("value")), interval=True)


@query("SELECT l_orderkey, l_linenumber, l_discount < 0.005 AS strict, abs(l_discount) < 0.015 OR l_linenumber % 2 = 0 AS tolerant FROM lineitem")
def match_rates(spark, d):
    """2 against values up to 0.1 % of it higher, and in a range."""
    made = lambda n, a, b: F.struct(n.cast("double").alias("num"), a.cast("double").alias("min"), b.cast("double").alias("max"))
    null, even = F.lit(None), F.col("l_linenumber") % 2 == 0
    x = 2 + F.round(F.col("l_discount") * 100) * 0.015
    gold = F.when(even & (F.col("l_discount") >= 0.005), made(null, F.lit(1), F.lit(3))).otherwise(made(x, null, null))
    pred = made(F.lit(2), null, null)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", agreement.rate_match(pred, gold, False).alias("strict"), agreement.rate_match(pred, gold, True).alias("tolerant"))


@query("SELECT p_partkey, ['range,table', 'range', ''][p_partkey % 3 + 1] AS tags FROM part")
def note_tags(spark, d):
    """E28"""
    tags = agreement.hard_tags(_pick("p_partkey", "#Range and #table, #range", "see #range #other", "none"), ["range", "table"])
    return table(spark, d, "part").select("p_partkey", F.array_join(tags, ",").alias("tags"))


@query("SELECT n_nationkey AS bank_id, lower(n_name) AS slug FROM nation UNION ALL SELECT 1000 + r_regionkey, lower(r_name) FROM region WHERE r_name NOT IN (SELECT n_name FROM nation)")
def upsert_banks(spark, d):
    """A12"""
    banks = _store(spark, d)[0].select("bank_id", "slug")
    more = table(spark, d, "region").select((F.col("r_regionkey") + 1000).alias("bank_id"), F.lower("r_name").alias("slug"))
    return files.upsert_banks(banks, banks.unionByName(more).select((F.col("bank_id") + 0).alias("bank_id"), "slug"))


@query("""
SELECT s_suppkey, ['structured', 'structured', 'rag', 'structured', 'rag', 'structured', 'structured'][k] AS path, ['kar_payi_orani', 'vade_ay', NULL, 'masraf_durumu', 'taksit_sayisi', 'taksit_sayisi', 'kar_payi_orani'][k] AS field,
  ['lowest', 'list', NULL, 'list', NULL, 'list', 'lowest'][k] AS intent, CAST(CASE WHEN k = 2 THEN s_suppkey % 90 + 10 END AS INTEGER) AS term_min, ['Konut Finansmanı', NULL, NULL, 'Taşıt Finansmanı', NULL, NULL, NULL][k] AS campaign_type,
  CASE k WHEN 1 THEN 'b,a' WHEN 3 THEN 'a' WHEN 6 THEN lower(n_name) ELSE '' END AS banks FROM (SELECT *, s_suppkey % 7 + 1 AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey)""")
def route_questions(spark, d):
    """QA1 to QA3: a bank alone makes a question structured; a word of interest means the profit rate."""
    nations = table(spark, d, "nation")
    aliases = {"alfa": "a", "alfa beta": "b"} | {n.lower(): n.lower() for (n,) in nations.select("n_name").collect()}  # 25 nations
    months = F.concat((F.col("s_suppkey") % 90 + 10).cast("string"), F.lit(" ay ve üzeri vade veren?"))
    asked = _pick("s_suppkey", "Alfa Beta ve Alfa: EN DÜŞÜK KÂR PAYI, konut", "", "Alfa nedir", "TAŞIT masrafı?", "Taksit nedir", "", "faiz EN DÜŞÜK hangi bankada?")
    text = F.when(F.col("s_suppkey") % 7 == 1, months).when(F.col("s_suppkey") % 7 == 5, F.concat(F.lower("n_name"), F.lit(" bankasının taksiti nedir?"))).otherwise(asked)
    rows = table(spark, d, "supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"))
    x = rows.select("s_suppkey", route.route(text, aliases).alias("r")).select("s_suppkey", "r.*")
    return x.select("s_suppkey", F.col("handler").alias("path"), "field", "intent", "term_min", "campaign_type", F.array_join("banks", ",").alias("banks"))


@query("SELECT c_custkey AS campaign_id, lower(n_name) AS slug, c_mktsegment AS campaign_type FROM customer JOIN nation ON c_nationkey = n_nationkey")
def all_campaigns(spark, d):
    """S05"""
    banks, campaigns, _ = _store(spark, d)
    return store.all_campaigns(campaigns, banks).select("campaign_id", "slug", "campaign_type")


@query("SELECT CAST(7 AS BIGINT) AS campaign_id, o_totalprice AS value FROM orders WHERE o_custkey = 7 ORDER BY o_orderkey LIMIT 1")
def field_value(spark, d):
    """The first value that customer 7 has of any priority, renamed to one field."""
    fields = _store(spark, d)[2].withColumn("field_name", F.lit("x"))
    return store.field_value(fields, 7, "x")


@query("""
SELECT o_custkey AS campaign_id, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS seqs FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def campaign_fields(spark, d):
    """A campaign with all its fields, in order."""
    _, campaigns, fields = _store(spark, d)
    out = store.with_fields(campaigns, fields).filter(F.size("fields") > 0)
    return out.select("campaign_id", F.size("fields").cast("bigint").alias("n"), F.array_join(F.transform("fields", lambda f: f["seq"].cast("string")), ",").alias("seqs"))
