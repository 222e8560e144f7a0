"""Contradictions within a campaign page and between pages of one product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablarium.functions.normalize import normalize_date
from tablarium.functions.spread import spread
from tablarium.functions.text import let
from tablarium.operators.fields import extract_all, field

#: Dates, statements of a campaign's end, marks of expired and of segment pages, parts of paths that name no product.
DATE = "(?:\\d{1,2}[./]\\d{1,2}[./]\\d{4}|\\d{4}-\\d{1,2}-\\d{1,2}|\\d{1,2}\\s+[A-Za-zÇĞİÖŞÜçğıöşü]+\\s+\\d{4})"
END_CLAIMS = [
    f"(?iu)kampanya[^.]{{0,80}}?({DATE})\\s*tarihine\\s+(?:kadar|dek)[^.]{{0,40}}?ge[çc]erli",
    f"(?iu)kampanya[^.]{{0,80}}?{DATE}\\s*[-–—]\\s*({DATE})\\s*tarihleri\\s+aras[ıi]nda[^.]{{0,60}}?ge[çc]erli",
    f"(?iu)kampanya\\s+ba[şs]lang[ıi][çc]\\s*(?:ve\\s*)?biti[şs]\\s*(?:tarihi\\s*)?:?\\s*{DATE}\\s*[-–—]\\s*({DATE})",
]
_MONTH = "[A-Za-zÇĞİÖŞÜçğıöşü]+"
WINDOW_END = (
    f"(?iu)kampanya[^.]{{0,80}}?(?:{DATE}\\s*[-–—]\\s*{DATE}|{DATE}\\s*tarihine\\s+(?:kadar|dek)|"
    f"\\d{{1,2}}\\s*[-–—]\\s*\\d{{1,2}}\\s+{_MONTH}\\s+\\d{{4}}|\\d{{1,2}}\\s+{_MONTH}\\s*[-–—]\\s*\\d{{1,2}}\\s+{_MONTH}\\s+\\d{{4}})"
)
SELF_EXPIRED = "(?iu)s[üu]resi\\s+dolmu[şs]|sona\\s+erdi|sona\\s+ermi[şs]|biten\\s+kampanya|ge[çc]mi[şs]\\s+kampanya"
ARCHIVE = "(?iu)arsiv|ar[şs]iv|archive|biten"
SEGMENT = (
    "(?iu)çalışanlar[ıi]na\\s+özel|calisanlarina\\s+ozel|emeklilere\\s+özel|gençlere\\s+özel|kamu\\s+çalışan|personeline\\s+özel|"
    "üyelerine\\s+özel|yeni\\s+müşterilere\\s+özel|dijital\\s+müşterilere\\s+özel"
)
NO_PRODUCT = (
    "sayfalar tr tr-tr en index default detay detail kampanya kampanyalar bireysel kurumsal kobi ticari musteri kendim-icin isim-icin urunler urun"
).split()
SCOPE, RATE_TOLERANCE = 400, 0.005


def positive(value: Column, amount: Column, rate: Column) -> Column:
    """The first of the three that isn't null, if it is above zero; else null."""
    return let(F.coalesce(value, amount, rate), lambda v: F.when(v > 0, v))


def in_same_scope(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Spans that overlap or lie at most 400 characters apart; missing offsets count as near."""
    gap = F.greatest(a_start, b_start) - F.least(a_end, b_end)
    return F.coalesce((a_start + a_end + b_start + b_end).isNull() | (gap <= SCOPE), F.lit(True))


def end_dates(text: Column) -> Column:
    """Sorted distinct dates on which the text says that the campaign ends."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in END_CLAIMS]))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(found, normalize_date))))


def looks_like_listing(text: Column) -> Column:
    """Periods that end on different days."""
    ends = F.transform(F.regexp_extract_all(text, F.lit(WINDOW_END), F.lit(0)), lambda w: F.array_max(F.transform(F.regexp_extract_all(w, F.lit(DATE), F.lit(0)), normalize_date)))
    return F.size(F.array_distinct(F.array_compact(ends))) > 1


def expired_but_published(url: Column, text: Column, as_of: Column) -> Column:
    """The single end date, if it is before as_of and the page neither is archived nor says so nor lists several campaigns; else null."""
    fits = F.coalesce(url, F.lit("")).rlike("(?i)kampanya") & ~url.rlike(ARCHIVE) & ~text.rlike(SELF_EXPIRED) & ~looks_like_listing(text)
    return F.when(fits, let(end_dates(text), lambda d: F.when((F.size(d) == 1) & (F.get(d, F.lit(0)) < as_of), F.get(d, F.lit(0)))))


def fee_contradictions(claim: Column, fee: Column) -> Column:
    """array<struct<kind, low, high>> of two fields of extract_all(): a denied fee beside a positive one in its scope, or with an amount."""
    denied = ~claim["has_fee"]
    level = positive(fee["value"], fee["amount"], fee["rate"])
    near = in_same_scope(claim["s"], claim["e"], fee["s"], fee["e"])
    found = lambda kind, when, value: F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("low"), value.cast("string").alias("high")))
    return F.array_compact(F.array(found("masrafsiz_ama_ucret", denied & level.isNotNull() & near, level), found("masrafsiz_ama_tutar", denied & (claim["amount"] > 0), claim["amount"])))


def conflicting_end_dates(text: Column) -> Column:
    """Struct kind, low, high if the text says that the campaign ends on different days; else null."""
    return let(end_dates(text), lambda d: F.when(F.size(d) > 1, F.struct(F.lit("celisen_kampanya_bitisi").alias("kind"), F.array_min(d).cast("string").alias("low"), F.array_max(d).cast("string").alias("high"))))


def detect(pages: DataFrame) -> DataFrame:
    """pages' columns, kind, low, high of each contradiction within a page (url, text, as_of; a null as_of leaves out what depends on the day).

    One projection; a page without contradictions has no row.
    """
    fees = let(extract_all(F.col("text")), lambda f: fee_contradictions(field(f, "masraf_durumu"), field(f, "tahsis_ucreti")))
    ended = expired_but_published(F.col("url"), F.col("text"), F.col("as_of"))
    expired = let(ended, lambda d: F.when(d.isNotNull(), F.struct(F.lit("suresi_dolmus_kampanya").alias("kind"), d.cast("string").alias("low"), F.col("as_of").cast("string").alias("high"))))
    found = F.concat(fees, F.array_compact(F.array(conflicting_end_dates(F.col("text")), expired)))
    return spread(pages).withColumn("found", F.explode_outer(found)).filter("found is not null").select(*pages.columns, "found.*")


def by_campaign(found: DataFrame, key: str) -> DataFrame:
    """Key, n, kinds (sorted), contradictions (array of kind, low, high) of each campaign with any of detect()'s rows; a campaign has a few."""
    one = F.array_sort(F.collect_list(F.struct("kind", "low", "high")))
    grouped = found.groupBy(key).agg(one.alias("contradictions"))
    return grouped.select(key, F.size("contradictions").alias("n"), F.array_sort(F.array_distinct(F.transform("contradictions", lambda c: c["kind"]))).alias("kinds"), "contradictions")


def scan(pages: DataFrame) -> DataFrame:
    """Kind, scope, n over all pages (bank, url, text, seq, as_of, lo, hi): contradictions within pages and between pages of a product."""
    within = detect(pages.select("url", "text", "as_of")).select("kind", F.lit("intra").alias("scope"))
    across = detect_across(product_groups(pages)).select("kind", F.lit("cross").alias("scope"))
    return within.unionByName(across).groupBy("kind", "scope").agg(F.count("*").alias("n"))


def product_key(url: Column) -> Column:
    """The last part of the path that names a product, of 8 characters or more; null for local files."""
    parts = F.slice(F.split(F.regexp_replace(url, "^.*://", ""), "/"), F.lit(2), F.lit(10_000))
    clean = F.transform(parts, lambda p: F.regexp_replace(F.lower(F.regexp_replace(p, "(?i)\\.(aspx|html?|php)$", "")), "[-_]\\d+$", ""))
    named = F.filter(clean, lambda p: (p != "") & ~p.isin(*NO_PRODUCT))
    leaf = lambda n: F.get(n, F.size(n) - 1)
    return F.when(~F.startswith(url, F.lit("file://")), let(let(named, leaf), lambda k: F.when(F.length(k) >= 8, k)))


def product_groups(pages: DataFrame) -> DataFrame:
    """Pages (bank, url, text, seq, ...) with product, of products with two different texts or more; equal texts count once, the first."""
    keyed = pages.withColumn("product", product_key(F.col("url"))).filter("product is not null")
    same = Window.partitionBy("bank", "product", F.sha2("text", 256)).orderBy("seq")
    first = keyed.withColumn("_n", F.row_number().over(same)).filter("_n = 1").drop("_n")
    sizes = first.groupBy("bank", "product").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return first.join(sizes, ["bank", "product"], "left_semi")


def _with_first(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each group's first row's columns beside every other row; grouped before they are joined, so no task holds a group."""
    first = rows.groupBy("bank", "product").agg(F.min(F.struct("seq", *columns)).alias("base"))
    return rows.join(first, ["bank", "product"]).filter(F.col("seq") > F.col("base.seq"))


def cross_rates(groups: DataFrame) -> DataFrame:
    """Pages of a product whose rate (lo, hi) doesn't meet the first page's; segment pages and pages without rate don't count."""
    usable = groups.filter(F.col("lo").isNotNull() & F.col("hi").isNotNull() & ~F.col("text").rlike(SEGMENT)).select("bank", "product", "seq", "lo", "hi")
    apart = (F.col("base.lo") > F.col("hi") + RATE_TOLERANCE) | (F.col("lo") > F.col("base.hi") + RATE_TOLERANCE)
    return _with_first(usable, ["lo", "hi"]).filter(apart).select("bank", "product", F.col("base.seq").alias("seq_a"), F.col("seq").alias("seq_b"))


def cross_end_dates(groups: DataFrame) -> DataFrame:
    """Pages of a product whose single end date isn't the first page's; pages that say they have expired don't count."""
    dated = groups.filter(~F.col("text").rlike(SELF_EXPIRED)).withColumn("ends", end_dates(F.col("text"))).filter(F.size("ends") == 1)
    dated = dated.select("bank", "product", "seq", F.get("ends", F.lit(0)).alias("day"))
    return _with_first(dated, ["day"]).filter("day <> base.day").select("bank", "product", F.col("base.seq").alias("seq_a"), F.col("seq").alias("seq_b"))


def detect_across(groups: DataFrame) -> DataFrame:
    """Kind, bank, product, seq_a, seq_b of both rules."""
    kinds = {"capraz_kar_payi_uyusmazligi": cross_rates(groups), "capraz_kampanya_bitisi": cross_end_dates(groups)}
    a, b = (df.select(F.lit(kind).alias("kind"), "*") for kind, df in kinds.items())
    return a.unionByName(b)
