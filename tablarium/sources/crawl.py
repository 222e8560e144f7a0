"""Crawl planning as native columns: URLs, links, sitemaps, robots rules, file names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablarium.functions.text import let, tr_fold_ascii

#: What is fetched first, of campaign pages and of product pages.
CAMPAIGN_ORDER = ["/kampanya", "kampanyasi|kampanyalari", "/finansman|finansmani", "firsat|avantaj|indirim|hediye|puan"]
PRODUCT_ORDER = [
    "kar-payi|kar-paylasim|oranlar|urun-ve-hizmet-ucret|urun-hizmet|ucretler|tarife",
    "katilma|finansman|kredi|leasing",
    "hesap|yatirim|birikim|fon|sukuk|kira-sertifikasi|altin|maden|doviz",
    "bilgilendirme-form|sozlesme",
    "kart",
]
_RULE = "struct<agents:array<string>,allow:boolean,pattern:string>"


def host(url: Column) -> Column:
    """Host without www., lower case; '' if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, "^[^:/?#]+://([^/?#]*)", 1)), "^www\\.", "")


def normalize_url(url: Column) -> Column:
    """Without fragment and one slash at the path's end; the root's slash stays."""
    return F.regexp_replace(F.regexp_replace(url, "(?s)#.*", ""), "^((?:[^:/?#]+:)?//[^/?]*/[^?]*)/(\\?|$)", "$1$2")


def same_site(url: Column, base: Column) -> Column:
    """Equal hosts, or one is a part of the other's domain."""
    pair = F.struct(host(url).alias("a"), host(base).alias("b"))
    return let(pair, lambda x: (x["a"] != "") & ((x["a"] == x["b"]) | F.endswith(x["a"], F.concat(F.lit("."), x["b"])) | F.endswith(x["b"], F.concat(F.lit("."), x["a"]))))


def absolute(link: Column, base: Column) -> Column:
    """A link as seen from base, with . and .. resolved."""
    origin, scheme = F.regexp_extract(base, "^[^:/?#]+://[^/?#]*", 0), F.regexp_extract(base, "^[^:/?#]+:", 0)
    page = F.regexp_replace(base, "(?s)[?#].*", "")
    folder = F.when(page == origin, F.concat(origin, F.lit("/"))).otherwise(F.regexp_replace(page, "[^/]*$", ""))
    full = (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(F.startswith(link, F.lit("//")), F.concat(scheme, link))
        .when(F.startswith(link, F.lit("/")), F.concat(origin, link)).when(F.startswith(link, F.lit("?")), F.concat(page, link)).otherwise(F.concat(folder, link))
    )
    return let(full, lambda u: F.when(u.rlike("^[^?#]*/\\.{1,2}(/|[?#]|$)"), _resolve(u)).otherwise(u))


def _resolve(url: Column) -> Column:
    pattern = "(?s)^([^:/?#]+://[^/?#]*)([^?#]*)(.*)$"

    def step(acc: Column, part: Column) -> Column:
        return F.when(part == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(part == ".", acc).otherwise(F.concat(acc, F.array(part)))

    parts = F.split(F.regexp_replace(F.regexp_replace(F.regexp_extract(url, pattern, 2), "^/", ""), "(^|/)(\\.{1,2})$", "$1$2/"), "/")
    path = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.concat(F.regexp_extract(url, pattern, 1), F.lit("/"), path, F.regexp_extract(url, pattern, 3))


def extract_links(html: Column, base: Column) -> Column:
    """Array of absolute links of a page; empty links and fragments are left out."""
    found = F.transform(F.regexp_extract_all(html, F.lit("(?is)<a\\s[^>]*?href\\s*=\\s*[\"']([^\"']*)"), F.lit(1)), lambda u: F.trim(u))
    return F.transform(F.filter(found, lambda x: (x != "") & ~F.startswith(x, F.lit("#"))), lambda x: absolute(x, base))


def parse_sitemap(xml: Column) -> Column:
    """Struct locs, is_index."""
    return F.struct(F.regexp_extract_all(xml, F.lit("(?is)<loc>\\s*(.*?)\\s*</loc>"), F.lit(1)).alias("locs"), xml.rlike("(?i)<sitemapindex").alias("is_index"))


def matches(url: Column, include: list[str], exclude: list[str]) -> Column:
    """Patterns to exclude win; without patterns to include all others match."""
    hit = lambda ps: url.rlike(f"(?i){'|'.join(f'(?:{p})' for p in ps)}")
    return (~hit(exclude) if exclude else F.lit(True)) & (hit(include) if include else F.lit(True))


def priority(url: Column, order: list[str] = CAMPAIGN_ORDER) -> Column:
    """Index of the first pattern that the URL meets, or their number."""
    return F.coalesce(*[F.when(url.rlike(f"(?i){p}"), k) for k, p in enumerate(order)], F.lit(len(order)))


def rank_urls(urls: DataFrame, order: list[str] = CAMPAIGN_ORDER, n: int | None = None) -> DataFrame:
    """Distinct URLs by priority, depth and name; the first n if given."""
    out = urls.select(normalize_url(F.col("url")).alias("url")).distinct().withColumn("priority", priority(F.col("url"), order)).withColumn("depth", F.size(F.split("url", "/")) - 1)
    out = out.orderBy("priority", "depth", "url")
    return out if n is None else out.limit(n)


def walk_sitemaps(starts: DataFrame, stored: DataFrame, max_depth: int = 2, max_sitemaps: int = 12) -> tuple[DataFrame, DataFrame]:
    """(site, url) of the pages and (site, sitemap, note) of the failures of a walk over stored sitemaps (url, body, ok), for all sites at once.

    starts: site, url, at (their order). Indexes lead on to their sitemaps down to max_depth, breadth first; a sitemap is read once, and
    max_sitemaps of a site at most. Each level is one join with what is stored.
    """
    first = starts.select("site", "url", F.array(F.col("at").cast("int")).alias("at"))
    seen, pages, notes, frontier = None, [], [], first
    for depth in range(max_depth + 1):
        fresh = frontier.groupBy("site", "url").agg(F.min("at").alias("at"))
        known = starts.select("site").distinct().withColumn("read", F.lit(0).cast("long"))
        if seen is not None:
            fresh = fresh.join(seen.select("site", "url"), ["site", "url"], "left_anti")
            known = seen.groupBy("site").agg(F.count("*").alias("read"))
        # the frontier of a site is what a few indexes list
        placed = fresh.withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("at"))).join(known, "site", "left")
        now = placed.filter(F.col("n") + F.coalesce("read", F.lit(0)) <= max_sitemaps).select("site", "url", "at")
        seen = now if seen is None else seen.unionByName(now)
        read = now.join(stored, "url", "left").select("site", "url", "at", F.coalesce("ok", F.lit(False)).alias("ok"), parse_sitemap(F.coalesce("body", F.lit(""))).alias("x"))
        failed = F.when(~F.col("ok"), "failed").when(F.size("x.locs") == 0, "empty")
        notes.append(read.select("site", F.col("url").alias("sitemap"), failed.alias("note")).filter("note is not null"))
        good = read.filter(F.col("ok"))
        deeper = F.col("x.is_index") if depth < max_depth else F.lit(False)
        pages.append(good.filter(~deeper).select("site", F.explode("x.locs").alias("url")))
        if depth < max_depth:
            frontier = good.filter(deeper).select("site", F.posexplode("x.locs").alias("k", "url"), "at").select("site", "url", F.concat("at", F.array("k")).alias("at"))
    every = lambda parts: reduce(DataFrame.unionByName, parts)
    return every(pages).distinct(), every(notes)


def discover(sites: DataFrame, stored: DataFrame, include: list[str], exclude: list[str], max_docs: int = 40, order: list[str] = CAMPAIGN_ORDER) -> DataFrame:
    """Site, url, source (sitemap or listing) of the pages of sites (site, base, sitemaps, listings, hosts: arrays) over stored pages (url, body, ok).

    Locations of sitemaps, listing pages that can be read and their links are normalised and kept if they are on the site or one of
    its hosts and match. A URL counts once, for a sitemap if it is in one. The first max_docs of a site by priority, depth and name stay.
    """
    starts = sites.select("site", F.posexplode("sitemaps").alias("at", "url"))
    mapped = walk_sitemaps(starts, stored)[0].withColumn("source", F.lit("sitemap"))
    lists = sites.select("site", F.explode("listings").alias("path"), F.rtrim("base", F.lit("/")).alias("base"))
    urls = lists.select("site", F.when(F.col("path").startswith("http"), F.col("path")).otherwise(F.concat("base", "path")).alias("url"))
    listed = urls.join(stored.filter("ok"), "url").select("site", F.explode(F.concat(F.array("url"), extract_links(F.coalesce("body", F.lit("")), F.col("url")))).alias("url"))
    found = mapped.unionByName(listed.withColumn("source", F.lit("listing"))).withColumn("url", normalize_url(F.col("url")))
    own = sites.select("site", F.concat(F.array("base"), F.transform(F.coalesce("hosts", F.array().cast("array<string>")), lambda h: F.when(h.startswith("http"), h).otherwise(F.concat(F.lit("https://"), h)))).alias("bases"))
    here = found.join(own, "site").filter(F.exists("bases", lambda b: same_site(F.col("url"), b)) & matches(F.col("url"), include, exclude))
    one = here.groupBy("site", "url").agg(F.max("source").alias("source"))  # sitemap comes after listing
    place = F.row_number().over(Window.partitionBy("site").orderBy(priority(F.col("url"), order), F.size(F.split("url", "/")), "url"))
    return one.withColumn("n", place).filter(F.col("n") <= max_docs).select("site", "url", "source")


def parse_robots(text: Column) -> Column:
    """Array of rules (agents, allow, pattern). Agents in neighbouring lines share the rules that follow; an empty Disallow is no rule."""
    begin = F.struct(F.array().cast("array<string>").alias("agents"), F.lit(False).alias("closed"), F.array().cast(f"array<{_RULE}>").alias("rules"))

    def step(acc: Column, line: Column) -> Column:
        key, value = F.lower(F.trim(F.regexp_extract(line, "^([^:]*):", 1))), F.trim(F.regexp_extract(line, "^[^:]*:(.*)$", 1))
        is_rule = key.isin("allow", "disallow")
        agents = F.when(key != "user-agent", acc["agents"]).when(acc["closed"], F.array(F.lower(value))).otherwise(F.concat(acc["agents"], F.array(F.lower(value))))
        rule = F.struct(acc["agents"].alias("agents"), (key == "allow").alias("allow"), value.alias("pattern"))
        rules = F.when(is_rule & (value != "") & (F.size(acc["agents"]) > 0), F.concat(acc["rules"], F.array(rule))).otherwise(acc["rules"])
        return F.struct(agents.alias("agents"), F.when(key == "user-agent", False).otherwise(acc["closed"] | is_rule).alias("closed"), rules.alias("rules"))

    return F.aggregate(F.split(F.regexp_replace(text, "[ \\t]*#[^\\n]*", ""), "\\r?\\n"), begin, step, lambda acc: acc["rules"])


def allows(rules: Column, target: Column, agent: str) -> Column:
    """The longest pattern that the path with query meets decides, Allow in ties; no rule allows. Rules that name the agent replace those of *."""

    def choose(all_rules: Column) -> Column:
        of = lambda name: F.filter(all_rules, lambda r: F.array_contains(r["agents"], name))
        return F.when(F.exists(all_rules, lambda r: F.array_contains(r["agents"], agent.lower())), of(agent.lower())).otherwise(of("*"))

    def regex(p: Column) -> Column:
        safe = F.regexp_replace(F.regexp_replace(p, "([.+?^(){}|\\[\\]\\\\]|\\$(?!$))", "\\\\$1"), "\\*", ".*")
        return F.concat(F.lit("(?s)^"), safe)

    met = F.filter(let(rules, choose), lambda r: F.regexp_like(target, regex(r["pattern"])))
    best = F.array_max(F.transform(met, lambda r: F.struct(F.length(r["pattern"]).alias("n"), r["allow"].alias("allow"))))
    return F.coalesce(best["allow"], F.lit(True))


def slugify(c: Column, fallback: str) -> Column:
    """Letters and digits without marks, joined by -, 80 at most."""
    out = F.lower(F.btrim(F.regexp_replace(tr_fold_ascii(c), "[^a-z0-9]+", "-"), F.lit("-")))
    return F.left(F.when(out == "", fallback).otherwise(out), F.lit(80))


def url_to_slug(url: Column) -> Column:
    """File name from the last two parts of the path, or the host."""
    path = F.regexp_extract(url, "^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (F.lower(p) != "sayfalar"))

    def name(p: Column) -> Column:
        tail = F.regexp_replace(F.coalesce(F.get(p, F.size(p) - 1), F.regexp_extract(url, "^[^:/?#]+://([^/?#]*)", 1)), "(?i)\\.(aspx|html?|php)$", "")
        return F.when(F.size(p) > 1, F.concat(F.get(p, F.size(p) - 2), F.lit("-"), tail)).otherwise(tail)

    return slugify(let(parts, name), "anasayfa")


def page_title(html: Column) -> Column:
    """P10: the first title, 200 characters at most; null if empty."""
    title = F.trim(F.regexp_replace(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1), "(?U)\\s+", " "))
    return F.nullif(F.left(title, F.lit(200)), F.lit(""))
