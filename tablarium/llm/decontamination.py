"""Benchmark decontamination: a distributed positional inverted index of the training tokens, intersected with test windows.

Postings are rows of (term, document, position). A window's candidate places come from the postings of its rarest term,
less its offset there; these are intersected with the list of its second rarest term, likewise adjusted, and what is left
with the lists of all its terms. Only the lists that a step needs are stored: those of the two rarest terms of the windows
over all documents, then those of all terms of the windows over the documents that still have a candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablarium.llm.common import ascii_lower, broadcast_if_small, discard, materialize, read

#: What separates words once A-Z are lower case: ASCII other than digits and letters.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Places by which a term may lie off in the proximity matches of op4_decontamination.
NEAR_GAP = 2


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def text_key(text: Column) -> Column:
    """Tells texts apart; rows of one text have the same hits."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def test_windows(items: DataFrame, width: int, key: str = "item_id", text: str = "text") -> DataFrame:
    """item, n (words), terms of every window of `width` words; an item with fewer, but some, is one window."""
    t = items.select(F.col(key).alias("item"), tokens(F.col(text)).alias("t")).filter(F.size("t") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("t") - width, F.lit(0)))
    w = t.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("t"), i + 1, F.lit(width)))).alias("terms"))
    return w.select("item", F.size("terms").alias("n"), "terms").distinct()


def postings(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The positional index for `terms` (term, tid): tid, doc, pos, once for all rows of one key."""
    t = docs.select(F.col(key).alias("doc"), F.posexplode_outer(tokens(F.col(text))).alias("pos", "term"))
    return t.join(broadcast_if_small(terms.select("term", "tid")), "term").select("tid", "doc", "pos").distinct()


def term_counts(docs: DataFrame, vocabulary: DataFrame, text: str = "text") -> DataFrame:
    """vocabulary (term, tid) with tf, the term's number of occurrences in all docs."""
    seen = docs.select(F.explode_outer(tokens(F.col(text))).alias("term")).join(broadcast_if_small(vocabulary), "term").groupBy("tid").agg(F.count("*").alias("tf"))
    return vocabulary.join(seen, "tid", "left").select("term", "tid", F.coalesce("tf", F.lit(0)).alias("tf"))


def _shifted(places: DataFrame, tid: str, pos: Column, gap: int) -> DataFrame:
    """places with want (tid) and pos of each place up to gap away, and shift."""
    return places.withColumn("shift", F.explode(F.array(*map(F.lit, range(-gap, gap + 1))))).withColumns({"want": F.col(tid), "pos": pos + F.col("shift")})


def _in(lists: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(lists.withColumnRenamed("tid", "want"), ["doc", "want", "pos"])


def phrase_hits(docs: DataFrame, items: DataFrame, width: int = 10, gap: int = 0) -> DataFrame:
    """doc, item, s, n: where a test window lies in a document, as s and n of its tokens; exact: its struct of s and n if it is an exact phrase.

    docs: doc_id (rows of one doc_id have one text) and text. gap 0: exact phrases. gap > 0: proximity; for a place of the
    rarest term, each other term of the window must lie no more than gap places from its own; s and n are then those of
    the span around it.
    """
    windows = materialize(test_windows(items, width))
    shared = materialize(windows.select("n", "terms").distinct().withColumn("w", F.monotonically_increasing_id()))
    vocabulary = materialize(shared.select(F.explode("terms").alias("term")).distinct().withColumn("tid", F.monotonically_increasing_id()))
    counts = materialize(term_counts(docs, vocabulary))
    each = materialize(shared.select("w", "n", F.posexplode("terms").alias("off", "term")).join(broadcast_if_small(counts), "term").select("w", "n", "off", "tid", "tf"))
    # by rarity; a window with a term that never occurs can't occur
    r = F.array_sort(F.collect_list(F.struct("tf", "off", "tid"))).alias("r")
    ranked = each.groupBy("w", "n").agg(r).filter(F.get("r", F.lit(0))["tf"] > 0)
    steps = materialize(ranked.select("w", "n", *[F.get("r", F.lit(k))[f].alias(f"{f}{k + 1}") for k in (0, 1) for f in ("tid", "off")]))

    # the rarest term gives the places, the second rarest confirms them
    rare = steps.select(F.explode(F.array("tid1", "tid2")).alias("tid")).dropna().distinct()
    index = materialize(postings(docs, counts.join(broadcast_if_small(rare), "tid", "left_semi")))
    places = index.join(broadcast_if_small(steps), F.col("tid") == F.col("tid1")).select("w", "n", "doc", (F.col("pos") - F.col("off1")).alias("at"), "tid2", "off2").filter(F.col("at") >= -gap)
    second = _in(index, _shifted(places.filter("tid2 is not null"), "tid2", F.col("at") + F.col("off2"), gap)).select("w", "n", "doc", "at")
    left = materialize(places.filter("tid2 is null").select("w", "n", "doc", "at").unionByName(second).distinct())

    # the lists of all terms, in the documents that are left
    where = materialize(left.select("doc").distinct())
    keyed = docs.select(F.col("doc_id").alias("doc"), "text").join(broadcast_if_small(where), "doc", "left_semi")
    lists = materialize(postings(keyed, counts, key="doc"))
    terms = each.select("w", "off", "tid")

    def met(candidates: DataFrame, reach: int) -> DataFrame:
        wanted = _shifted(candidates.join(broadcast_if_small(terms), "w"), "tid", F.col("at") + F.col("off"), reach)
        return _in(lists, wanted).groupBy("w", "n", "doc", "at").agg(F.size(F.collect_set("off")).alias("terms")).filter("terms = n").drop("terms")

    exact = materialize(met(left, 0))
    hits = exact.select("w", "doc", F.col("at").alias("s"), "n", F.struct(F.col("at").alias("s"), "n").alias("exact"))
    if gap:
        near = met(left.join(exact, ["w", "n", "doc", "at"], "left_anti"), gap)
        start = F.greatest(F.col("at") - gap, F.lit(0))
        spans = near.select("w", "doc", start.alias("s"), (F.col("at") + F.col("n") + gap - start).alias("n"), F.lit(None).cast("struct<s:int,n:int>").alias("exact"))
        hits = hits.unionByName(spans)
    of = materialize(windows.join(shared, ["n", "terms"]).select("item", "w"))
    hits = materialize(hits.join(broadcast_if_small(of), "w").select("doc", "item", "s", "n", "exact"))
    discard(windows, shared, vocabulary, counts, each, steps, index, left, where, lists, exact, of)
    return hits


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, gap: int = 0) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of docs; with a gap also n_near_items.

    The first six are of exact phrases; n_near_items counts the items with a proximity match, exact ones among them.

    Null and empty texts have no words and are clean, as is all with no items; long texts are searched whole. Each row is
    searched by its text, so doc_ids can be null or repeated. No rows: no rows.
    """
    docs = docs.select("doc_id", "text", text_key(F.col("text")).alias("key"))
    found = phrase_hits(docs.select(F.col("key").alias("doc_id"), "text"), items.select("item_id", "text"), width, gap)
    spans = F.array_sort(F.collect_set("exact"))
    hit = F.aggregate(
        spans, F.struct(F.lit(0).alias("to"), F.lit(0).alias("c")),
        lambda a, x: F.struct(F.greatest(a["to"], x["s"] + x["n"]).alias("to"), (a["c"] + F.greatest(x["s"] + x["n"] - F.greatest(a["to"], x["s"]), F.lit(0))).alias("c")),
        lambda a: a["c"],
    )
    by_doc = materialize(
        found.groupBy("doc").agg(hit.cast("long").alias("n_hit"), F.array_sort(F.collect_set(F.when(F.col("exact").isNotNull(), F.col("item").cast("string")))).alias("items"), F.size(F.collect_set("item")).cast("long").alias("n_near_items"))
        .select(F.col("doc").alias("key"), "n_hit", F.size("items").cast("long").alias("n_items"), F.concat_ws(",", "items").alias("items"), "n_near_items")
    )
    sized = docs.select("doc_id", "key", F.size(tokens(F.col("text"))).cast("long").alias("n_words"))
    return sized.join(broadcast_if_small(by_doc), "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        *([F.coalesce("n_near_items", F.lit(0)).alias("n_near_items")] if gap else []),
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), gap=NEAR_GAP)


QUERIES = {"op4_decontamination": op4_decontamination}
