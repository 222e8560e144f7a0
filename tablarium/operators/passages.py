"""Passages: the main text of pages, chunks, an inverted index of words, and the best passage of each campaign."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablarium.functions.text import let, match_spans, normalize_text, normalize_whitespace, split_sentences, tokenize
from tablarium.operators.retrieve import cosine

#: Elements that hold no content, those left out at first, and the least length of a main text.
NEVER, CHROME, AT_FIRST = ["noscript", "svg", "iframe", "template"], ["nav", "header", "footer", "aside"], ["form"]
#: What is no markup inside: comments, scripts and styles, whichever begins first.
RAW = "(?is)<!--.*?-->|<(script|style)\\b[^>]*>.*?</\\1\\s*>"
MIN_TEXT = 200
MAX_CHARS, OVERLAP = 800, 120
MIN_SCORE, PER_RESULT = 0.5, 5


def _tags(html: Column, names: list[str]) -> Column:
    """array<struct<s, e, m>>: the tags of some names; one that closes itself holds nothing and is left out."""
    return F.filter(match_spans(html, f"(?i)<(?:/(?:{'|'.join(names)})\\s*|(?:{'|'.join(names)})(?:\\s[^>]*)?)>"), lambda x: ~x["m"].endswith("/>"))


def _depth(now: Column, x: Column) -> Column:
    """Open elements after a tag; one that closes nothing counts for nothing."""
    return F.when(x["m"].startswith("</"), F.greatest(now - 1, F.lit(0))).otherwise(now + 1)


def _without(html: Column, names: list[str]) -> Column:
    """html without the elements of these names, with all that they hold; one that isn't closed reaches to the end.

    Within an element only tags of its own name count.
    """

    def cut(h: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            name, outside = F.lower(F.regexp_extract(x["m"], "^</?([A-Za-z]+)", 1)), acc["depth"] == 0
            counts = outside | (name == acc["name"])
            kept = F.when(outside, F.concat(acc["out"], F.array(F.substring(h, acc["at"] + 1, x["s"] - acc["at"])))).otherwise(acc["out"])
            return F.struct(
                F.when(counts, _depth(acc["depth"], x)).otherwise(acc["depth"]).alias("depth"), F.when(outside, name).otherwise(acc["name"]).alias("name"),
                F.when(counts, x["e"]).otherwise(acc["at"]).alias("at"), kept.alias("out"),
            )

        begin = F.struct(F.lit(0).alias("depth"), F.lit("").alias("name"), F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        rest = lambda a: F.when(a["depth"] == 0, F.concat(a["out"], F.array(F.substring(h, a["at"] + 1, F.length(h))))).otherwise(a["out"])
        return F.when(h.rlike(f"(?i)<(?:{'|'.join(names)})\\b"), F.array_join(F.aggregate(_tags(h, names), begin, step, rest), " ")).otherwise(h)

    return let(html, cut)


def _inner(html: Column, tag: str) -> Column:
    """What the first element of a name holds, elements of its own name included; null without one, or if it is empty."""

    def inside(h: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = F.coalesce(acc["start"], F.when(~x["m"].startswith("</"), x["e"]))
            depth = F.when(start.isNotNull(), _depth(acc["depth"], x)).otherwise(0)
            return F.struct(start.alias("start"), depth.alias("depth"), F.coalesce(acc["end"], F.when(start.isNotNull() & (depth == 0), x["s"])).alias("end"))

        none = F.lit(None).cast("int")
        begin = F.struct(none.alias("start"), F.lit(0).alias("depth"), none.alias("end"))
        return F.aggregate(_tags(h, [tag]), begin, step, lambda a: F.nullif(F.substring(h, a["start"] + 1, F.coalesce(a["end"], F.length(h)) - a["start"]), F.lit("")))

    return F.when(html.rlike(f"(?i)<{tag}\\b"), let(html, inside))


def main_text(html: Column) -> Column:
    """Text of main or article without navigation and forms; if that has under 200 characters, of the whole body, forms included."""
    strict = lambda h: normalize_text(F.coalesce(_inner(h, "main"), _inner(h, "article"), _body(h)))

    def choose(h: Column) -> Column:
        return let(let(_without(h, AT_FIRST), strict), lambda t: F.when(F.length(t) >= MIN_TEXT, t).otherwise(normalize_text(_body(h))))

    return let(_without(F.regexp_replace(html, RAW, " "), NEVER + CHROME), choose)


def _body(html: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(html, "(?is)<body\\b[^>]*>(.*?)(?:</body\\s*>|$)", 1), F.lit("")), html)


def chunks(text: Column, most: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """Array of passages of up to `most` characters, of whole sentences where they fit; each begins with up to `overlap` characters of the last."""
    if most <= 0 or not 0 <= overlap < most:
        raise ValueError("0 <= overlap < most")
    starts = lambda s: F.sequence(F.lit(0), F.greatest(F.length(s) - 1, F.lit(0)), F.lit(most))
    pieces = lambda t: F.flatten(F.transform(split_sentences(t), lambda s: F.transform(starts(s), lambda k: F.substring(s, k + 1, F.lit(most)))))

    def add(acc: Column, piece: Column) -> Column:
        now = acc["now"]
        room = F.length(now) + 1 + F.length(piece) <= most
        tail = F.ltrim(F.substring(now, F.greatest(F.length(now) - overlap + 1, F.lit(1)), F.lit(overlap)))
        begin = F.when((tail != "") & (F.length(tail) + 1 + F.length(piece) <= most), F.concat(tail, F.lit(" "), piece)).otherwise(piece)
        joined = F.when(now == "", piece).when(room, F.concat(now, F.lit(" "), piece)).otherwise(begin)
        return F.struct(joined.alias("now"), F.when((now == "") | room, acc["done"]).otherwise(F.concat(acc["done"], F.array(now))).alias("done"))

    empty = F.array().cast("array<string>")
    packed = lambda t: F.aggregate(pieces(t), F.struct(F.lit("").alias("now"), empty.alias("done")), add, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["now"]))))
    return let(normalize_whitespace(F.coalesce(text, F.lit(""))), lambda t: F.when(t != "", packed(t)).otherwise(empty))


def passages(docs: DataFrame, most: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """id, chunk_index, chunk_text of docs (id, text)."""
    return docs.select("id", F.posexplode(chunks(F.col("text"), most, overlap)).alias("chunk_index", "chunk_text"))


def inverted_index(docs: DataFrame) -> DataFrame:
    """Token and id of docs (id, text), once each; to be written by token, so that a question reads its tokens only."""
    return docs.select("id", F.explode(tokenize(F.col("text"), distinct=True)).alias("token"))


def search(index: DataFrame, question: list[str], k: int = 3, least: int = 2) -> DataFrame:
    """QA7 on M10: id, score of the k texts that share most words with the question; the filter on tokens reaches the scan."""
    words = list(dict.fromkeys(question))
    overlap = index.filter(F.col("token").isin(*words)).groupBy("id").agg(F.count("*").alias("overlap")).filter(F.col("overlap") >= least)
    return overlap.select("id", F.round(F.col("overlap") / (F.sqrt(F.lit(float(len(words)))) + 1), 3).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def best_passages(vectors: DataFrame, campaigns: DataFrame, query: list[float], k: int = 3, least: float = MIN_SCORE) -> DataFrame:
    """QA8: campaign_id, bank, chunk_index, score of the k best campaigns, each by its best passage.

    vectors: campaign_id, chunk_index, vector; of the 5 k nearest passages those of `least` or more count. campaigns: campaign_id, bank;
    passages of unknown campaigns are left out. Ties go to the smaller bank, then id.
    """
    q = F.array(*map(F.lit, map(float, query)))
    near = vectors.select("campaign_id", "chunk_index", cosine(F.col("vector"), q).alias("score")).orderBy(F.col("score").desc(), "campaign_id", "chunk_index").limit(PER_RESULT * k)
    top = near.filter(F.col("score") >= least).groupBy("campaign_id").agg(F.min(F.struct((-F.col("score")).alias("minus"), "chunk_index")).alias("best"))
    scored = top.select("campaign_id", F.col("best.chunk_index").alias("chunk_index"), F.round(-F.col("best.minus"), 3).alias("score"))
    return scored.join(campaigns.select("campaign_id", "bank"), "campaign_id").orderBy(F.col("score").desc(), "bank", "campaign_id").limit(k)


def replace_vectors(stored: DataFrame, new: DataFrame, size: int) -> DataFrame:
    """QA10: stored vectors without those of campaigns in new, and new (campaign_id, chunk_index, vector), whose vectors must have `size` numbers."""
    checked = new.withColumn("vector", F.when(F.size("vector") == size, F.col("vector")).otherwise(F.raise_error(F.lit(f"a vector doesn't have {size} numbers"))))
    return stored.join(new.select("campaign_id").distinct(), "campaign_id", "left_anti").unionByName(checked)
