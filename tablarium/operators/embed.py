"""Passages as hashed bags of words: sparse unit vectors, and the passages nearest to each question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablarium.functions.spread import copies, spread
from tablarium.functions.text import let
from tablarium.operators.passages import passages

SIZE = 1024


def hashed_bag(text: Column, size: int = SIZE) -> Column:
    """QA12: map of place to weight: each word adds one at the first 32 bits of its SHA-256 modulo `size`; the length is 1. Without words: place 0."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "(?U)\\s+"), lambda w: w != "")
    places = lambda w: F.transform(w, lambda x: (F.conv(F.substring(F.sha2(x, 256), 1, 8), 16, 10).cast("long") % size).cast("int"))

    def weighed(p: Column) -> Column:
        distinct = F.array_sort(F.array_distinct(p))
        counts = F.transform(distinct, lambda d: F.size(F.filter(p, lambda x: x == d)).cast("double"))
        norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
        return let(counts, lambda c: F.map_from_arrays(distinct, let(norm(c), lambda n: F.transform(c, lambda x: x / n))))

    empty = F.create_map(F.lit(0), F.lit(1.0))
    return let(let(words, places), lambda p: F.when(F.size(p) > 0, weighed(p)).otherwise(empty))


def dense(bag: Column, size: int = SIZE) -> Column:
    """A map of hashed_bag() as array<float>."""
    at = lambda b: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.coalesce(F.element_at(b, k.cast("int")), F.lit(0.0)).cast("float"))
    return let(bag, at)  # else the bag would be made for each place


def build(docs: DataFrame, size: int = SIZE, most: int = 800, overlap: int = 120) -> DataFrame:
    """QA11: campaign_id, chunk_index, chunk_text, vector (array<float>), model of docs (id, text); texts without passages have no row."""
    cut = passages(spread(docs), most, overlap)
    return cut.select(F.col("id").alias("campaign_id"), "chunk_index", "chunk_text", dense(hashed_bag(F.col("chunk_text"), size), size).alias("vector"), F.lit(f"hashed-bag-{size}").alias("model"))


def nearest(questions: DataFrame, chunks: DataFrame, k: int = 5, size: int = SIZE) -> DataFrame:
    """id, campaign_id, chunk_index, score of the k passages nearest to each question by cosine; those that share no place have no row.

    questions: id, text. chunks: campaign_id, chunk_index, chunk_text. Vectors are sparse, so only places that a question has are met:
    an inverted index of places, not all pairs of texts. Of equal questions one is asked, and of equal passages the first is met; the k
    best texts hold the k best passages, as each text that comes before a passage's own has one that comes before it.
    """
    place = ["campaign_id", "chunk_index"]
    ids, members = copies(questions, "text", ["id"]), copies(chunks, "chunk_text", place, k)
    asked = ids.groupBy("copy").agg(F.first("text").alias("text")).select(F.col("copy").alias("asked"), F.explode(hashed_bag(F.col("text"), size)).alias("place", "x"))
    held = members.filter("nth = 1").select("copy", *place, F.explode(hashed_bag(F.col("chunk_text"), size)).alias("place", "y"))
    scores = asked.join(held, "place").groupBy("asked", "copy", *place).agg(F.sum(F.col("x") * F.col("y")).alias("score"))
    best = Window.partitionBy("asked").orderBy(F.desc(F.round("score", 9)), *place)
    first = lambda df: df.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).drop("n")
    rows = first(first(scores).drop(*place).join(members.select("copy", *place), "copy"))
    return ids.select("id", F.col("copy").alias("asked")).join(rows, "asked").select("id", *place, "score")
