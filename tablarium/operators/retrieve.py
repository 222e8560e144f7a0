"""Keyword and vector retrieval, and round-robin sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablarium.functions.text import STOPWORDS, WORD, tr_fold


def keyword_topk(docs: DataFrame, question: list[str], k: int = 3, least: int = 2) -> DataFrame:
    """QA7: id, score of the k texts that share most distinct words with the question, at least `least`; ties by id."""
    words = [w for w in dict.fromkeys(question) if w not in STOPWORDS]
    # only words of the question are looked for, so that stop words needn't be told in each text
    shared = F.size(F.array_intersect(F.regexp_extract_all(tr_fold(F.col("text")), F.lit(WORD), F.lit(0)), F.array(*map(F.lit, words))))
    scored = docs.select("id", shared.alias("overlap")).filter(F.col("overlap") >= least)
    return scored.select("id", F.round(F.col("overlap") / (F.sqrt(F.lit(float(len(words)))) + 1), 3).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def cosine(a: Column, b: Column) -> Column:
    """QA9: cosine of two vectors in double precision; null if one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_topk(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """QA9: id, score of the k nearest vectors; ties by id."""
    q = F.array(*map(F.lit, map(float, query)))
    return vectors.select("id", F.round(cosine(F.col("vector"), q), 4).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def round_robin(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """N rows, one of each group in turn."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("turn", turn).filter(F.col("turn") <= n).orderBy("turn", group).limit(n)  # the filter limits the window before its shuffle
