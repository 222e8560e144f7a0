"""From raw documents to packed sequences: quality rules, near-duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. It is written as Parquet, and the next one reads it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablarium.llm.common import broadcast_if_small, fresh, materialize, read
from tablarium.llm.decontamination import phrase_hits, text_key
from tablarium.llm.near_copies import without_near_copies
from tablarium.llm.packing import pack
from tablarium.llm.personal_data import personal_spans, redact
from tablarium.llm.quality_rules import judge, labelled_sample, learn_rules

MAX_LABELLED = 20_000


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base test or meet a learned rule go.

    Null and empty texts fail the base test; long texts are judged whole; repeated rows and null doc_ids are judged row by
    row; extra columns stay, whatever their names. An empty table stays empty; without labels only the base test counts.
    """
    rules = learn_rules(labelled_sample(docs, read(spark, sf_dir, "labels"), MAX_LABELLED))
    return judge(docs, rules)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a five-word Jaccard similarity of 0.8 or more the one with the smallest doc_id stays.

    Texts without words, null ones too, are one group. Of repeated rows one stays; a null doc_id comes after all others.
    Extra columns stay, whatever their names. An empty table stays empty.
    """
    return without_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts are clean; repeated rows and null doc_ids are judged by their text; extra columns stay. An empty
    table, or benchmark, is fine.
    """
    # rows are searched by their text, as doc_ids can be null or repeated
    key = fresh("key", *docs.columns)
    keyed = docs.withColumn(key, text_key(F.col("text")))
    found = phrase_hits(keyed.select(F.col(key).alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    return keyed.join(broadcast_if_small(materialize(found.select(F.col("doc").alias(key)).distinct())), key, "left_anti").select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in brackets; n_chars follows where a text changes.

    Null texts stay null; repeated rows and null doc_ids are rows like others; extra columns stay, whatever their names.
    """
    name = fresh("spans", *docs.columns)
    found = personal_spans(docs, tuple(docs.columns), name)
    some = F.size(name) > 0
    text = F.when(some, redact(F.col("text"), F.col(name))).otherwise(F.col("text"))
    done = found.withColumn("text", text).withColumn("n_chars", F.when(some, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; see pack(). Null and empty texts are one token each."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_good),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: Learned rules, fingerprints and tokens are beyond SQL; tests/llm compares run() with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
