"""File sources and sinks: text corpora with sidecars, JSON or JSON lines, review tables, stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablarium.functions.text import content_hash, normalize_text

_SIDECAR = "source_url string, title string, content_hash string, scraped_at string"
#: Columns of the review table, in order.
REVIEW = "doc_id bank field rule_value llm_value agree priority snippet verdict corrected_value note".split()


def read_corpus(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """Path, text, source_url, content_hash, scraped_at of all files below path; empty texts are left out. A file's sidecar NAME.meta.json may be
    missing or broken: then the URL is the file's and the hash that of the text."""
    read = lambda glob: spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    stem = lambda end: F.regexp_replace("path", f"{end.replace('.', '[.]')}$", "").alias("stem")
    texts = read(f"*{suffix}").select("path", stem(suffix), normalize_text(F.col("value")).alias("text")).filter("text <> ''")
    side = read("*.meta.json").select(stem(".meta.json"), F.from_json("value", _SIDECAR).alias("meta"))
    return texts.join(side, "stem", "left").select(
        "path", "text", F.coalesce("meta.source_url", "path").alias("source_url"), F.coalesce("meta.content_hash", content_hash(F.col("text"))).alias("content_hash"), "meta.scraped_at",
    )


def read_raw_docs(spark: SparkSession, path: str, min_chars: int = 250) -> DataFrame:
    """The corpus with one row a content hash, the first path, of texts with min_chars characters or more."""
    docs = read_corpus(spark, path).filter(F.length("text") >= min_chars)
    firsts = docs.groupBy("content_hash").agg(F.min("path").alias("path"))
    return docs.join(firsts, ["content_hash", "path"], "left_semi")


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON array, of {"records": [...]} or of JSON lines."""
    whole = spark.read.text(path, wholetext=True)
    kinds = F.when(F.col("value").rlike("^\\s*\\["), F.from_json("value", f"array<struct<{schema}>>")).when(
        F.col("value").rlike('^\\s*\\{\\s*"records"\\s*:'), F.from_json("value", f"struct<records:array<struct<{schema}>>>")["records"]
    )
    lines = F.transform(F.filter(F.split("value", "\\r?\\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, f"struct<{schema}>"))
    return whole.select(F.explode(F.coalesce(kinds, lines)).alias("r")).select("r.*")


def write_review(rows: DataFrame, path: str) -> None:
    """Review table with semicolons and CRLF; columns that are missing are empty."""
    out = rows.select(*[F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string").alias(c) for c in REVIEW])
    out.write.mode("errorifexists").option("header", True).option("sep", ";").option("lineSep", "\r\n").option("escape", '"').csv(path)


def read_review(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("sep", ";").option("lineSep", "\r\n").option("escape", '"').schema(", ".join(f"{c} string" for c in REVIEW)).csv(path)


def save_docs(docs: DataFrame, path: str) -> None:
    """A10: documents (bank_slug, stem, url, ...) by bank; equal stems get -2, -3 and so on, by URL."""
    at = F.row_number().over(Window.partitionBy("bank_slug", "stem").orderBy("url"))
    name = F.when(F.col("_n") == 1, F.col("stem")).otherwise(F.concat_ws("-", "stem", "_n"))
    docs.withColumn("_n", at).withColumn("name", name).drop("_n").write.mode("errorifexists").partitionBy("bank_slug").parquet(path)


def upsert_banks(banks: DataFrame, new: DataFrame) -> DataFrame:
    """Banks, and those of new whose slug isn't known; known ones stay as they are."""
    return banks.unionByName(new.join(banks.select("slug"), "slug", "left_anti").dropDuplicates(["slug"]).select(*banks.columns))


def field_rows(campaigns: DataFrame) -> DataFrame:
    """A row for each of a campaign's fields (array of structs), with its position as seq."""
    return campaigns.select("campaign_id", F.posexplode_outer("fields").alias("seq", "f")).filter("f is not null").select("campaign_id", "seq", "f.*")
