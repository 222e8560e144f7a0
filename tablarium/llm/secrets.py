"""Secret scans: rules with mandatory trigrams are checked only in documents that an inverted index names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablarium.llm.common import ascii_lower, broadcast_if_small, materialize, read, regex_spans, span_list
from tablarium.llm.trigrams import trigram_query

#: kind: regular expression. The first three are the base kinds; they come first in order.
RULES = {
    "assign": "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]{16,}",
    "hex": "[0-9a-f]{24,}",
    "private_key": "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----",
    "hub_token": "gh[pousr]_[A-Za-z0-9]{36,}",
    "chat_token": "xox[abprs]-[A-Za-z0-9-]{10,}",
    "web_token": "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}",
    "live_key": "[rs]k_live_[A-Za-z0-9]{16,}",
}
BASE = ("assign", "access", "hex")
#: Shortest value of an assignment.
MIN_VALUE = 6


def index_postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """gram and doc_id: the inverted index of lower-cased texts for the trigrams that the rules ask for."""
    t = docs.select("doc_id", ascii_lower(F.col("text")).alias("t"))
    has = F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(F.col("t"), g))
    return t.select("doc_id", F.explode_outer(has).alias("gram")).filter("gram is not null")


def candidates(docs: DataFrame, rules: dict[str, str] = RULES) -> tuple[DataFrame, list[str]]:
    """doc_id and kinds: rules whose trigram query the document's postings meet; and the rules that must scan all texts."""
    queries = {k: trigram_query(p) for k, p in rules.items()}
    full = [k for k, q in queries.items() if q is None]
    clauses = [(k, n, g, len(grams)) for k, q in queries.items() if q is not None for n, grams in enumerate(sorted(map(sorted, q))) for g in grams]
    spark = docs.sparkSession
    if not clauses:
        return docs.sparkSession.createDataFrame([], "doc_id long, kinds array<string>"), full
    wanted = spark.createDataFrame(clauses, "kind string, n int, gram string, needs int")
    lists = index_postings(docs, sorted({c[2] for c in clauses}))
    met = (
        lists.join(F.broadcast(wanted), "gram")  # as many rows as the rules have trigrams
        .groupBy("doc_id", "kind", "n", "needs").agg(F.size(F.collect_set("gram")).alias("has")).filter("has = needs")
        .groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))
    )
    return materialize(met), full


def _spans(kind: str, order: int, text: Column, pattern: str) -> Column:
    found = regex_spans(text, pattern)
    if kind == "assign":
        found = F.filter(found, lambda x: F.length(F.regexp_extract(x["m"], pattern, 2)) >= MIN_VALUE)
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind")))


def secret_spans(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """doc_id, spans (s, k, e, kind; by start, then rule) of each row of docs. Offsets in code points, end exclusive.

    Null text is empty. Repeated ids are searched in each of their rows. Rows with a null id are scanned with all rules.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    named, full = candidates(docs.filter("doc_id is not null"), rules)
    joined = docs.join(broadcast_if_small(named), "doc_id", "left")
    none = F.array().cast("array<struct<s:int,k:int,e:int,kind:string>>")
    columns = []
    for order, (kind, pattern) in enumerate(rules.items()):
        spans = _spans(kind, order, F.col("text"), pattern)
        if kind not in full:
            spans = F.when(F.col("doc_id").isNull() | F.array_contains("kinds", kind), spans).otherwise(none)
        columns.append(spans)
    return joined.select("doc_id", F.array_sort(F.concat(*columns)).alias("spans"))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row of docs; see secret_spans()."""
    found = secret_spans(docs)
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read(spark, sf_dir, "documents"))


QUERIES = {"op3_secrets": op3_secrets}
