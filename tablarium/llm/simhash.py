"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by multi-index hashing.

Fingerprints at Hamming distance 3 or less agree up to one bit in one of two halves. Each distinct
fingerprint therefore looks up, per half, its own value and the 32 values one bit away.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablarium.llm.common import map_arrow, materialize, read
from tablarium.llm.components import connected_components

HALF = 32


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """Bit k is set if it is set in over half of the shingles' hashes. No words: 0."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= size:
        hashes = [digest(joined, seed)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-size])).tolist()
        hashes = [digest(joined[s:e], seed) for s, e in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]
    bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):  # in blocks, so that a very long text needs little memory
        bits += np.unpackbits(np.array(hashes[k : k + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """key and fp (the fingerprint as a signed long) of each row. Null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), size) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], [key, "fp"])

    return map_arrow(docs.select(key, text), run, f"{key} long, fp long")


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column fp) at no more than distance 3, each at least once."""
    if not 0 <= distance <= 3:
        raise ValueError("two halves with one changed bit find distances up to 3")
    table, probes = [], []
    low = (1 << HALF) - 1
    for k in (0, 1):
        part = F.shiftrightunsigned("fp", HALF * k).bitwiseAND(F.lit(low))
        table.append(F.struct(F.lit(k).alias("k"), part.alias("v")))
        probes += [F.struct(F.lit(k).alias("k"), part.bitwiseXOR(F.lit(0 if b is None else 1 << b)).alias("v")) for b in (None, *range(HALF))]
    t = fps.select(F.col("fp").alias("b"), F.explode(F.array(*table)).alias("t")).select("b", "t.k", "t.v")
    p = fps.select(F.col("fp").alias("a"), F.explode(F.array(*probes)).alias("p")).select("a", "p.k", "p.v")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return p.join(t, ["k", "v"]).filter(near).select("a", "b")


def simhash_groups(docs: DataFrame, distance: int = 3, size: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links) of each row.

    Copies share a fingerprint and are linked through it, so only distinct fingerprints are compared.
    Rows without words have fingerprint zero and are linked like any other. A repeated doc_id with other text
    links the two; rows with a null doc_id get a component from the others' ids, or null.
    """
    marked = materialize(fingerprints(docs.select("doc_id", "text"), size=size))
    ids = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    # as many partitions as set, since each of the few rows becomes 66
    spread = ids.select("fp").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    near = materialize(links(spread, distance).distinct())
    of = connected_components(near.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    roots = ids.join(of, ids["fp"] == of["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    roots = roots.join(roots.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return marked.join(roots, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read(spark, sf_dir, "documents"))


QUERIES = {"op6_simhash": op6_simhash}
