"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablarium.llm.common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours (large: the larger ones; else the smaller ones and itself) to the smallest of them and itself."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if large else edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    out = both.join(least, "src")
    if large:
        out = out.filter("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    else:
        out = out.select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(least.select("src", F.col("m").alias("dst")))
    return out.filter("src <> dst").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of each node of edges (src, dst; long).

    Self-links, repeated and reversed edges are fine; rows with a null end are left out. A node has a row if
    an edge to another node has it. Each round is written to the shared folder.
    """
    now = materialize(edges.dropna().filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    mark = None
    while True:
        before, now = now, materialize(_star(_star(now, large=True), large=False))
        discard(before)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if state == mark:
            return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
        mark = state
