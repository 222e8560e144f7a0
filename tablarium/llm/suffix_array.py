"""Distributed suffix arrays by the difference cover {1, 2} modulo 3, and repeated byte strings by adjacent prefixes.

Of each text the suffixes at places that 3 doesn't divide are sampled. Their triples are sorted and named; where names repeat,
the texts of names are sorted the same way, one level deeper. The remaining suffixes are merged by their first one or two
symbols and the rank that the sample gives to what follows. Every text ends in a symbol of its own, so texts needn't be joined
into one, and no comparison leaves its text. All sorts are range partitions that are numbered in order.

op5_substrings doesn't use this: README.md has the figures of an attempt.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablarium.llm.common import broadcast_if_small, discard, map_arrow, materialize
from tablarium.llm.repeats import gram_hashes, joined

#: Places of one text that a window orders.
BLOCK = 4096
#: Levels below the first one. Names of level k cover 3 ** k symbols.
DEEPEST = 40


def numbered(rows: DataFrame, order: list[Column | str], flag: Column | None = None) -> DataFrame:
    """rows, written, with n, their place in order from 0 on, and, with a flag, f: how many flagged rows come before each."""
    mark = (F.lit(0) if flag is None else flag.cast("int")).alias("_mark")
    placed = rows.select("*", mark).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = materialize(placed.withColumns({"_range": F.shiftright("_id", 33), "_k": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id"))
    sizes, rows_before, marks_before = [], 0, 0
    for r in placed.groupBy("_range").agg(F.count("*").alias("n"), F.sum("_mark").alias("m")).orderBy("_range").collect():  # a row a partition
        sizes.append((r["_range"], rows_before, marks_before))
        rows_before, marks_before = rows_before + r["n"], marks_before + r["m"]
    starts = rows.sparkSession.createDataFrame(sizes, "_range long, _rows long, _marks long")
    out = placed.join(F.broadcast(starts), "_range").withColumn("n", F.col("_rows") + F.col("_k"))
    if flag is not None:
        out = out.withColumn("f", F.col("_marks") + F.sum("_mark").over(Window.partitionBy("_range").orderBy("_k")) - F.col("_mark"))
    return out.drop("_range", "_rows", "_marks", "_k", "_mark")


def _with_next(s: DataFrame, *names: str) -> DataFrame:
    """s (row, pos, names) with each name of the next place and the one after it, name1 and name2; null beyond the end. Windows are blocks of a text."""
    block = F.floor(F.col("pos") / BLOCK)
    also = F.when((F.col("pos") >= BLOCK) & (F.col("pos") % BLOCK < 2), F.array(block, block - 1)).otherwise(F.array(block))
    at = Window.partitionBy("row", "_block").orderBy("pos")
    dealt = s.withColumn("_block", F.explode(also))
    return dealt.withColumns({f"{x}{k}": F.lead(x, k).over(at) for x in names for k in (1, 2)}).filter(F.col("_block") == block).drop("_block")


def suffix_ranks(s: DataFrame, deepest: int = DEEPEST, level: int = 0, told: list[dict] | None = None) -> DataFrame:
    """row, pos, r (from 0 on): the order of all suffixes of texts (row, pos from 0 on, c a positive number).

    The last symbol of each text must occur nowhere else. Below `deepest` levels, suffixes whose names are equal, which agree in
    3 ** (deepest + 1) symbols, are ordered by place. told gets the figures of each level.
    """
    s = materialize(s)
    next_ = _with_next(s, "c")
    sample = materialize(next_.filter("pos % 3 <> 0").select("row", "pos", "c", F.coalesce("c1", F.lit(0)).alias("c1"), F.coalesce("c2", F.lit(0)).alias("c2")))
    triples = ["c", "c1", "c2"]
    names = materialize(numbered(sample.groupBy(*triples).agg(F.count("*").alias("times")), triples))
    kinds, size = names.count(), sample.count()
    if told is not None:
        told.append({"level": level, "places": s.count(), "sample": size, "names": kinds})
    named = sample.join(broadcast_if_small(names.select(*triples, "n")), triples).select("row", "pos", "n")
    if kinds == size:
        ranks = named.withColumnRenamed("n", "r")
    elif level >= deepest:
        ranks = numbered(named.withColumnRenamed("n", "name"), ["name", "row", "pos"]).select("row", "pos", F.col("n").alias("r"))
    else:
        inner = named.select((F.col("row") * 2 + F.col("pos") % 3 - 1).alias("row"), F.floor(F.col("pos") / 3).alias("pos"), (F.col("n") + 1).alias("c"))
        deeper = suffix_ranks(inner, deepest, level + 1, told)
        ranks = deeper.select(F.floor(F.col("row") / 2).alias("row"), (F.col("pos") * 3 + 1 + F.col("row") % 2).alias("pos"), "r")
    ranks = materialize(ranks)
    discard(sample, names)
    # merge: what follows a remaining suffix, and what follows that, is in the sample
    every = _with_next(s.join(ranks, ["row", "pos"], "left"), "c", "r").select("row", "pos", "c", "r", F.coalesce("c1", F.lit(0)).alias("c1"), F.coalesce("r1", F.lit(-1)).alias("r1"), F.coalesce("r2", F.lit(-1)).alias("r2"))
    every = materialize(every.withColumn("kind", (F.col("pos") % 3).cast("int")))
    one = numbered(every.filter("kind < 2").select("row", "pos", "kind", "r", "c", "r1"), ["c", "r1"], F.col("kind") == 1)
    two = numbered(every.filter("kind <> 1").select("row", "pos", "kind", "r", "c", "c1", "r2"), ["c", "c1", "r2"], F.col("kind") == 2)
    rest = one.filter("kind = 0").select("row", "pos", "n").join(two.filter("kind = 0").select("row", "pos", "f"), ["row", "pos"]).select("row", "pos", (F.col("n") + F.col("f")).alias("r"))
    sampled = [t.filter("kind <> 0").select("row", "pos", (F.col("r") + F.col("n") - F.col("f")).alias("r")) for t in (one, two)]
    out = materialize(rest.unionByName(sampled[0]).unionByName(sampled[1]))
    discard(s, ranks, every)
    return out


def byte_symbols(texts: DataFrame) -> DataFrame:
    """row, pos, c of the bytes of texts (row, text; rows from 0 on): 1 to 256, then one symbol of the row's own. Null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                c = np.append(np.frombuffer((t.as_py() or "").encode(), np.uint8).astype(np.int64) + 1, row + 257)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), row)), pa.array(np.arange(len(c))), pa.array(c)], ["row", "pos", "c"])

    return map_arrow(texts.select("row", "text"), run, "row long, pos long, c long")


def window_hashes(texts: DataFrame, length: int) -> DataFrame:
    """row, pos, w: a hash of the `length` bytes at each place that has so many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                w = gram_hashes(np.frombuffer((t.as_py() or "").encode(), np.uint8).astype(np.uint64), length)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), row)), pa.array(np.arange(len(w))), pa.array(w.view(np.int64))], ["row", "pos", "w"])

    return map_arrow(texts.select("row", "text"), run, "row long, pos long, w long")


def repeated_places(texts: DataFrame, length: int = 100, told: list[dict] | None = None) -> DataFrame:
    """row, pos of each string of `length` bytes that also starts earlier (a smaller row, or earlier in it).

    Neighbours in the suffix array that agree in so many bytes form runs; the first place of a run stays. The order needs to be
    right for that many bytes only, which bounds the levels.
    """
    levels = 0
    while 3 ** (levels + 1) < length:
        levels += 1
    ranks = suffix_ranks(byte_symbols(texts), levels, told=told)
    order = numbered(ranks.join(window_hashes(texts, length), ["row", "pos"]), ["r"])
    at = Window.partitionBy("_part").orderBy("n")
    part = F.floor(F.col("n") / (1 << 20))
    # each part holds the last row of the one before, so that neighbours meet
    dealt = order.withColumn("_part", F.explode(F.when(F.col("n") % (1 << 20) == (1 << 20) - 1, F.array(part, part + 1)).otherwise(F.array(part))))
    new = dealt.withColumn("new", F.coalesce(F.lag("w").over(at) != F.col("w"), F.lit(True))).filter(F.col("_part") == part).select("row", "pos", "n", "new")
    runs = numbered(new, ["n"], F.col("new")).withColumn("run", F.col("f") + F.col("new").cast("int"))
    first = runs.groupBy("run").agg(F.min(F.struct("row", "pos")).alias("first"), F.count("*").alias("times")).filter("times > 1")
    return runs.join(first, "run").filter(F.struct("row", "pos") != F.col("first")).select("row", "pos")


@dataclass(frozen=True)
class SuffixRepeats:
    """Repeated strings of `length` bytes, for repeats.remove()."""

    length: int

    def covered(self, docs: DataFrame) -> DataFrame:
        """doc_id and cover: sorted [s, e) of bytes in strings that start earlier too (smaller doc_id, or earlier there).

        docs: doc_id (unique, not null) and text. Documents without cover have no row.
        """
        texts = materialize(numbered(docs.select("doc_id", "text"), ["doc_id"]).withColumnRenamed("n", "row"))
        places = repeated_places(texts, self.length).join(texts.select("row", "doc_id"), "row")
        spans = places.select("doc_id", F.struct(F.col("pos").cast("int").alias("s"), (F.col("pos") + self.length).cast("int").alias("e")).alias("x"))
        return materialize(joined(spans.groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("cover"))))
