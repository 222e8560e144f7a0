"""Splits that hold their share over all strata, and even loads of annotators."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablarium.operators.rank import ordinal

#: Fields that few documents have.
RARE = ["kar_payi_orani", "tahsis_ucreti"]
#: Rows of a stratum and bucket that one window orders, about.
BUCKET_ROWS = 50_000


def stratum(tags: Column, fields: Column, rare: list[str] = RARE) -> Column:
    """Sorted hard tags and rare fields of a record, as text."""
    part = lambda a, none: F.when(F.size(a) > 0, F.array_join(F.array_sort(F.array_distinct(a)), "+")).otherwise(none)
    empty = F.array().cast("array<string>")
    few = F.array_intersect(F.coalesce(fields, empty), F.array(*map(F.lit, rare)))
    return F.concat(part(F.coalesce(tags, empty), "easy"), F.lit(" | "), part(few, "common"))


def apportion(counts: dict[str, int], share: float) -> dict[str, int]:
    """How many rows of each stratum are test: its rounded share, one at least on either side where there are two rows.

    What rounding adds up to is then taken from, or given by, the strata with most rows on that side, one row at a time, as long
    as a stratum keeps a row there.
    """
    test = {k: max(1, min(n - 1, round(n * share))) if n >= 2 else round(n * share) for k, n in counts.items()}
    drift = sum(test.values()) - round(sum(counts.values()) * share)
    side = (lambda k: test[k]) if drift > 0 else (lambda k: counts[k] - test[k])
    heap = [(-side(k), k) for k in counts if side(k) >= 2]
    heapq.heapify(heap)
    for _ in range(abs(drift)):
        if not heap:
            break  # no stratum can give a row
        _, k = heapq.heappop(heap)
        test[k] -= 1 if drift > 0 else -1
        if side(k) >= 2:
            heapq.heappush(heap, (-side(k), k))
    return test


def stratified_split(rows: DataFrame, by: Sequence[str], key: str, share: float = 0.6, seed: int = 42) -> DataFrame:
    """Rows with split dev or test, test being `share` of all rows and, as far as whole rows allow, of each stratum.

    The counts of the strata, which the driver plans with, decide how many; a hash of the key decides which, and copies of a key
    are ordered among themselves in any way. A stratum is ordered in buckets, so that a large one isn't one task's.
    """
    if not 0 < share < 1:
        raise ValueError("0 < share < 1")
    name = F.to_json(F.struct(*by)) if len(by) > 1 else F.coalesce(F.col(by[0]).cast("string"), F.lit(""))
    hashed = rows.withColumns({"_stratum": name, "_order": F.xxhash64(F.lit(seed), key)})
    counts = {r["_stratum"]: r["count"] for r in hashed.groupBy("_stratum").count().collect()}  # a row a stratum
    plan = rows.sparkSession.createDataFrame([(k, n) for k, n in apportion(counts, share).items()], "_stratum string, _test long")
    buckets = 1 + max(counts.values(), default=0) // BUCKET_ROWS
    dealt = hashed.withColumn("_bucket", F.pmod(F.shiftright("_order", 3), F.lit(buckets)))
    sizes = dealt.groupBy("_stratum", "_bucket").count()
    before = sizes.select("_stratum", "_bucket", (F.sum("count").over(Window.partitionBy("_stratum").orderBy("_bucket")) - F.col("count")).alias("_before"))
    n = F.row_number().over(Window.partitionBy("_stratum", "_bucket").orderBy("_order", key))
    placed = dealt.withColumn("_n", n).join(before, ["_stratum", "_bucket"]).join(F.broadcast(plan), "_stratum")
    return placed.select(*rows.columns, F.when(F.col("_n") + F.col("_before") <= F.col("_test"), "test").otherwise("dev").alias("split"))


def shares(docs: DataFrame, calibration: int, duplicate: int, seed: int = 42) -> DataFrame:
    """doc_id, part: `calibration` documents, then `duplicate` others, picked by a hash of the id, and the rest as main."""
    order = [F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id")]
    first = docs.select("doc_id").orderBy(*order).limit(calibration + duplicate)
    place = F.row_number().over(Window.orderBy(*order))  # as many rows as are asked for
    picked = first.select("doc_id", F.when(place <= calibration, "calibration").otherwise("duplicate").alias("part"))
    return docs.select("doc_id").join(picked, "doc_id", "left").select("doc_id", F.coalesce("part", F.lit("main")).alias("part"))


def loads(counts: dict[int, int], fixed: Sequence[int]) -> list[tuple[int, int, int, list[int]]]:
    """The largest documents first, each to whom has least: (size, first rank, end, turns) of the documents of a size in order.

    Among documents of one size s, annotators take turns in the order of load modulo s, each from the round on in which the
    others have reached that load. So a size takes a few steps, however many documents have it.
    """
    total, out = list(fixed), []
    for size in sorted((s for s in counts if s > 0), reverse=True):
        left, at, level = counts[size], 0, min(t // size for t in total)
        turns_of = lambda q: sorted((i for i in range(len(total)) if total[i] // size <= q), key=lambda i: (total[i] % size, i))  # noqa: B023, E731
        taken = [0] * len(total)
        while left:
            turns = turns_of(level)
            later = [t // size for t in total if t // size > level]
            rounds = min(later) - level if later else -(-left // len(turns))
            n = min(left, rounds * len(turns))
            out.append((size, at, at + n, turns))
            for k, i in enumerate(turns):
                taken[i] += n // len(turns) + (k < n % len(turns))
            at, left, level = at + n, left - n, level + rounds
        total = [t + size * k for t, k in zip(total, taken, strict=True)]
    if counts.get(0):  # they add nothing, so all go to whom has least
        out.append((0, 0, counts[0], [min(range(len(total)), key=lambda i: (total[i], i))]))
    return out


def balanced(docs: DataFrame, annotators: Sequence[str], fixed: Sequence[int] | None = None) -> DataFrame:
    """doc_id, annotator of docs (doc_id, a number; rows): longest processing time first, ties to the smaller doc_id and the earlier name.

    fixed: what each annotator has already. The plan depends on how many documents have each number of rows, which is what
    reaches the driver; a document finds its annotator by its rank among those of its size.
    """
    sized = docs.select("doc_id", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))
    counts = {r["rows"]: r["count"] for r in sized.groupBy("rows").count().collect()}
    plan = loads(counts, list(fixed or [0] * len(annotators)))
    steps = docs.sparkSession.createDataFrame([(s, lo, hi, [annotators[i] for i in turns]) for s, lo, hi, turns in plan], "rows long, lo long, hi long, turns array<string>")
    ranked = ordinal(sized, ["rows"], "doc_id").select("rows", "doc_id", F.col("before").alias("at"))
    met = ranked.join(F.broadcast(steps), "rows").filter("at >= lo and at < hi")  # a few rows a size
    return met.select("doc_id", F.get("turns", ((F.col("at") - F.col("lo")) % F.size("turns")).cast("int")).alias("annotator"))
