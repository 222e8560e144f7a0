"""Importance resampling towards a target: hashed word runs of a raw and a target table give each document a weight.

Counts are kept by distinct line: newlines cut texts into lines, each distinct line's runs are counted once and multiplied by
its occurrences, and runs that reach over the end of a line are counted apart and added. Documents are then weighed by the
gains of their runs, and the best of weight plus Gumbel noise are drawn, which samples without replacement.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablarium.llm.common import discard, map_arrow, materialize, parts, read

#: A-Z become lower case, the rest of ASCII but digits and letters becomes a space.
_FOLD = bytes(b if b > 127 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def _words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _runs(words: list[bytes], max_n: int) -> list[bytes]:
    """All runs of 1 to max_n words."""
    return words + [b" ".join(words[i : i + n]) for n in range(2, max_n + 1) for i in range(len(words) - n + 1)]


def crossing_runs(lines: list[list[bytes]], max_n: int) -> list[bytes]:
    """Runs of 2 to max_n words that end in a later line than they begin in. lines: of one text, in order."""
    flat, line, edge = [], [], max_n - 1
    for k, words in enumerate(lines):
        # the middle of a long line is in no such run; the gap in `line` keeps its ends apart
        kept = words if len(words) <= 2 * edge else [*words[:edge], None, *words[-edge:]]
        flat += kept
        line += [k] * len(kept)
    found = []
    for n in range(2, max_n + 1):
        for i in range(len(flat) - n + 1):
            if line[i] != line[i + n - 1] and None not in flat[i : i + n]:
                found.append(b" ".join(flat[i : i + n]))
    return found


def _hashed(runs: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, runs), np.int64, len(runs)) % buckets


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the next sizes[k] values, for each k."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _lines(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct lines of some texts, the number of each line of the texts, and where each text's lines end."""
    split = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    coded = split.flatten().dictionary_encode()
    return [x.as_buffer().to_pybytes() for x in coded.dictionary.cast(pa.binary())], coded.indices.to_numpy(), split.offsets.to_numpy()[1:] - split.offsets[0].as_py()


def feature_counts(docs: DataFrame, max_n: int = 1, buckets: int = 10_000, text: str = "text") -> DataFrame:
    """bucket, n: how many runs of 1 to max_n words of all texts have a crc32 in each bucket (modulo buckets); none of 0.

    A line's runs are counted once for all its occurrences. Null and empty texts have no words; very long texts are cut into
    their lines like others; repeated rows count as often as they occur; other columns aren't read. No rows: no counts.
    """
    lines = docs.select(F.explode(F.split(text, "\n")).alias("line")).groupBy("line").agg(F.count("*").alias("times"))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            runs = [_runs(_words(x.as_buffer().to_pybytes()), max_n) for x in batch.column(0).cast(pa.binary())]
            times = np.repeat(batch.column(1).to_numpy(), np.fromiter(map(len, runs), np.int64, len(runs)))
            np.add.at(n, _hashed([r for rs in runs for r in rs], buckets), times)
        yield from _counted(n)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()):
                if t.is_valid:
                    np.add.at(n, _hashed(crossing_runs([_words(x) for x in t.as_buffer().to_pybytes().split(b"\n")], max_n), buckets), 1)
        yield from _counted(n)

    counts = map_arrow(lines, within, "bucket int, n long")
    if max_n > 1:
        counts = counts.unionByName(map_arrow(docs.select(text), across, "bucket int, n long"))
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def _counted(n: np.ndarray) -> Iterator[pa.RecordBatch]:
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], ["bucket", "n"])


def gains(raw: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """By bucket, 1000 times the logarithm of its smoothed share of the target's runs over that of the raw ones, floored.

    Both tables are of feature_counts(); one row a bucket reaches the driver.
    """
    both = raw.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full").na.fill(0)
    rows = both.select("bucket", "s", "t").collect()
    s, t = np.zeros(buckets), np.zeros(buckets)
    for b, n, m in rows:
        s[b], t[b] = n, m
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, max_n: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_features, weight (the floored mean gain of a text's runs; 0 without words) of each row.

    Lines that occur more than once in a batch are hashed once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e in parts(batch.column(1)):
                part = batch.slice(s, e - s)
                lines, at, ends = _lines(part.column(1))
                words = [_words(x) for x in lines]
                runs = [_runs(w, max_n) for w in words] if max_n > 1 else words
                sizes = np.fromiter(map(len, runs), np.int64, len(runs))
                of_line = _sums(gain[_hashed([r for rs in runs for r in rs], len(gain))], sizes)
                count = np.diff(ends, prepend=0)
                n_words = _sums(np.fromiter(map(len, words), np.int64, len(words))[at], count)
                n, total = _sums(sizes[at], count), _sums(of_line[at], count)
                if max_n > 1:
                    for k, (b, c) in enumerate(zip((ends - count).tolist(), ends.tolist(), strict=True)):
                        over = _hashed(crossing_runs([words[i] for i in at[b:c].tolist()], max_n), len(gain))
                        n[k] += len(over)
                        total[k] += gain[over].sum()
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words), pa.array(n), pa.array(weight)], [key, "n_words", "n_features", "weight"])

    return map_arrow(docs.select(key, text), run, f"{key} {dict(docs.dtypes)[key]}, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, *, percent: int = 10, max_n: int = 1, buckets: int = 10_000, min_words: int = 20, seed: int = 2024,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of docs (doc_id, text), drawn towards target (text).

    Of the N rows with at least min_words words the floor(percent * N / 100) with the highest scores have a rank from 1 on;
    ties go to the smaller doc_id, null ids last. Scores are weights plus noise by a hash of the id (a null id: of no digits).
    Repeated rows are drawn row by row. Null and empty texts have no features and weight 0; very long texts are read whole;
    other columns aren't read. An empty docs gives no rows; an empty target is smoothed like any other.
    """
    raw, wanted = materialize(feature_counts(docs, max_n, buckets)), feature_counts(target, max_n, buckets)
    gain = gains(raw, wanted, buckets)
    discard(raw)
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("long") + 0.5) / 4294967296.0
    noisy = weigh(docs, gain, max_n).withColumn("score", F.col("weight") + F.floor(-1000 * F.ln(-F.ln(u))))
    scored = materialize(noisy)
    # scores are whole and within some ten thousands, as gains and noise are, so this is a bounded number of rows
    counts = sorted(((r.score, r["count"]) for r in scored.filter(F.col("n_words") >= min_words).groupBy("score").count().collect()), reverse=True)
    draw, above, least = percent * sum(n for _, n in counts) // 100, 0, None
    for value, n in counts:
        if above >= draw:
            break
        least, above = value, above + n
    enough = (F.col("n_words") >= min_words) & (F.col("score") >= (least if least is not None else 0)) & F.lit(least is not None)
    ranked = _ranked(scored.filter(enough), F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    rest = scored.filter(~enough).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def _ranked(rows: DataFrame, *order) -> DataFrame:
    """rows with rank, from 1 on in that order: sorted ranges are numbered within, and the sizes of those before are added."""
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = materialize(ranges.withColumns({"_range": F.shiftright("_id", 33), "_k": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id"))
    before, sizes = 0, []
    for r in placed.groupBy("_range").count().orderBy("_range").collect():  # one row a partition
        sizes.append((r["_range"], before))
        before += r["count"]
    starts = rows.sparkSession.createDataFrame(sizes, "_range long, _before long")
    return placed.join(F.broadcast(starts), "_range").withColumn("rank", F.col("_before") + F.col("_k") + 1).drop("_range", "_k", "_before")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {"op11_resampling": op11_resampling}
