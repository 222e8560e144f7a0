"""Exact repeats: which windows of consecutive tokens also start earlier in the corpus.

Each window picks the K-gram in it with the smallest hash (leftmost of equals) of those that may repeat. Equal
windows pick the same K-gram at the same place. Which K-grams may repeat is told by the picks that occur more than
once, or by an index of fixed blocks (anchors.py). Consecutive windows with one pick form a stretch. Stretches that are equal as a whole are settled by one aggregation; what is
left (picks whose stretches differ, at the edges of repeats) is settled window by window. Nothing is
capped: a pick that a third of all documents share only meets aggregations with map-side combine and
joins against one row per key, which Spark splits when they are skewed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablarium.llm.common import BROADCAST_ROWS, discard, map_arrow, materialize

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_POS = np.uint64((1 << 31) - 1)
_NONE = np.uint64((1 << 64) - 1)
STRETCHES = "h long, s long, doc_id long, lo int, n int"
#: Most kinds of stretches of one pick that one task compares.
FEW_KINDS = 20_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _A
    x ^= x >> np.uint64(32)
    return x


def gram_hashes(tokens: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive tokens (uint64), from hashes of 1, 2, 4, ... tokens."""
    if len(tokens) < k:
        return np.empty(0, np.uint64)
    part, size, out, done = _mix(tokens + _C), 1, None, 0
    while True:
        if k & 1:
            out = part if out is None else _mix(out[: len(part) - done] * _B + part[done:])
            done += size
        k >>= 1
        if not k:
            return out
        part = _mix(part[:-size] * _B + part[size:])
        size *= 2


def window_minimum(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


@dataclass(frozen=True)
class Repeats:
    """window: tokens that must repeat. gram: tokens of a pick. tokens: text (str or None) to uint64 tokens; of_bytes: all below 256."""

    window: int
    gram: int
    tokens: Callable[[str | None], np.ndarray]
    of_bytes: bool = False

    def stretches(self, tokens: np.ndarray, may: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """The pick's hash, the first window and the number of windows of each stretch; may: which grams can be picked (all)."""
        if len(tokens) < self.window or (may is not None and not may.any()):
            return None
        grams = gram_hashes(tokens, self.gram)
        order = (grams & ~_POS) | np.arange(len(grams), dtype=np.uint64)  # by hash, then by place
        if may is not None:
            order[~may] = _NONE
        best = window_minimum(order, self.window - self.gram + 1)
        at = (best & _POS).astype(np.int64)
        lo = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        n = np.diff(np.append(lo, len(at)))
        some = best[lo] != _NONE
        return grams[at[lo[some]]], lo[some], n[some]

    def identities(self, tokens: np.ndarray, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A hash of each stretch's windows and their number."""
        whole = gram_hashes(tokens, self.window)
        ends = (lo + n - 1).astype(np.int64)
        # a stretch has at most window - gram + 1 windows, so its first and last one hold all its tokens
        return _mix(whole[lo] * _B + whole[ends] + n.astype(np.uint64) * _C)

    def picks(self, docs: DataFrame) -> DataFrame:
        """h and c: each pick and how often it was seen in a batch."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [s[0] for t in batch.column(1) if (s := self.stretches(self.tokens(t.as_py()))) is not None]
                if found:
                    h, c = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

        return map_arrow(docs, run, "h long, c long")

    def stretch_rows(self, texts: Iterable[tuple[int, np.ndarray, np.ndarray | None]]) -> Iterator[pa.RecordBatch]:
        """h, s (identity), doc_id, lo, n of every stretch of texts (doc_id, tokens, may)."""
        rows = []
        for d, tokens, may in texts:
            if (found := self.stretches(tokens, may)) is not None:
                h, lo, n = found
                rows.append((h, self.identities(tokens, lo, n), np.full(len(h), d), lo, n))
        if rows:
            h, s, d, lo, n = map(np.concatenate, zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(s.view(np.int64)), pa.array(d), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32))], ["h", "s", "doc_id", "lo", "n"])

    def all_stretches(self, docs: DataFrame) -> DataFrame:
        """h, s, doc_id, lo, n of every stretch of docs (doc_id, text)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from self.stretch_rows((d, self.tokens(t.as_py()), None) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))

        return map_arrow(docs, run, STRETCHES)

    def windows(self, docs: DataFrame) -> DataFrame:
        """h, w (hash), doc_id, lo of each window in the stretches of docs (doc_id, text, parts of structs lo, n, h)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for d, t, parts in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("parts"), strict=True):
                    part = parts.values.flatten()
                    lo, n, h = (x.to_numpy(zero_copy_only=False) for x in part)
                    whole = gram_hashes(self.tokens(t.as_py()), self.window)
                    at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(h, n)), pa.array(whole[at].view(np.int64)), pa.array(np.full(len(at), d)), pa.array(at.astype(np.int32))], ["h", "w", "doc_id", "lo"])

        return map_arrow(docs.select("doc_id", "text", "parts"), run, "h long, w long, doc_id long, lo int")

    def surroundings(self, docs: DataFrame) -> DataFrame:
        """h, doc_id, lo, n, ctx of each stretch of docs (as for windows()): its bytes, or for other tokens its windows' hashes."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for d, t, parts in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("parts"), strict=True):
                    lo, n, h = (x.to_numpy(zero_copy_only=False) for x in parts.values.flatten())
                    tokens = self.tokens(t.as_py())
                    if self.of_bytes:
                        raw = tokens.astype(np.uint8).tobytes()
                        ctx = [raw[s : s + k + self.window - 1] for s, k in zip(lo.tolist(), n.tolist(), strict=True)]
                    else:
                        raw = gram_hashes(tokens, self.window).tobytes()
                        ctx = [raw[8 * s : 8 * (s + k)] for s, k in zip(lo.tolist(), n.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(lo), d)), pa.array(lo), pa.array(n), pa.array(ctx, pa.binary())], ["h", "doc_id", "lo", "n", "ctx"])

        return map_arrow(docs.select("doc_id", "text", "parts"), run, "h long, doc_id long, lo int, n int, ctx binary")

    def resolve(self, rows: DataFrame) -> DataFrame:
        """doc_id, lo, n: runs of windows that an earlier row has too. rows: surroundings() in partitions sorted by h, doc_id, lo, no h in two.

        One batch and the window hashes of one h are in memory.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, seen = None, np.empty(0, np.uint64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                h, doc, lo, n = (batch.column(k).to_numpy() for k in range(4))
                sizes = n + (self.window - 1) * self.of_bytes
                raw = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8 if self.of_bytes else "<u8")
                whole = gram_hashes(raw.astype(np.uint64), self.window) if self.of_bytes else raw
                row = np.repeat(np.arange(len(h)), n)
                at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                w = whole[np.repeat(np.cumsum(sizes) - sizes, n) + at]
                order = np.lexsort((w, h[row]))  # stable, so that equal ones stay in order
                same = (w[order][1:] == w[order][:-1]) & (h[row][order][1:] == h[row][order][:-1])
                again = np.zeros(len(w), bool)
                again[order[1:][same]] = True
                if h[0] == last:
                    head = h[row] == last
                    again[head] |= np.isin(w[head], seen)
                tail = w[h[row] == h[-1]]
                seen, last = np.unique(np.concatenate((seen, tail)) if h[-1] == last else tail), h[-1]
                hit = np.flatnonzero(again)
                if len(hit):
                    begin = np.flatnonzero(np.concatenate(([True], (np.diff(hit) != 1) | (np.diff(row[hit]) != 0))))
                    r, first = row[hit[begin]], at[hit[begin]]
                    yield pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array((lo[r] + first).astype(np.int32)), pa.array(np.diff(np.append(begin, len(hit))).astype(np.int32))], ["doc_id", "lo", "n"])

        return map_arrow(rows, run, "doc_id long, lo int, n int")

    def candidates(self, docs: DataFrame) -> DataFrame:
        """Stretches whose pick occurs more than once."""
        # written, so that both sides of the join are plain shuffles, which Spark splits where a pick is common
        repeated = materialize(self.picks(docs).groupBy("h").agg(F.sum("c").alias("c")).filter("c > 1").select("h"))
        return self.all_stretches(docs).join(repeated, "h", "left_semi")

    def covered(self, docs: DataFrame) -> DataFrame:
        """doc_id and cover: sorted [s, e) of tokens in windows that start earlier too (smaller doc_id, or earlier there).

        docs: doc_id (unique, not null) and text. Documents without cover have no row.
        """
        stretches = materialize(self.candidates(docs))
        kinds = materialize(stretches.groupBy("h", "s").agg(F.min(F.struct("doc_id", "lo")).alias("first"), F.max("n").alias("n"), F.count("*").alias("c")))
        repeated = materialize(kinds.filter("c > 1").select("h", "s", "first"))
        again = stretches.join(repeated, ["h", "s"]).filter(F.struct("doc_id", "lo") != F.col("first")).select("doc_id", "lo", "n")

        several = materialize(kinds.groupBy("h").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
        part = F.struct(F.col("first.lo").alias("lo"), "n", "h")

        def open_kinds(picked: DataFrame) -> DataFrame:
            by_doc = kinds.join(picked.select("h"), "h", "left_semi").groupBy("first.doc_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
            return docs.join(sized(materialize(by_doc), "parts"), "doc_id")

        # picks of few kinds: all windows of one in one task, in order
        packed = self.surroundings(open_kinds(several.filter(F.col("kinds") <= FEW_KINDS)))
        single = self.resolve(packed.repartition("h").sortWithinPartitions("h", "doc_id", "lo"))
        if several.filter(F.col("kinds") > FEW_KINDS).limit(1).count():  # others: by window
            windows = materialize(self.windows(open_kinds(several.filter(F.col("kinds") > FEW_KINDS))))
            first = materialize(windows.groupBy("h", "w").agg(F.min(F.struct("doc_id", "lo")).alias("first"), F.count("*").alias("c")).filter("c > 1").select("h", "w", "first"))
            single = single.unionByName(windows.join(first, ["h", "w"]).filter(F.struct("doc_id", "lo") != F.col("first")).select("doc_id", "lo", F.lit(1).alias("n")))

        found = again.unionByName(single).select("doc_id", F.struct(F.col("lo").alias("s"), (F.col("lo") + F.col("n") - 1 + self.window).alias("e")).alias("x"))
        cover = materialize(joined(found.groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("cover"))))
        discard(stretches, kinds, repeated, several)
        return cover


def joined(covers: DataFrame) -> DataFrame:
    """doc_id, cover with overlapping or touching [s, e) of each sorted array made one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans in batch.column(1):
                s, e = (x.to_numpy() for x in spans.values.flatten())
                e = np.maximum.accumulate(e)
                first = np.concatenate(([True], s[1:] > e[:-1]))
                out.append([{"s": a, "e": b} for a, b in zip(s[first].tolist(), e[np.append(first[1:], True)].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))], ["doc_id", "cover"])

    return map_arrow(covers, run, "doc_id long, cover array<struct<s:int,e:int>>")


def sized(df: DataFrame, column: str, most: int = 4 * BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a written df if its arrays hold at most `most` items in all; else df, for a shuffled join."""
    return F.broadcast(df) if (df.agg(F.sum(F.size(column) + 1)).first()[0] or 0) <= most else df


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text and row: a unique number in the order of doc_id, null ids last, rows of one id by their text.

    Where all ids are unique they are the numbers. Else rows are sorted and written.
    """
    docs = docs.select("doc_id", "text")
    if docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        return docs.withColumn("row", F.col("doc_id"))
    # rows that are alike are told apart by where they lie, so that they don't fall to one task
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), "text", "at"]
    return materialize(docs.withColumn("at", F.monotonically_increasing_id()).orderBy(*order).select("doc_id", "text", F.monotonically_increasing_id().alias("row")))


def remove(docs: DataFrame, repeats, finish: Callable[[str | None, list[tuple[int, int]]], tuple], names: list[str], types: list[pa.DataType], ddl: str) -> DataFrame:
    """doc_id and what finish(text, cover) gives, for each row of docs; see in_order() for null and repeated ids. repeats has covered()."""
    ordered = in_order(docs)
    cover = repeats.covered(ordered.select(F.col("row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [finish(t.as_py(), [(x["s"], x["e"]) for x in c or ()]) for t, c in zip(batch.column("text"), batch.column("cover").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), types, strict=True))], ["doc_id", *names]) if rows else batch.slice(0, 0)

    return map_arrow(ordered.join(sized(cover, "cover"), "row", "left").select("doc_id", "text", "cover"), run, ddl)
