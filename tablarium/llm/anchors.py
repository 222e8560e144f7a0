"""Fixed-block anchors: an index of non-overlapping blocks of all texts, probed with every rolling window of a block's length.

A window of 2 B tokens holds, wherever it stands, one whole block of B tokens of its own text's blocks. So a window that
occurs twice has, in both places, a gram that the index knows and that two probes or more meet. Texts are written in
slices; blocks and probes are dealt into buckets by their hash, where a slice's probes are one row, with 32 bits of hash
each, and a bucket answers with one bit for each. What is hit is extended to maximal repeats by repeats.py, which compares
the windows around hits, so that equal bits of different grams do no harm.

Grams that many texts of a sample have are known to repeat and aren't asked for, so that no bucket holds a third of all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablarium.llm.common import map_arrow, materialize, parts
from tablarium.llm.repeats import STRETCHES, Repeats, gram_hashes

#: Bytes of text whose probes one bucket holds, and of a slice, about.
BUCKET_BYTES, SLICE_BYTES = 24 << 20, 2 << 20
#: Texts of the sample, about; grams that one in SHARE of them has, and at least LEAST, aren't asked for.
SAMPLE, SHARE, LEAST = 5_000, 200, 20
_HALF = np.uint64(32)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary array of consecutive parts of values; sizes in items."""
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


@dataclass(frozen=True)
class AnchoredRepeats(Repeats):
    """Repeats whose candidates come from fixed blocks of `gram` tokens; window must be twice the gram or more, less one."""

    def common(self, docs: DataFrame) -> np.ndarray:
        """Sorted hashes of grams that many texts of a sample have; at most its grams / LEAST."""
        share = min(1_000_000, 1_000_000 * SAMPLE // max(1, docs.count()) + 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for t in batch.column(0):
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(gram_hashes(self.tokens(t.as_py()), self.gram)).view(np.int64))], ["h"])

        sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share).select("text")
        n = sample.count()
        rows = map_arrow(sample, run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= max(LEAST, n / SHARE)).collect()
        return np.sort(np.array([r["h"] for r in rows], np.int64).view(np.uint64))

    def slices(self, docs: DataFrame) -> DataFrame:
        """slice, ids, texts: documents in written slices, so that a slice's probes have the same order whenever they are made."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = TaskContext.get().partitionId() << 32
            for batch in batches:
                for s, e in parts(batch.column(1), SLICE_BYTES):
                    part, ends = batch.slice(s, e - s), pa.array([0, e - s], pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.ListArray.from_arrays(ends, part.column(0)), pa.ListArray.from_arrays(ends, part.column(1))], ["slice", "ids", "texts"])
                    n += 1

        return materialize(map_arrow(docs.select("doc_id", "text"), run, "slice long, ids array<long>, texts array<string>"))

    def _grams(self, texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Tokens of each text, hashes of all grams, and how many each text has."""
        tokens = [self.tokens(t.as_py()) for t in texts]
        grams = [gram_hashes(t, self.gram) for t in tokens]
        return tokens, np.concatenate(grams), np.fromiter(map(len, grams), np.int64, len(grams))

    def entries(self, slices: DataFrame, buckets: int, common: np.ndarray) -> DataFrame:
        """bucket, slice, v: the probes of a slice by bucket, in order; without slice: blocks."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    _, h, sizes = self._grams(batch.column(2)[k].values)
                    block = (np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) % self.gram == 0
                    asked = ~_among(h, common)
                    h, block = h[asked], block[asked]
                    for x, of in ((h, batch.column(0)[k].as_py()), (h[block], None)):
                        bucket = (x % np.uint64(buckets)).astype(np.int64)
                        groups, n = np.unique(bucket, return_counts=True)
                        if len(groups):
                            v = (x >> _HALF).astype(np.uint32)[np.argsort(bucket, kind="stable")]
                            yield pa.RecordBatch.from_arrays([pa.array(groups), pa.array([of] * len(groups), pa.int64()), _lists(v, n)], ["bucket", "slice", "v"])

        return map_arrow(slices, run, "bucket long, slice long, v binary")

    def answers(self, entries: DataFrame, buckets: int) -> DataFrame:
        """slice, bucket, mask: a bit for each probe of rows with a hit: it meets a block, and so does another probe."""

        def finish(bucket: int, keys: list[np.ndarray], lists: list[pa.Array], blocks: list[pa.Array]) -> Iterator[pa.RecordBatch]:
            if not keys or not blocks:
                return
            key = np.concatenate(keys)
            v, n = _flat(pa.concat_arrays(lists))
            distinct, at, count = np.unique(v, return_inverse=True, return_counts=True)
            hit = ((count > 1) & np.isin(distinct, _flat(pa.concat_arrays(blocks))[0]))[at]
            width = (n + 7) // 8
            bits = np.zeros(8 * int(width.sum()), bool)
            bits[np.repeat(8 * (np.cumsum(width) - width) - (np.cumsum(n) - n), n) + np.arange(len(v))] = hit
            masks, some = _lists(np.packbits(bits), width), np.add.reduceat(hit, np.cumsum(n) - n) > 0
            yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(np.full(int(some.sum()), bucket)), masks.filter(pa.array(some))], ["slice", "bucket", "mask"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, keys, lists, blocks = None, [], [], []
            for batch in batches:
                bucket = batch.column(0).to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
                for s, e in zip(edges, edges[1:]):
                    if s == e:
                        continue
                    if bucket[s] != now:
                        if now is not None:
                            yield from finish(now, keys, lists, blocks)
                        now, keys, lists, blocks = bucket[s], [], [], []
                    part = batch.slice(s, e - s)
                    index, probes = part.filter(part.column(1).is_null()), part.filter(part.column(1).is_valid())
                    if index.num_rows:
                        blocks.append(index.column(2))
                    if probes.num_rows:
                        keys.append(probes.column(1).to_numpy())
                        lists.append(probes.column(2))
            if now is not None:
                yield from finish(now, keys, lists, blocks)

        return map_arrow(entries.repartition(buckets, "bucket").sortWithinPartitions("bucket"), run, "slice long, bucket long, mask binary")

    def candidates(self, docs: DataFrame) -> DataFrame:
        """Stretches of the windows that hold a gram which the index of blocks has and two probes meet."""
        buckets = 8 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES
        common, slices = self.common(docs), self.slices(docs)
        found = self.answers(self.entries(slices, buckets, common), buckets)
        marks = found.groupBy("slice").agg(F.collect_list(F.struct("bucket", "mask")).alias("marks"))  # a row for each bucket

        def may(h: np.ndarray, marks: pa.Array | None) -> np.ndarray:
            out = _among(h, common)
            if marks is None:
                return out
            asked = np.flatnonzero(~out)
            bucket = (h[asked] % np.uint64(buckets)).astype(np.int64)
            order, count = np.argsort(bucket, kind="stable"), np.bincount(bucket, minlength=buckets)
            at, masks = marks.flatten()
            b, bits = at.to_numpy(), np.unpackbits(np.frombuffer(b"".join(masks.to_pylist()), np.uint8))
            n, width = count[b], 8 * ((count[b] + 7) // 8)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            places = order[np.repeat((np.cumsum(count) - count)[b], n) + within]
            out[asked[places]] = bits[np.repeat(np.cumsum(width) - width, n) + within] > 0
            return out

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    tokens, h, sizes = self._grams(batch.column(1)[k].values)
                    flags = may(h, batch.column(2)[k].values)
                    yield from self.stretch_rows(zip(batch.column(0)[k].values.to_pylist(), tokens, np.split(flags, np.cumsum(sizes)[:-1]), strict=True))

        return map_arrow(slices.join(marks, "slice", "left").select("ids", "texts", "marks"), run, STRETCHES)


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.searchsorted(known, h).clip(max=len(known) - 1)] == h


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit numbers of a binary array, and how many each item holds."""
    edges = np.frombuffer(lists.buffers()[1], np.int32, len(lists) + 1, 4 * lists.offset)
    return np.frombuffer(lists.buffers()[2], np.uint8)[edges[0] : edges[-1]].view(np.uint32), np.diff(edges).astype(np.int64) // 4
