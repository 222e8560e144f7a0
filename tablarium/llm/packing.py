"""Best-fit packing by minimum bin slack over the histogram of piece lengths.

Per kind of bin, a subset-sum over bits finds the fullest combination of the available lengths; it is taken as
often as the counts allow. The plan depends on at most max_tokens counts, so it is made on the driver; pieces then
find their place by their rank among those of their length.
"""

from __future__ import annotations

import sys
import types
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablarium.llm.common import map_arrow, materialize, parts, read

#: A Python worker remembers the ids of about so many words and marks; beyond, those in use stay.
CACHE_UNITS = 250_000
#: Pieces of one length and bucket that one window orders, about.
BUCKET_ROWS = 50_000

#: Marks at a word's end that are pieces of their own, and words of lower-case Latin letters: normalisation leaves both as they
#: are, so such words go to the tokenizer's model directly.
MARKS = ".,"
PLAIN_WORD = "^[a-zà-öø-ÿ]+$"
#: Bytes that byte-level tokenizers write as characters from U+0100 on.
BYTE_CHARS = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


def _spread(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the lists at, one after the other, and where each begins (and the last ends); list k is the next sizes[k] of flat."""
    n = sizes[at]
    edges = np.concatenate(([0], np.cumsum(n)))
    return flat[np.repeat((np.cumsum(sizes) - sizes)[at] - edges[:-1], n) + np.arange(edges[-1])], edges


def _encoder(path: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Texts to their ids, one after the other, and where each text's ids end; by a tokenizer that never joins words over white space.

    Distinct words are parted into a plain word and the marks after it, and only units that aren't remembered go to the
    tokenizer. A-Z are made lower case first, as the tokenizer does, but where its special tokens may occur.
    """
    holder = sys.modules.setdefault("_packing_tokenizers", types.ModuleType("_packing_tokenizers"))
    if path not in vars(holder):
        from tokenizers import Tokenizer

        # the units that are remembered, how many ids each has, and all these ids
        vars(holder)[path] = Tokenizer.from_file(path), [pa.array([], pa.string()), np.empty(0, np.int64), np.empty(0, np.uint32)]
    tokenizer, known = vars(holder)[path]
    tokenize = tokenizer.model.tokenize

    def learn(new: pa.Array) -> None:
        plain = pc.match_substring_regex(new, PLAIN_WORD)
        direct, other = new.filter(plain), new.filter(pc.invert(plain))
        tokens = [tokenize(u if u.isascii() else u.encode().decode("latin-1").translate(BYTE_CHARS)) for u in direct.to_pylist()]
        rest = [e.ids for e in tokenizer.encode_batch_fast(other.to_pylist(), add_special_tokens=False)]
        ids = [t.id for ts in tokens for t in ts] + [i for e in rest for i in e]
        known[0] = pa.concat_arrays([known[0], direct, other])
        known[1] = np.concatenate((known[1], np.array([*map(len, tokens), *map(len, rest)], np.int64)))
        known[2] = np.concatenate((known[2], np.array(ids, np.uint32)))

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        places = split.flatten().dictionary_encode()
        words = places.dictionary
        stems = pc.utf8_rtrim(words, MARKS)
        cut = pc.and_(pc.less(pc.binary_length(stems), pc.binary_length(words)), pc.match_substring_regex(stems, PLAIN_WORD))
        marks = pc.replace_with_mask(pa.array([""]).take(pa.array(np.zeros(len(words), np.int8))), cut, pc.replace_substring_regex(words.filter(cut), "^.*[^.,]", ""))
        units = pa.concat_arrays([pc.if_else(cut, stems, words), marks]).dictionary_encode()
        if len(known[0]) > CACHE_UNITS:  # those in use stay
            used = pc.is_in(known[0], value_set=units.dictionary).to_numpy(zero_copy_only=False)
            known[:] = known[0].filter(pa.array(used)), known[1][used], _spread(known[2], known[1], np.flatnonzero(used))[0]
        learn(units.dictionary.filter(pc.invert(pc.is_in(units.dictionary, value_set=known[0]))))
        at = pc.index_in(units.dictionary, value_set=known[0]).to_numpy()[units.indices.to_numpy()]
        flat, edges = _spread(known[2], known[1], at.reshape(2, -1).T.ravel())
        ids, ends = _spread(flat, np.diff(edges[::2]), places.indices.to_numpy())
        return ids, ends[split.offsets.to_numpy()[1:] - split.offsets[0].as_py()]

    return encode


def pieces(docs: DataFrame, tokenizer: str, max_tokens: int = 2048, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each row's ids and the id `end`, cut every max_tokens. Null text is empty.

    tokenizer: the file of one that makes A-Z lower case and never joins words over white space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        last = array("I", [end]).tobytes()
        for batch in batches:
            for s, e in parts(batch.column(1)):
                part = batch.slice(s, e - s)
                ids, ends = encode(pc.fill_null(part.column(1), ""))
                sizes = np.diff(ends, prepend=0) + 1
                cuts = -(-sizes // max_tokens)
                row = np.repeat(np.arange(len(sizes)), cuts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = piece * max_tokens
                length = np.minimum(sizes[row] - start, max_tokens)
                raw, begin = memoryview(ids.tobytes()), 4 * (ends - sizes + 1)[row] + 4 * start
                final = start + length == sizes[row]  # such a piece ends with `end`, which isn't in ids
                sums = [zlib.crc32(last, c) if f else c for f, c in zip(final.tolist(), (zlib.crc32(raw[b : b + n]) for b, n in zip(begin.tolist(), (4 * (length - final)).tolist(), strict=True)), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(available: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The (length, times) whose sum is largest up to room, long ones first among equals met first."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted((x for x in available if x <= room), reverse=True):
        left, k = min(available[length], room // length), 1
        while left:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + k
            at -= length * k
    return sorted(taken.items(), reverse=True)


def plan(counts: dict[int, int], max_tokens: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, contents as (length, times)): minimum bin slack, each bin around the longest length that is left."""
    left = {x: n for x, n in counts.items() if n}
    out = []
    while left:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        content = dict(fullest({x: n for x, n in rest.items() if n}, max_tokens - longest))
        content[longest] = content.get(longest, 0) + 1
        bins = min(left[x] // n for x, n in content.items())
        for x, n in content.items():
            left[x] -= bins * n
            if not left[x]:
                del left[x]
        out.append((bins, sorted(content.items(), reverse=True)))
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, max_tokens: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row of docs.

    Repeated and null ids are packed like others. No rows: no sequences.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    cut = materialize(pieces(docs, tokenizer, max_tokens))
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # max_tokens rows at most
    taken, bins, slots = dict.fromkeys(counts, 0), 0, []
    for many, content in plan(counts, max_tokens):
        offset = 0
        for length, times in content:
            slots.append((length, taken[length], taken[length] + many * times, bins, times, offset))
            taken[length] += many * times
            offset += length * times
        bins += many
    places = docs.sparkSession.createDataFrame(slots, "length long, lo long, hi long, first long, times long, at long")
    # ranks by length without one window for a common length: within buckets, plus the counts of the buckets before
    buckets = 1 + sum(counts.values()) // BUCKET_ROWS
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "bucket").count()
    before = sizes.select("length", "bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before"))
    ranked = dealt.withColumn("n", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1).join(before, ["length", "bucket"]).withColumn("rank", F.col("n") + F.col("before"))
    # as many rows as the plan has entries, which max_tokens bounds
    found = ranked.join(F.broadcast(places), "length").filter("rank >= lo and rank < hi").withColumn("q", F.col("rank") - F.col("lo"))
    return found.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.expr("first + q div times").alias("sequence_id"), F.expr("at + (q % times) * length").alias("offset"),
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


QUERIES = {"op10_packing": op10_packing}
