"""Substring deduplication: repeated byte strings and repeated word windows are cut, the first one stays."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from tablarium.llm.anchors import AnchoredRepeats
from tablarium.llm.common import read
from tablarium.llm.repeats import Repeats, remove
from tablarium.llm.suffix_array import SuffixRepeats


def byte_tokens(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8).astype(np.uint64)


def word_tokens(text: str | None) -> np.ndarray:
    words = (text or "").encode().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _outside(n: int, cover: list[tuple[int, int]]) -> list[tuple[int, int]]:
    ends = [0, *(e for _, e in cover)]
    return list(zip(ends, [*(s for s, _ in cover), n], strict=True))


def byte_dedup(docs: DataFrame, length: int = 100, gram: int = 32, by_suffixes: bool = False) -> DataFrame:
    """Remove every byte in a string of `length` bytes that also starts earlier (smaller doc_id, or earlier in the text).

    doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of each row. Null text is empty, long texts are
    searched whole. Rows with a null doc_id come last; rows of one doc_id are documents of their own, in the order of their texts.
    Cuts may split a character, so the kept bytes are hashed, not decoded. by_suffixes: by a suffix array of all bytes, which needs
    far more disk (README.md).
    """

    def finish(text: str | None, cover: list[tuple[int, int]]) -> tuple:
        raw = (text or "").encode()
        kept = b"".join(raw[s:e] for s, e in _outside(len(raw), cover))
        return len(raw), len(raw) - len(kept), len(cover), hashlib.sha256(kept).hexdigest()

    return remove(
        docs, SuffixRepeats(length) if by_suffixes else Repeats(length, gram, byte_tokens, of_bytes=True), finish, ["n_bytes", "n_removed", "n_spans", "kept_sha256"],
        [pa.int64(), pa.int64(), pa.int64(), pa.string()], "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string",
    )


def word_dedup(docs: DataFrame, length: int = 20, gram: int = 10) -> DataFrame:
    """Remove every word in a window of `length` words whose words also start earlier (smaller doc_id, or earlier in the text).

    doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by spaces) of each row. Null and empty texts have no
    words, long texts are searched whole. Rows with a null doc_id come last; rows of one doc_id are documents of their own,
    in the order of their texts. Blocks of `gram` words are indexed, so length must be 2 gram - 1 or more.
    """
    if length < 2 * gram - 1:
        raise ValueError("a window of fewer than 2 gram - 1 words need not hold a block")

    def finish(text: str | None, cover: list[tuple[int, int]]) -> tuple:
        words = (text or "").encode().split()
        kept = [w for s, e in _outside(len(words), cover) for w in words[s:e]]
        return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    return remove(
        docs, AnchoredRepeats(length, gram, word_tokens), finish, ["n_words", "n_removed", "kept_sha256"],
        [pa.int64(), pa.int64(), pa.string()], "doc_id long, n_words long, n_removed long, kept_sha256 string",
    )


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_dedup(read(spark, sf_dir, "documents"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_dedup(read(spark, sf_dir, "documents"))


QUERIES = {"op5_substrings": op5_substrings, "op9_substrings": op9_substrings}
