"""Resampling against a version that counts whole texts, one at a time."""

import hashlib
import math
import zlib
from collections import Counter

import edge
import plain
import pytest

from tablarium.llm import resampling
from tablarium.llm.common import read

SF = "/root/testdata/sf0.01"


def runs(text, max_n):
    w = plain.tokens(text)
    return [" ".join(w[i : i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, percent, max_n, buckets, min_words, seed):
    crc = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = Counter(crc(r) for _, x in docs for r in runs(x, max_n)), Counter(crc(r) for x in target for r in runs(x, max_n))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out, pool = {}, []
    for n, (k, x) in enumerate(docs):
        f = runs(x, max_n)
        weight = sum(gain[crc(r)] for r in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[n] = [k, len(f), weight, score, None]
        if len(plain.tokens(x)) >= min_words:
            pool.append(n)
    pool.sort(key=lambda n: (-out[n][3], out[n][0] is None, out[n][0] or 0, out[n][1], out[n][2]))
    for rank, n in enumerate(pool[: percent * len(pool) // 100], 1):
        out[n][4] = rank
    return sorted(map(tuple, out.values()), key=repr)


def same(docs, target, **how):
    options = {"percent": 10, "max_n": 1, "buckets": 10_000, "min_words": 20, "seed": 2024} | how
    got = sorted((tuple(r) for r in resampling.resample(docs, target, **how).collect()), key=repr)
    assert got == brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [r.text for r in target.select("text").collect()], **options)
    return got


def test_whole_tables(spark):
    docs, target = read(spark, SF, "documents"), read(spark, SF, "benchmark")
    got = same(docs, target)
    assert sum(r[4] is not None for r in got) == sum(r[1] >= 20 for r in got) // 10
    assert sorted(map(repr, (tuple(r) for r in resampling.op11_resampling(spark, SF).collect()))) == sorted(map(repr, got))


@pytest.mark.parametrize("max_n", [1, 2, 4])
def test_awkward_rows(spark, max_n):
    docs = edge.table(spark)
    docs = docs.unionByName(docs.filter("doc_id > 9"))  # repeated rows
    lines = spark.createDataFrame([(500, "a b\nc\n\nd e f g h i\nj"), (501, "\n\n"), (502, "x\n" * 50)], "doc_id long, text string")
    docs = docs.unionByName(lines, allowMissingColumns=True)
    target = spark.createDataFrame([("one c d e f", 1), (None, 2), ("shared3 shared4\nshared5", 3)], "text string, n_features long")
    same(docs, target, percent=70, max_n=max_n, buckets=97, min_words=1)


def test_crossing_runs():
    lines = [x.encode().split() for x in ("a b c d e f", "", "g", "h i j k l m n")]
    flat = [(w, k) for k, line in enumerate(lines) for w in line]
    want = [b" ".join(w for w, _ in flat[i : i + n]) for n in (2, 3, 4) for i in range(len(flat) - n + 1) if flat[i][1] != flat[i + n - 1][1]]
    assert Counter(resampling.crossing_runs(lines, 4)) == Counter(want) and resampling.crossing_runs(lines, 1) == []


def test_empty_tables(spark):
    none = edge.empty(spark)
    assert resampling.resample(none, none).collect() == []
    got = resampling.resample(edge.table(spark), none, percent=0).collect()
    assert len(got) == len(edge.rows()) and all(r["rank"] is None for r in got)
