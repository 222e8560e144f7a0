"""The near-duplicate stage against brute-force Jaccard."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tablarium.llm import near_copies
from tablarium.llm.common import read


def _set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def survivors(rows):
    sets, parent = [_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 4 * max(len(a), len(b)) <= 5 * min(len(a), len(b)) and (a == b or 5 * len(a & b) >= 4 * len(a | b)):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    return sorted(min((k is None, k or 0) for k in g) for g in groups.values())


def stage(spark, docs):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in corpus_pipeline.drop_near_copies(spark, docs, None).select("doc_id").collect())


@pytest.mark.parametrize(("many", "hot"), [(64, 50), (0, 10**6)])
def test_edited_copies(spark, many, hot, monkeypatch):
    """many = 0: members of every list are compared by parts; a large hot: lists of all known shingles have their leaders by partial sums."""
    monkeypatch.setattr(near_copies, "MANY", many)
    monkeypatch.setattr(near_copies, "HOT", hot)
    rng, rows = random.Random(7), []
    for base in range(6):
        words = [f"w{rng.randrange(500)}" for _ in range(64)]
        for k in range(12):
            copy = list(words)
            for _ in range(k % 6):
                copy[rng.randrange(64)] = f"x{rng.randrange(500)}"
            rows.append((100 * base + k, " ".join(copy)))
    rows += [(7, rows[3][1].upper()), (None, rows[20][1]), (None, "only here, without an id at all"), (900, None), (901, ""), (902, "short"), (903, "Short ")]
    want = survivors(rows)
    assert stage(spark, spark.createDataFrame(rows, "doc_id long, text string")) == want
    assert len(want) < len({t for _, t in rows}) - 6


def test_similar_sets_share_a_part():
    """Sets of all sizes with as many differences as the similarity allows, taken away, put in, or both."""
    rng, begins = np.random.default_rng(4), near_copies._classes(4000)
    for n in [*range(1, 80), 150, 333, 1000]:
        for _ in range(12):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            gone = int(rng.integers(0, n // 5 + 1))
            most = (5 * (n - gone)) // 4 - n  # more new ones would part them
            b = np.unique(np.concatenate((a[gone:], rng.integers(0, 1 << 63, max(0, int(rng.integers(0, max(0, most) + 1))), dtype=np.uint64))))
            same = len(np.intersect1d(a, b))
            if len(b) and 5 * same >= 4 * (len(a) + len(b) - same):
                assert np.intersect1d(near_copies.parts_of(a, begins), near_copies.parts_of(b, begins)).size, (n, len(b), same)


def test_unlike_texts_of_one_shingle(spark, monkeypatch):
    """A list of many texts that share a rare shingle only, among them some pairs with a long common part."""
    monkeypatch.setattr(near_copies, "MANY", 3)
    rng, rows = random.Random(3), []
    for k in range(60):
        words = [f"u{k}x{rng.randrange(9)}" for _ in range(rng.choice((8, 30)))]
        rows.append((k, " ".join([*words, "aa bb cc dd ee"])))
        if k % 7 == 0:
            rows.append((100 + k, " ".join([*words, "aa bb cc dd ee", "new"])))
            rows.append((200 + k, " ".join(["aa bb cc dd ee", *words[: len(words) // 2]])))
    assert stage(spark, spark.createDataFrame(rows, "doc_id long, text string")) == survivors(rows)


def test_driver_table(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    assert stage(spark, docs) == survivors([(r.doc_id, r.text) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()])
