"""The difference cover against sorted suffixes, and repeated places against a set of seen strings."""

import random

import edge
import pytest
from pyspark.sql import functions as F

from tablarium.llm import substrings, suffix_array
from tablarium.llm.common import read


def texts(spark, strings):
    return spark.createDataFrame(list(enumerate(strings)), "row long, text string")


@pytest.mark.parametrize("letters", ["ab", "a", "abcdefgh"])
def test_ranks(spark, letters, monkeypatch):
    monkeypatch.setattr(suffix_array, "BLOCK", 8)
    rng = random.Random(len(letters))
    strings = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 40))) for _ in range(12)] + ["", "ab" * 20, "ab" * 20]
    told = []
    got = {(r.row, r.pos): r.r for r in suffix_array.suffix_ranks(suffix_array.byte_symbols(texts(spark, strings)), told=told).collect()}
    coded = {k: [b + 1 for b in t.encode()] + [k + 257] for k, t in enumerate(strings)}
    places = sorted(((k, p) for k, c in coded.items() for p in range(len(c))), key=lambda x: coded[x[0]][x[1] :])
    assert got == {x: n for n, x in enumerate(places)} and len(told) > 1


def test_repeated_places(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents").filter(F.length("text") < 900).select("doc_id", "text").orderBy("doc_id").collect()
    strings = [r.text for r in docs][:60] + [t if t is None or len(t) < 2000 else t[:2000] for t in edge.TEXTS]
    got = {tuple(r) for r in suffix_array.repeated_places(texts(spark, strings)).collect()}
    seen, want = set(), set()
    for k, t in enumerate(strings):
        raw = (t or "").encode()
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                want.add((k, p))
            seen.add(w)
    assert got == want and want


def test_removal_by_suffixes(spark):
    rows = [(k, t) for k, t in enumerate(edge.TEXTS) if t is None or len(t) < 2000] + [(None, edge.PASSAGE), (900, edge.PASSAGE * 2), (900, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (sorted(map(repr, substrings.byte_dedup(docs, by_suffixes=x).collect())) for x in (True, False))
    assert one == two
