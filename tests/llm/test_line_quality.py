"""The field against sums over all labellings, and its accuracy on held-out texts."""

import itertools
import zlib

import edge
import numpy as np
import pyarrow as pa
import pytest

from tablarium.llm import line_quality as lq
from tablarium.llm.common import read


def test_marginals_equal_all_labellings():
    rng = np.random.default_rng(5)
    count = np.array([1, 4, 2, 4, 3])
    score, moves = rng.normal(size=count.sum()), rng.normal(size=(2, 2))
    chains = lq._Chains(count)
    got, pairs = chains.marginals(score, moves)
    want, moved, s = [], np.zeros((2, 2)), 0
    for n in count.tolist():
        good, total, seen = np.zeros(n), 0.0, np.zeros((2, 2))
        for ys in itertools.product((0, 1), repeat=n):
            p = np.exp(sum(score[s + i] * y for i, y in enumerate(ys)) + sum(moves[a, b] for a, b in itertools.pairwise(ys)))
            total += p
            good += p * np.array(ys)
            for a, b in itertools.pairwise(ys):
                seen[a, b] += p
        want += list(good / total)
        moved += seen / total
        s += n
    assert np.abs(got - want).max() < 1e-12 and np.abs(pairs - moved).max() < 1e-12


def test_features():
    f, count, chars = lq.line_features(pa.array(["AB! cd\n\nAB! cd\nAB! cd", None, "", "é 1 é é", " \t "]))
    named = [dict(zip(lq.FEATURES, map(float, x), strict=True)) for x in f]
    assert count.tolist() == [4, 1, 1, 1, 1] and chars.tolist() == [6, 0, 6, 6, 0, 0, 7, 3]
    assert named[0]["capitals"] == 0.5 and abs(named[0]["exclamations"] - 0.2) < 1e-6 and named[0]["copy"] == 0
    assert named[2]["copy"] == 1 == named[3]["same_as_last"] and named[2]["same_as_last"] == 0 == named[1]["copy"]
    assert named[6]["commonest_run"] == 0.75 and named[6]["repeated_words"] == 0.5 and named[7]["words"] == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_held_out_accuracy(spark, sf):
    docs, labels = read(spark, f"/root/testdata/{sf}", "documents"), read(spark, f"/root/testdata/{sf}", "labels")
    got = lq.op13_line_quality(spark, f"/root/testdata/{sf}")
    assert got.count() == docs.count() and got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = got.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.97 * len(held)
    good, bad = [r.score for r in held if r.quality], [r.score for r in held if not r.quality]
    assert np.mean([[a > b for b in bad] for a in good]) >= 0.98


def test_held_out_labels_are_not_read(spark):
    docs, labels = read(spark, "/root/testdata/sf0.001", "documents"), read(spark, "/root/testdata/sf0.001", "labels")
    turned = labels.withColumn("quality", lq.held_out(labels.doc_id).cast("int").bitwiseXOR(labels.quality))
    one, two = ({r.doc_id: r.score for r in lq.classify_quality(docs, x).collect()} for x in (labels, turned))
    assert one == two


def test_awkward_rows(spark):
    docs = edge.table(spark)
    docs = docs.unionByName(docs)  # repeated rows
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(25)] + [(3, None, 0), (None, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    got = lq.classify_quality(docs, labels).collect()
    assert len(got) == 2 * len(edge.rows()) and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: {x.score for x in got if x.doc_id == r.doc_id} for r in got}.keys() == {r[0] for r in edge.rows()}
    assert len({r.score for r in got if r.doc_id in (0, 1)}) == 1 and not any(r.held_out for r in got if r.doc_id is None)
    marks = lq.mark_lines(docs, lq.learn(docs, labels)).filter("doc_id = 18").orderBy("line").collect()
    text = edge.TEXTS[18]
    assert {text[r.start : r.start + r.length] for r in marks} == set(text.split("\n"))


def test_one_class_and_empty_tables(spark):
    docs, none = edge.table(spark), spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in lq.classify_quality(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(k, 1) for k in range(9)], "doc_id long, quality int")
    assert {r.score for r in lq.classify_quality(docs, one).collect()} == {1.0}
    assert lq.classify_quality(edge.empty(spark), one).collect() == []
