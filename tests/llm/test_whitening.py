"""Whitening against exact whole numbers and numpy's eigenvalues."""

import numpy as np
import pytest

from tablarium.llm import whitening
from tablarium.llm.common import read

SF = "/root/testdata/sf0.01"


def plain(rows, most=8):
    """n, deviations by key, and key -> whitened up to sign, explained."""
    fit = [(k, [int(np.floor(1024 * float(c))) + 100_000 for c in v]) for k, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    n, width = len(fit), len(fit[0][1])
    sums = [sum(x[d] for _, x in fit) for d in range(width)]
    dev = {k: sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for k, x in fit}
    y = np.array([x for _, x in fit], float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-values)[:most]
    return n, dev, {k: r for (k, _), r in zip(fit, np.abs(y @ vectors[:, order] / np.sqrt(values[order])), strict=True)}, values[order] / values.sum()


def check(table, rows, most=8):
    n, dev, white, explained = plain(rows, most)
    got = whitening.whiten(table, most=most).collect()
    assert len(got) == n * len(explained)
    for r in got:
        c = r.component - 1
        assert r.n == n and r.deviation == dev[r.vec_id] and r.identity_error < 1e-9
        assert abs(r.explained - explained[c]) < 1e-10 and abs(abs(r.whitened) - white[r.vec_id][c]) < 1e-6
    signs = {}  # one sign for all rows
    y = np.zeros((n, len(explained)))
    for r in sorted(got, key=lambda r: (r.vec_id, r.component)):
        y[signs.setdefault(r.vec_id, len(signs)), r.component - 1] = r.whitened
    assert np.abs(y.T @ y / n - np.outer(y.mean(0), y.mean(0)) - np.eye(y.shape[1])).max() < 1e-9


def test_whole_table(spark):
    table = read(spark, SF, "embeddings")
    check(table, [(r.vec_id, r.embedding) for r in table.collect()])


def test_awkward_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(size=5) * (1, 2, 3, 4, 5) + 1e4]) for k in range(300)]
    rows += [(300, None), (301, []), (302, [1.0, None, 1.0, 1.0, 1.0]), (303, [float("nan")] * 5), (304, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (305, [1.0, 2.0]), (306, [1e300] * 5)]
    table = spark.createDataFrame([(k, v, 1, 2) for k, v in rows], "vec_id long, embedding array<double>, n int, component int").repartition(7)
    check(table, rows[:300])
    check(table, rows[:300], most=3)


def test_rows_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 9 + [(None, [1.0, 2.0])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).collect() == []
    flat = [(k, [float(k), 2.0 * k, 0.0]) for k in range(8)] + [(None, [3.0, 6.0, 0.0])]  # one direction only
    got = whitening.whiten(spark.createDataFrame(flat, schema)).collect()
    assert len(got) == 9 and all(abs(r.explained - 1) < 1e-12 for r in got) and sum(r.vec_id is None for r in got) == 1


def test_deviation_beyond_a_long():
    got = whitening.deviations(np.array([[1 << 52, 0], [3, 4]]), 1 << 10, np.array([0, 0]))
    assert got.to_pylist() == [None, (3 << 10) ** 2 + (4 << 10) ** 2]


@pytest.mark.parametrize("values", [[5.0] * 6, [3.0, 3.0, 1.0, 1.0, 1.0], list(np.logspace(5, -5, 40)), [1.0, 0.0, 0.0], list(range(64))])
def test_components(values):
    q = np.linalg.qr(np.random.default_rng(1).normal(size=(len(values),) * 2))[0]
    a = (q * np.array(values)) @ q.T
    found, vectors = whitening.components((a + a.T) / 2, 8)
    want = sorted(values, reverse=True)[:8]
    assert np.abs(found - want).max() < 1e-13 * max(values) * len(values)
    assert np.abs(vectors.T @ vectors - np.eye(len(want))).max() < 1e-13
    assert np.linalg.norm(a @ vectors - vectors * found) < 1e-12 * np.linalg.norm(a)


def test_polar_factor():
    a = np.diag([3.0, 1e-9, -2.0, -1e-12])
    assert np.abs(whitening.polar(a) - np.diag([1.0, 1.0, -1.0, -1.0])).max() < 1e-3
