"""Splits, loads, arms, resampling and walks against loops written here."""

import random

import pytest
from pyspark.sql import functions as F

from tablarium.operators import agreement, arms, splits
from tablarium.sources import crawl


def moved_one_by_one(counts, share):
    test = {k: max(1, min(n - 1, round(n * share))) if n >= 2 else round(n * share) for k, n in counts.items()}
    want = round(sum(counts.values()) * share)
    while sum(test.values()) != want:
        over = sum(test.values()) > want
        side = {k: test[k] if over else counts[k] - test[k] for k in counts}
        free = [k for k in counts if side[k] >= 2]
        if not free:
            break
        k = min(free, key=lambda k: (-side[k], k))
        test[k] += -1 if over else 1
    return test


def test_apportionment():
    rng = random.Random(1)
    for _ in range(300):
        counts = {f"s{k}": rng.randrange(1, 9) for k in range(rng.randrange(1, 30))}
        assert splits.apportion(counts, 0.6) == moved_one_by_one(counts, 0.6)


def test_split_of_one_large_stratum(spark, monkeypatch):
    monkeypatch.setattr(splits, "BUCKET_ROWS", 50)
    rows = spark.range(1003).select(F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, "large").when(F.col("id") > 900, "small").alias("s"))
    out = splits.stratified_split(rows, ["s"], "k").collect()
    assert len(out) == 1003 and sum(r.split == "test" for r in out) == round(1003 * 0.6)
    assert splits.stratified_split(rows.repartition(5), ["s"], "k").filter("split = 'test'").exceptAll(spark.createDataFrame(out).filter("split = 'test'")).count() == 0


def test_loads():
    rng = random.Random(2)
    for _ in range(400):
        sizes, fixed = [rng.randrange(0, 7) for _ in range(rng.randrange(0, 40))], [rng.randrange(0, 30) for _ in range(rng.randrange(1, 6))]
        total, want = list(fixed), []
        for s in sorted(sizes, reverse=True):
            i = min(range(len(total)), key=lambda i: (total[i], i))
            want.append((s, i))
            total[i] += s
        got = []
        for s, lo, hi, turns in splits.loads({s: sizes.count(s) for s in set(sizes)}, fixed):
            got += [(s, turns[k % len(turns)]) for k in range(hi - lo)]
        assert got == want


def test_shares(spark):
    got = splits.shares(spark.range(100).select(F.col("id").alias("doc_id")), 7, 5).groupBy("part").count().collect()
    assert {tuple(r) for r in got} == {("calibration", 7), ("duplicate", 5), ("main", 88)}


def test_arms(spark):
    rng, rows = random.Random(3), []
    for doc in range(120):
        for arm in "abc":
            if not (arm == "c" and doc % 10 == 0):
                rows.append((arm, doc, "f", rng.random() < {"a": 0.9, "b": 0.6, "c": 0.85}[arm], doc % 4 == 0))
    got = {(r.a, r.b, r.scope): r for r in arms.compared(spark.createDataFrame(rows, "arm string, document int, field string, right boolean, hard boolean")).collect()}
    assert len(got) == 6 and got["a", "c", "all"].decisions == 108 and got["a", "b", "hard"].decisions == 30
    right = {(a, d): ok for a, d, _, ok, _ in rows}
    r = got["a", "b", "all"]
    assert (r.only_a, r.only_b) == (sum(right["a", d] and not right["b", d] for d in range(120)), sum(right["b", d] and not right["a", d] for d in range(120)))
    assert r.winner == "a" and r.p < 0.001 and got["a", "c", "all"].winner is None


def test_paired_bootstrap(spark):
    docs = spark.range(400).selectExpr("id", "1 as tp_a", "0 as fp_a", "cast(id % 10 = 0 as int) as fn_a", "1 as tp_b", "0 as fp_b", "cast(id % 2 = 0 as int) as fn_b")
    low, high = agreement.bootstrap_difference(docs, 300).first()
    assert 0.08 < low < 2 / 2.1 - 2 / 2.5 < high < 0.22
    same = docs.selectExpr("id", *[f"{c}_a as {c}_{x}" for x in "ab" for c in ("tp", "fp", "fn")])
    assert agreement.bootstrap_difference(same, 50).first() == (0.0, 0.0)  # both arms share their rounds


@pytest.mark.parametrize("zeros", [0, 50])
def test_ratio_of_many_values(spark, monkeypatch, zeros):
    rng = random.Random(4)
    rows = [(k // 2, 0.0 if k < zeros else 10 ** rng.uniform(-2, 4)) for k in range(1200)]
    labels = spark.createDataFrame(rows, "unit int, value double")
    exact = agreement.krippendorff_ratio(labels).first()
    monkeypatch.setattr(agreement, "FEW_VALUES", 10)
    binned = agreement.krippendorff_ratio(labels).first()
    assert exact.n == binned.n == 1200 and abs(exact.alpha - binned.alpha) <= 2e-5


def test_walk_of_sitemaps(spark):
    rng, stored = random.Random(6), []
    names = [f"m{k}" for k in range(40)]
    for n in names[:36]:
        index, locs = rng.random() < 0.4, [rng.choice(names) for _ in range(rng.randrange(0, 7))]
        body = ("<sitemapindex>" if index else "<urlset>") + "".join(f"<loc>{x if index else 'page-' + n + x}</loc>" for x in locs)
        stored.append((n, body, rng.random() < 0.9, index, locs))
    by = {s[0]: s for s in stored}
    starts = [(site, at, rng.choice(names)) for site in range(12) for at in range(4)]
    want = set()
    for site in range(12):
        queue, seen = [(u, 0) for s, _, u in starts if s == site], set()
        while queue and len(seen) < 5:
            u, depth = queue.pop(0)
            if u in seen:
                continue
            seen.add(u)
            if u not in by or not by[u][2] or not by[u][4]:
                continue
            if by[u][3] and depth < 2:
                queue += [(x, depth + 1) for x in by[u][4]]
            else:
                want |= {(site, x if by[u][3] else f"page-{u}{x}") for x in by[u][4]}
    tables = spark.createDataFrame(starts, "site int, at int, url string"), spark.createDataFrame([s[:3] for s in stored], "url string, body string, ok boolean")
    pages, notes = crawl.walk_sitemaps(*tables, max_sitemaps=5)
    assert {tuple(r) for r in pages.collect()} == want and {r.note for r in notes.collect()} == {"failed", "empty"}
