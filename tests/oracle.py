"""Compare a registered query with its SQL in DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    return x


def _sorted(rows):
    return sorted((tuple(map(_cell, r)) for r in rows), key=repr)


def compare(spark, run, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = run(spark, sf_dir)
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = _sorted(tuple(r[c] for c in order) for r in df.collect())
    want = _sorted(tuple(r[names.index(c)] for c in order) for r in result.fetchall())
    assert len(got) == len(want)
    different = [(g, w) for g, w in zip(got, want, strict=True) if tuple(map(str, g)) != tuple(map(str, w)) and g != w]
    assert not different, different[:3]
