"""Embedding whitening: principal components by QDWH spectral divide-and-conquer, applied to every vector by broadcast.

Spark sums the vectors and their centred products. The components come from the covariance, a matrix of the vectors' width:
the polar factor of the covariance less a shift is the sign of its eigenvalues, so half of it plus the identity projects onto
those above the shift; both sides are split further until each has one direction. The polar factor is found by dynamically
weighted Halley steps, with QR where the matrix is badly conditioned and Cholesky where it isn't.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablarium.llm.common import map_arrow, read

#: Entries become whole numbers: floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries of this size and more, whose scaled value a double can't hold to the unit, count as not finite.
LARGEST = float(1 << 43)
EPS = float(np.finfo(float).eps)
#: Vectors that are worked on at once.
BLOCK = 8192


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QDWH; for a symmetric one it is its sign."""
    n = len(a)
    alpha = float(np.linalg.norm(a))
    if alpha == 0:
        return np.eye(n)
    x, low, eye = a / alpha, EPS, np.eye(n)  # singular values lie in [low, 1]; those below are rounding
    for _ in range(40):
        d = np.cbrt(4 * (1 - low * low) / low**4)
        a_ = np.sqrt(1 + d) + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low * low) / (low * low * np.sqrt(1 + d))))
        b_ = (a_ - 1) ** 2 / 4
        c_ = a_ + b_ - 1
        if c_ > 100:
            q, _ = np.linalg.qr(np.vstack((np.sqrt(c_) * x, eye)))
            new = b_ / c_ * x + (a_ - b_ / c_) / np.sqrt(c_) * q[:n] @ q[n:].T
        else:
            root = np.linalg.cholesky(eye + c_ * x.T @ x)
            new = b_ / c_ * x + (a_ - b_ / c_) * np.linalg.solve(root.T, np.linalg.solve(root, x.T)).T
        low = min(1.0, low * (a_ + b_ * low * low) / (1 + c_ * low * low))
        moved = np.linalg.norm(new - x)
        x = (new + new.T) / 2
        if moved <= (10 * EPS) ** (1 / 3) and abs(1 - low) <= 10 * EPS:
            break
    return x


def _split(a: np.ndarray) -> tuple[np.ndarray, int] | None:
    """An orthonormal basis whose first k columns span the eigenvectors above a shift; None if all values are alike."""
    n, mean = len(a), np.trace(a) / len(a)
    spread = np.linalg.norm(a - mean * np.eye(n))
    if spread <= 4 * n * EPS * np.linalg.norm(a):
        return None
    # the middle of the diagonal parts most evenly; the mean lies between the least and the largest value
    for shift in (float(np.median(np.diag(a))), mean, *(mean + k * 1e-3 * spread / n for k in (1, -1, 3, -3, 10, -10))):
        projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        k = round(float(np.trace(projector)))
        if not 0 < k < n:
            continue
        # columns are taken from the longest on, so that the first k are independent; a second pass restores orthogonality
        basis = _pivoted(projector, k)
        first = np.linalg.qr(projector @ basis)[0]
        whole = np.linalg.qr(np.hstack((first, np.eye(n))))[0][:, :n]
        whole[:, k:] -= whole[:, :k] @ (whole[:, :k].T @ whole[:, k:])
        whole[:, k:] = np.linalg.qr(whole[:, k:])[0]
        apart = np.linalg.norm(whole[:, :k].T @ a @ whole[:, k:])
        if apart <= 1e3 * n * EPS * np.linalg.norm(a):
            return whole, k
    raise ArithmeticError("no shift parts the covariance")


def _pivoted(p: np.ndarray, k: int) -> np.ndarray:
    """k orthonormal vectors of the range of p by Gram-Schmidt, from the column that has most left each time."""
    rest, out = p.copy(), np.empty((len(p), k))
    for i in range(k):
        v = rest[:, int(np.argmax((rest * rest).sum(0)))]
        v = v - out[:, :i] @ (out[:, :i].T @ v)
        out[:, i] = v / np.linalg.norm(v)
        rest -= np.outer(out[:, i], out[:, i] @ rest)
    return out


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    Subspaces that can't hold one of them aren't split further. Where values are alike to rounding, any basis serves.
    """
    found: list[tuple[float, np.ndarray]] = []

    def descend(basis: np.ndarray, wanted: int) -> None:
        """Adds the eigenvectors within span(basis), of whose values the largest `wanted` are needed."""
        if wanted <= 0:
            return
        inner = basis.T @ v @ basis
        inner = (inner + inner.T) / 2
        parted = _split(inner) if len(inner) > 1 else None
        if parted is None:
            found.extend((float(inner[j, j]), basis[:, j]) for j in range(len(inner)))
            return
        q, k = parted
        descend(basis @ q[:, :k], wanted)
        descend(basis @ q[:, k:], wanted - k)

    descend(np.eye(len(v)), most)
    found.sort(key=lambda x: -x[0])
    vectors = np.array([x / np.linalg.norm(x) for _, x in found[:most]]).reshape(-1, len(v)).T
    return np.einsum("ij,ik,kj->j", vectors, v, vectors), vectors


def _whole(vectors: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows have finite vectors that aren't null (of `width`, if given), their widths, and their whole numbers one after the other."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    flat = vectors.flatten()  # leaves null lists out
    sizes = np.asarray(vectors.value_lengths().fill_null(0))
    values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    bad = np.concatenate(([0], np.cumsum(~(np.abs(values) < LARGEST))))
    ends = np.cumsum(sizes)
    good = (bad[ends] == bad[ends - sizes]) & (sizes > 0) & np.asarray(vectors.is_valid())
    if width is not None:
        good &= sizes == width
    kept = values[np.repeat(good, sizes)]
    return good, sizes[good], np.floor(SCALE * kept).astype(np.int64) + SHIFT


def _by_place(vectors: DataFrame, of_block: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sums over all blocks of rows of of_block(block), whose size depends on the width only; one row a place reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _whole(batch.column(0), width)[2].reshape(-1, width)
            for k in range(0, len(x), BLOCK):
                part = of_block(x[k : k + BLOCK])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["k", "v"])

    rows = map_arrow(vectors, run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(max((r.k for r in rows), default=-1) + 1)
    for r in rows:
        out[r.k] = r.v
    return out


def moments(vectors: DataFrame) -> tuple[int, list[int]]:
    """How many vectors are fit for use, and their exact sums by dimension. The width is the commonest one, the smaller among equals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            _, sizes, x = _whole(batch.column(0))
            of = np.repeat(sizes, sizes)
            for w in np.unique(sizes).tolist():
                rows = x[of == w].reshape(-1, w)
                n, s = sums.get(w, (0, np.zeros(w, np.int64)))
                sums[w] = n + len(rows), s + rows.sum(0)
        for w, (n, s) in sums.items():  # place -1 counts the rows
            yield pa.RecordBatch.from_arrays([pa.array([w] * (w + 1), pa.int32()), pa.array(np.arange(-1, w, dtype=np.int32)), pa.array(np.concatenate(([n], s)))], ["width", "k", "v"])

    sums = map_arrow(vectors, run, "width int, k int, v long").groupBy("width", "k").agg(F.sum("v").alias("v"))
    first = sums.filter("k = -1").orderBy(F.desc("v"), "width").first()
    if first is None:
        return 0, []
    return first.v, [r.v for r in sums.filter((F.col("width") == first.width) & (F.col("k") >= 0)).orderBy("k").collect()]


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 8) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error of each usable row and component up to `most`.

    Left out are rows whose vector is null or empty, holds null, non-finite or over-large entries (2**43), or isn't of the
    commonest width. Repeated rows, and null keys, count row by row; other columns aren't read. Components without variance
    are left out, so that an empty table, one row, or equal rows give no rows. deviation is null where it exceeds a long.
    """
    vectors = table.select(vector)
    n, s = moments(vectors)
    schema = f"`{key}` {dict(table.dtypes)[key]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if n == 0:
        return table.sparkSession.createDataFrame([], schema)
    width, sums = len(s), np.array(s, np.int64)
    mean = sums // n, (sums % n) / n  # whole part and rest, so that centring loses nothing of large values

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - mean[0]) - mean[1]

    v = _by_place(vectors, lambda x: (centred(x).T @ centred(x)).ravel(), width).reshape(width, width) / n
    v = (v + v.T) / 2
    values, axes = components(v, min(most, width))
    total = float(np.trace(v))
    kept = values > 64 * width * EPS * total
    values, axes = values[kept], axes[:, kept]
    m = len(values)
    if m == 0:
        return table.sparkSession.createDataFrame([], schema)
    turned = axes / np.sqrt(values)

    def white(x: np.ndarray) -> np.ndarray:
        return centred(x) @ turned

    def products(x: np.ndarray) -> np.ndarray:
        y = white(x)
        return np.concatenate((y.sum(0), (y.T @ y).ravel()))

    seen = _by_place(vectors, products, width) / n
    off = seen[:m]
    error = float(np.abs(seen[m:].reshape(m, m) - np.outer(off, off) - np.eye(m)).max())
    explained = values / total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, _, flat = _whole(batch.column(1), width)
            x, keys = flat.reshape(-1, width), batch.column(0).filter(pa.array(good))
            for k in range(0, len(x), BLOCK):
                y, rows = white(x[k : k + BLOCK]), len(x[k : k + BLOCK])
                yield pa.RecordBatch.from_arrays([
                    keys.slice(k, rows).take(pa.array(np.repeat(np.arange(rows), m))), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * m, n)), deviations(x[k : k + BLOCK], n, sums).take(pa.array(np.repeat(np.arange(rows), m))),
                    pa.array(y.ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * m, error)),
                ], [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_arrow(table.select(key, vector), run, schema)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Sums over the dimensions of (n * x - sums) ** 2, exact; null where one exceeds a long."""
    top = max(n * int(np.abs(x).max(initial=0)), int(np.abs(sums).max(initial=0)))
    if top < 1 << 62:
        z = n * x - sums
        if len(sums) * int(np.abs(z).max(initial=0)) ** 2 < 1 << 63:
            return pa.array((z * z).sum(1), pa.int64())
    exact = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, sums, strict=True)) for row in x]
    return pa.array([d if d < 1 << 63 else None for d in exact], pa.int64())


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))


QUERIES = {"op12_whitening": op12_whitening}
