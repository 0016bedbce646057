"""Embedding whitening: exact sums and centred covariance in Spark, leading components by Householder
tridiagonalisation, bisection on Sturm counts and inverse iteration, then a broadcast projection.

The driver holds matrices of the embedding's dimension only, never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.store import saved, small_batches

#: An entry c becomes the whole number floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries of this size or more count as not finite, so that every sum stays exact in 64 bits.
LARGEST = float(1 << 21)
COMPONENTS = 8
#: Eigenvalues closer than this share of the matrix's norm form a cluster, which is kept orthogonal.
CLUSTER = 1e-3


# ---- eigenvectors of a symmetric matrix -------------------------------------------------------------

def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the unit Householder vectors that reduce a symmetric matrix."""
    a = np.array(matrix, np.float64)
    mirrors = []
    for j in range(len(a) - 2):
        x = a[j + 1:, j].copy()
        size = np.linalg.norm(x)
        v = x.copy()
        v[0] += np.copysign(size, x[0])
        length = np.linalg.norm(v)
        v = v / length if length > 0 else v
        mirrors.append(v)
        rest = a[j + 1:, j + 1:]
        p = rest @ v
        w = p - (p @ v) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[j + 1:, j] = 0
        a[j + 1, j] = -np.copysign(size, x[0])
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def smaller(diagonal: np.ndarray, off: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Sturm count: how many eigenvalues of the tridiagonal matrix lie below each point."""
    tiny = np.finfo(np.float64).tiny
    count, q = np.zeros(len(points), int), np.ones(len(points))
    for d, e in zip(diagonal.tolist(), [0.0, *(off * off).tolist()]):
        q = d - points - e / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def largest_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each halved in until the doubles end."""
    reach = np.zeros(len(diagonal))
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    pad = np.finfo(np.float64).eps * np.max(np.abs(diagonal) + reach)
    low = np.full(k, np.min(diagonal - reach) - pad)
    high = np.full(k, np.max(diagonal + reach) + pad)
    place = len(diagonal) - 1 - np.arange(k)  # of the wanted value in rising order
    for _ in range(2000):
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high)):
            break
        above = smaller(diagonal, off, middle) > place
        high = np.where(above, middle, high)
        low = np.where(above, low, middle)
    return low + (high - low) / 2


def _solve(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(T - value) y = right for all values at once, by elimination with row exchanges; right is (size, k)."""
    n, k = right.shape
    floor = np.finfo(np.float64).eps * max(np.max(np.abs(diagonal)), np.max(np.abs(off), initial=0.0), 1e-300)
    y = right.copy()
    u0, u1, u2 = np.zeros((n, k)), np.zeros((n, k)), np.zeros((n, k))
    a, b = diagonal[0] - values, np.full(k, off[0] if n > 1 else 0.0)
    for i in range(n - 1):
        c, d, e = np.full(k, off[i]), diagonal[i + 1] - values, np.full(k, off[i + 1] if i + 2 < n else 0.0)
        swap = np.abs(c) > np.abs(a)
        top, below = y[i].copy(), y[i + 1].copy()
        u0[i], u1[i], u2[i] = np.where(swap, c, a), np.where(swap, d, b), np.where(swap, e, 0.0)
        y[i] = np.where(swap, below, top)
        u0[i] = np.where(np.abs(u0[i]) < floor, floor, u0[i])
        factor = np.where(swap, a, c) / u0[i]
        a = np.where(swap, b, d) - factor * u1[i]
        b = np.where(swap, 0.0, e) - factor * u2[i]
        y[i + 1] = np.where(swap, top, below) - factor * y[i]
    u0[n - 1] = np.where(np.abs(a) < floor, floor, a)
    for i in range(n - 1, -1, -1):
        if i + 1 < n:
            y[i] -= u1[i] * y[i + 1]
        if i + 2 < n:
            y[i] -= u2[i] * y[i + 2]
        y[i] /= u0[i]
        big = np.max(np.abs(y[i:]), axis=0)
        y *= np.where(big > 1e150, 1e-150, 1.0)  # a scale of the whole column does not matter
    return y


def leading_eigen(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    k = min(k, len(matrix))
    scale = np.max(np.abs(matrix), initial=0.0)
    if k == 0 or scale == 0:
        return np.zeros(k), np.eye(len(matrix))[:, :k]
    diagonal, off, mirrors = tridiagonal(np.asarray(matrix) / scale)
    values = largest_values(diagonal, off, k)
    norm = np.max(np.abs(values))
    first = np.zeros(k, int)  # the first of each value's cluster
    for j in range(1, k):
        first[j] = first[j - 1] if values[j - 1] - values[j] <= CLUSTER * norm else j
    y = np.random.default_rng(7).standard_normal((len(diagonal), k))
    for _ in range(5):
        y = _solve(diagonal, off, values, y / np.linalg.norm(y, axis=0))
        for j in range(k):
            y[:, j] /= np.linalg.norm(y[:, j])
            for _ in range(2):  # twice is enough
                own = y[:, first[j]:j]
                y[:, j] -= own @ (own.T @ y[:, j])
                y[:, j] /= np.linalg.norm(y[:, j])
    for j in range(len(mirrors) - 1, -1, -1):
        y[j + 1:] -= 2 * np.outer(mirrors[j], mirrors[j] @ y[j + 1:])
    return values * scale, y


# ---- distributed sums -------------------------------------------------------------------------------

def _whole(column: pa.Array | pa.ChunkedArray, size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, whole numbers) of the usable vectors of a list column, one pair per length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    for length in ([size] if size is not None else np.unique(lengths).tolist()):
        rows = np.flatnonzero(lengths == length)
        if length <= 0 or not len(rows):
            continue
        flat = column.take(pa.array(rows)).flatten().cast(pa.float64())
        entries = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(-1, length)
        fine = np.all(np.abs(entries) < LARGEST, axis=1)  # never for what is no number
        if fine.any():
            yield rows[fine], np.floor(entries[fine] * SCALE).astype(np.int64) + SHIFT


def _sums(column: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            for _, x in _whole(batch.column(column)):
                held = totals.setdefault(x.shape[1], [0, np.zeros(x.shape[1], np.int64)])
                held[0] += len(x)
                held[1] += x.sum(axis=0)
        for size, (n, s) in totals.items():
            yield pa.record_batch([pa.array([size], pa.int32()), pa.array([n], pa.int64()), pa.array([s], pa.list_(pa.int64()))],
                                  names=["size", "n", "s"])

    return run


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n with one rounding: the whole part is taken off in whole numbers."""
    return (x - sums // n).astype(np.float64) - (sums % n) / n


def _products(column: str, n: int, sums: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, x in _whole(batch.column(column), len(sums)):
                y = _centred(x, n, sums)
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))],
                                  names=["i", "row"])

    return run


def _spread(column: str, n: int, sums: np.ndarray, project: np.ndarray) -> Callable:
    """Count, sums and centred products of the projected rows of a partition, merged batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, mean, square = 0, np.zeros(project.shape[1]), np.zeros((project.shape[1],) * 2)
        for batch in batches:
            for _, x in _whole(batch.column(column), len(sums)):
                w = _centred(x, n, sums) @ project
                m = w.mean(axis=0)
                gap = m - mean
                square += (w - m).T @ (w - m) + np.outer(gap, gap) * (count * len(w) / (count + len(w)))
                mean = mean + gap * (len(w) / (count + len(w)))
                count += len(w)
        if count:
            yield pa.record_batch(
                [pa.array([count], pa.int64()), pa.array([mean], pa.list_(pa.float64())), pa.array([square.ravel()], pa.list_(pa.float64()))],
                names=["n", "mean", "square"])

    return run


def _identity_error(parts: DataFrame, n: int, k: int) -> float:
    """Largest entry of covariance minus identity: partitions' products plus the spread of their means."""
    parts = saved(parts)
    mean = np.zeros(k)
    for r in parts.select("n", F.posexplode("mean").alias("i", "m")).groupBy("i").agg(F.sum(F.col("n") * F.col("m") / n).alias("m")).collect():
        mean[r.i] = r.m
    away = F.expr(f"transform(mean, (m, i) -> m - array({', '.join(f'{v!r}D' for v in mean.tolist())})[i])")
    cells = parts.withColumn("away", away).select("n", "away", F.posexplode("square").alias("at", "v"))
    both = F.expr(f"v + n * away[at div {k}] * away[at % {k}]")
    square = np.zeros(k * k)
    for r in cells.groupBy("at").agg(F.sum(both).alias("v")).collect():
        square[r.at] = r.v
    return float(np.max(np.abs(square.reshape(k, k) / n - np.eye(k))))


def _projection(column: str, vec_id: str, shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, project = shared.value
        for batch in batches:
            for rows, x in _whole(batch.column(column), len(sums)):
                w = _centred(x, n, sums) @ project
                far = n * x - sums
                small = np.max(np.abs(far), axis=1) < int((2.0**62 / len(sums)) ** 0.5)
                short = np.where(small, (np.where(small[:, None], far, 0) ** 2).sum(axis=1), 0)
                wide = {i: sum(v * v for v in far[i].tolist()) for i in np.flatnonzero(~small).tolist()}
                fits = {i: v for i, v in wide.items() if v < 1 << 63}
                short[list(fits)] = list(fits.values())
                past = np.isin(np.arange(len(x)), [i for i in wide if i not in fits])
                yield pa.record_batch(
                    [batch.column(vec_id).take(pa.array(rows)), pa.array(short, pa.int64(), mask=past),
                     pa.array([str(wide[i]) if p else None for i, p in enumerate(past.tolist())], pa.string()),
                     pa.array(list(w), pa.list_(pa.float64()))],
                    names=[vec_id, "short", "wide", "whitened"])

    return run


def whiten(vectors: DataFrame, column: str = "embedding", vec_id: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every usable vector on the leading components of all of them.

    vectors: an id and a list of numbers; other columns are left out. A vector that is null or empty,
    or holds a null, a NaN, an infinity or an entry of LARGEST or more drops out, and so does one whose
    length is not the most frequent (the longer of equally frequent ones); repeated rows and null ids stay
    and count each. Entries become whole numbers; sums are exact. One row per vector and component, from 1 by
    falling eigenvalue: the id, component, n, deviation (null where it passes 64 bits), deviation_exact
    (decimal), whitened, explained, identity_error. A component without variance has a null whitened;
    without any variance explained and identity_error are null too. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    given = vectors.select(F.col(vec_id).alias("vec_id"), F.col(column).alias("v"))
    kind = given.schema["vec_id"].dataType
    cells = given.select("v").mapInArrow(_sums("v"), "size int, n long, s array<long>").select("size", "n", F.posexplode("s").alias("i", "s"))
    top = (
        cells.groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        .groupBy("size").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "s"))).alias("s"))
        .orderBy(F.desc("n"), F.desc("size")).first()
    )
    n, sums = (top["n"], np.array([c.s for c in top["s"]], np.int64)) if top else (0, np.zeros(0, np.int64))
    size = len(sums)
    covariance = np.zeros((size, size))
    if n:
        products = given.select("v").mapInArrow(_products("v", n, sums), "i int, row array<double>")
        for r in products.select("i", F.posexplode("row").alias("j", "v")).where("i <= j").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
            covariance[r.i, r.j] = covariance[r.j, r.i] = r.v / n
    values, basis = leading_eigen(covariance, components)
    trace = float(np.trace(covariance))
    live = int(np.sum(values > 1e-12 * trace)) if trace > 0 else 0
    project = basis[:, :live] / np.sqrt(values[:live])
    error = None
    if live:
        error = _identity_error(given.select("v").mapInArrow(
            _spread("v", n, sums, project), "n long, mean array<double>, square array<double>"), n, live)
    shared = spark.sparkContext.broadcast((n, sums, project))
    out = T.StructType([T.StructField("vec_id", kind), T.StructField("short", T.LongType()), T.StructField("wide", T.StringType()),
                        T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    rows = given.mapInArrow(_projection("v", "vec_id", shared), out) if n else spark.createDataFrame([], out)
    share = F.array(*[F.lit(float(max(v, 0.0)) / trace if trace > 0 else None).cast("double") for v in values])
    return rows.select("*", F.posexplode(share).alias("at", "explained")).select(
        F.col("vec_id").alias(vec_id), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"),
        F.col("short").alias("deviation"), F.coalesce(F.col("short").cast("decimal(38,0)"), F.col("wide").cast("decimal(38,0)")).alias("deviation_exact"),
        F.get("whitened", F.col("at")).alias("whitened"), "explained", F.lit(error).cast("double").alias("identity_error"))
