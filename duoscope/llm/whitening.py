"""Whitening of embeddings.

The fit list holds every distinct vector once. One pass gives its length and exact integer sums, a second the scatter of the
centred vectors: a task sums its own rows to one d x d matrix, matrices are summed row by row in a shuffle, and the driver
gets one matrix (d <= MAX_DIM, the size of the model). There, pivoted Cholesky splits the covariance V = L L', stopping where
the rest is rounding noise, and one-sided Jacobi rotates the columns of the triangular factor L until they are orthogonal: their
squared norms are the eigenvalues and the columns divided by their norms the components, as L J = U S gives V = U S^2 U'.

Vectors are quantised to integers first, x = floor(scale * c), saturated to 64 bits. Sums and deviations are exact at any size.

Defined cases: null vectors and vectors with null or non-finite entries are dropped; the dimension is the commonest length in
the fit list (the larger at a tie), vectors of another length have no components and are not returned; components without
variance have null ``whitened`` and explain 0 (null where nothing varies at all); repeated rows are all returned; null ids and
extra columns are carried; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duoscope.llm.registry import query
from duoscope.session import scratch_path, table

SCALE = 256
COMPONENTS = 4
#: Dimensions of a vector that may be fitted; the driver holds two matrices of that size.
MAX_DIM = 4096
EPS = np.finfo(float).eps


@dataclass(frozen=True)
class Whitening:
    """``components`` has one component per column, by falling eigenvalue."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def dim(self) -> int:
        return len(self.sums)

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.eigenvalues]


# -- the decomposition -------------------------------------------------------------------------
def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with a[order][:, order] = L L'; L is lower triangular with as many columns as ``a`` has rank."""
    d = len(a)
    rows, rest, order = np.zeros((d, d)), np.diag(a).astype(float).copy(), []
    noise = 16 * d * EPS * rest  # of each dimension's own variance, so that small ones keep their digits
    for k in range(d):
        rest[rest <= noise] = -np.inf
        pivot = int(np.argmax(rest))
        if rest[pivot] == -np.inf:
            break
        column = (a[:, pivot] - rows[:, :k] @ rows[pivot, :k]) / np.sqrt(rest[pivot])
        column[order] = 0.0
        rest -= column * column
        rest[[*order, pivot]] = -np.inf
        order.append(pivot)
        rows[:, k] = column
    others = np.setdiff1d(np.arange(d), order)
    full = np.concatenate([np.array(order, int), others.astype(int)])
    return rows[full, :len(order)], full


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """``factor`` times a rotation, with orthogonal columns. Disjoint pairs of columns are rotated together."""
    g = np.ascontiguousarray(factor.T)  # a column of the factor is a row here
    r = len(g)
    if r < 2:
        return g.T
    ring = list(range(r + r % 2))
    tolerance = EPS * np.sqrt(factor.shape[0])
    for _ in range(60):
        worst = 0.0
        for _ in range(len(ring) - 1):
            pairs = [(a, b) for a, b in zip(ring[:len(ring) // 2], ring[:len(ring) // 2 - 1:-1]) if a < r and b < r]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            p, q = np.array(pairs).T
            x, y = g[p], g[q]
            a, b, c = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y), np.einsum("ij,ij->i", x, y)
            scale = np.sqrt(a) * np.sqrt(b)
            cosine = np.divide(np.abs(c), scale, out=np.zeros_like(c), where=scale > 0)
            turn = cosine > tolerance
            worst = max(worst, cosine.max())
            if not turn.any():
                continue
            p, q, x, y = p[turn], q[turn], x[turn], y[turn]
            zeta = (b[turn] - a[turn]) / (2 * c[turn])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            cos = 1 / np.hypot(1.0, t)
            sin = cos * t
            g[p], g[q] = cos[:, None] * x - sin[:, None] * y, sin[:, None] * x + cos[:, None] * y
        if worst <= tolerance:
            break
    return g.T


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positive eigenvalues, falling, and unit eigenvectors as columns, the largest entry of each positive."""
    factor, order = pivoted_cholesky(v)
    rotated = one_sided_jacobi(factor)
    norms = np.sqrt(np.einsum("ij,ij->j", rotated, rotated))
    rank = np.argsort(-norms, kind="stable")
    vectors = np.empty_like(rotated)
    vectors[order] = rotated / np.where(norms > 0, norms, 1.0)
    vectors = vectors[:, rank]
    if vectors.size:
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return norms[rank] ** 2, vectors


# -- rows --------------------------------------------------------------------------------------
def quantised(df: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``row``, a struct of all other columns, and ``x``, the vector in whole numbers; rows without one are dropped."""
    def finite(c):
        return c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))

    vector = df[column]
    rows = df.where(vector.isNotNull() & F.forall(vector, finite))
    return rows.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns if c != column]).alias("row"),
        F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale)))).alias("x"))


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def centred(x: np.ndarray, model_sums: list[int], n: int) -> np.ndarray:
    """x - sums/n: whole parts are taken off before anything is rounded."""
    base = [s // n for s in model_sums]
    rest = np.array([(s - b * n) / n for s, b in zip(model_sums, base)])
    if max(np.abs(x).max(initial=0), max(map(abs, base), default=0)) < 1 << 62 and x.min(initial=0) > -(1 << 62):
        return (x - np.array(base, np.int64)).astype(float) - rest
    return x.astype(float) - np.array(base, float) - rest


def summed(parts: DataFrame, like: str = "i int, values array<double>") -> list:
    """Sums the vectors ``values`` of equal ``i`` over all parts; a task holds one vector per i. In order of the parts, so
    that every run rounds alike."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, values in zip(batch.column("i").to_pylist(), batch.column("values")):
                v = values.values.to_numpy(zero_copy_only=False)
                if i in total:
                    total[i] += v
                else:
                    total[i] = v.copy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))],
                                             ["i", "values"])

    return parts.repartition("i").sortWithinPartitions("i", "part").mapInArrow(add, like).collect()


def part_rows(values: np.ndarray) -> pa.RecordBatch:
    """A row per matrix row, with the number of the task."""
    part = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays(
        [pa.array(range(len(values)), pa.int32()), pa.array([part] * len(values), pa.int32()),
         pa.array(list(values), pa.list_(pa.float64()))], ["i", "part", "values"])


PART = "i int, part int, values array<double>"


def fit(vectors: DataFrame) -> tuple[Whitening, DataFrame] | None:
    """The model of the distinct ``x`` of the commonest length, and these vectors. None where there are none."""
    spark = vectors.sparkSession
    path = scratch_path(spark, "whitening")
    vectors.where("size(x) > 0").select("x").distinct().write.parquet(path)
    distinct = spark.read.parquet(path)
    size = distinct.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if size is None:
        return None
    dim, n = size
    if dim > MAX_DIM:
        raise ValueError(f"vectors of {dim} dimensions, at most {MAX_DIM} can be fitted")
    listed = distinct.where(F.size("x") == dim)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dim
        for batch in batches:
            x = matrix(batch.column(0), dim)
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)  # either half sums without overflow
            total = [t + (int(h) << 32) + int(w) for t, h, w in zip(total, high, low)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([str(t) for t in total])], ["i", "part"])

    by_dim = listed.mapInArrow(sums, "i int, part string").groupBy("i").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s"))
    exact = [int(s) for _, s in sorted(by_dim.collect())]

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim))  # the last row sums what rounding leaves of the mean
        for batch in batches:
            y = centred(matrix(batch.column(0), dim), exact, n)
            total[:dim] += y.T @ y
            total[dim] += y.sum(axis=0)
        yield part_rows(total)

    whole = np.zeros((dim + 1, dim))
    for i, values in summed(listed.mapInArrow(scatter, PART)):
        whole[i] = values
    left = whole[dim] / n
    v = whole[:dim] / n - np.outer(left, left)
    values, components = eigen(v)
    return Whitening(n, exact, values, components, float(np.trace(v))), listed


def projected(x: np.ndarray, model: Whitening, k: int) -> np.ndarray:
    k = min(k, len(model.eigenvalues))
    return centred(x, model.sums, model.n) @ model.components[:, :k] / np.sqrt(model.eigenvalues[:k])


def deviations(x: np.ndarray, model: Whitening) -> list[int]:
    """Sum over the dimensions of (n*x - S)^2. With z = x - floor(S/n) and m = S mod n that is
    n^2 sum(z^2) - 2 n sum(z m) + sum(m^2), where only two sums depend on the row."""
    n, base = model.n, [s // model.n for s in model.sums]
    rest = [s - b * n for s, b in zip(model.sums, base)]
    far = int(x.max(initial=0)) - min(base), max(base) - int(x.min(initial=0))
    wide = max(map(abs, far))
    if wide * max(wide, n) * model.dim < 1 << 62:
        z, m = x - np.array(base, np.int64), np.array(rest, np.int64)
    else:
        z, m = x.astype(object) - np.array(base, object), np.array(rest, object)
    square, cross, fixed = (z * z).sum(axis=1).tolist(), (z * m).sum(axis=1).tolist(), sum(r * r for r in rest)
    return [n * n * a - 2 * n * b + fixed for a, b in zip(square, cross)]


def whiten(vectors: DataFrame, model: Whitening, k: int = COMPONENTS) -> DataFrame:
    """``row``, ``deviation`` (exact, in digits) and ``whitened``, one value per component up to k, null without variance."""
    some = min(k, model.dim)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), model.dim)
            out = projected(x, model, some)
            padded = np.full((len(x), some), np.nan)
            padded[:, :out.shape[1]] = out
            flat = pa.array(padded.ravel(), mask=np.isnan(padded.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * some), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array([str(v) for v in deviations(x, model)]), lists], ["row", "deviation", "whitened"])

    rows = vectors.where(F.size("x") == model.dim)
    schema = T.StructType([rows.schema["row"], T.StructField("deviation", T.StringType()),
                           T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(apply, schema)


def identity_error(listed: DataFrame, model: Whitening, k: int = COMPONENTS) -> float | None:
    """Largest entry of the covariance of the whitened fit list minus the identity; None without any variance."""
    k = min(k, len(model.eigenvalues))
    if not k:
        return None

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = projected(matrix(batch.column(0), model.dim), model, k)
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        yield part_rows(total)

    whole = np.zeros((k + 1, k))
    for i, values in summed(listed.mapInArrow(moments, PART)):
        whole[i] = values
    left = whole[k] / model.n
    return float(np.abs(whole[:k] / model.n - np.outer(left, left) - np.eye(k)).max())


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    schema = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    fitted = fit(vectors)
    if fitted is None:
        return spark.createDataFrame([], schema)
    model, listed = fitted
    shares = model.explained[:COMPONENTS]
    shares += [0.0 if model.trace > 0 else None] * (min(COMPONENTS, model.dim) - len(shares))
    rows = whiten(vectors, model).select("row.vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    share = F.array(*[F.lit(s).cast("double") for s in shares])
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"),
        F.expr("try_cast(deviation as bigint)").alias("deviation"), "whitened",
        F.element_at(share, F.col("at") + 1).alias("explained"),
        F.lit(identity_error(listed, model)).cast("double").alias("identity_error"))
