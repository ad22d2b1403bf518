"""Projection of entities into the learned subspace, and scoring.

Matrices are ``k x d`` numpy arrays on the driver and broadcast: their size is that of the model and
does not grow with the number of entities. Vectors, sparse or dense, go to Python in Arrow batches,
one matrix product per batch and no Python object per row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duoscope import fixed
from duoscope.functions import scalars as S
from duoscope.functions import vectors as V
from duoscope.operators import csr
from duoscope.operators.joins import join_sides

MODEL_LIMIT = 50_000_000
BLOCK_CELLS = 500_000
#: Farther from 0 than this times lambda, the sign of a product tells on which side of one half its utility is.
NEAR = 1e-6


def once(udf):
    """Keep the optimizer from copying a Python function into filters and generators above it."""
    return udf.asNondeterministic()


def project(dense: Column, matrix: np.ndarray, bias: bool = False) -> Column:
    """M·x for every row's dense vector; the width must fit."""
    width = matrix.shape[1] - bias

    @F.arrow_udf("array<double>")
    def times(x: pa.Array) -> pa.Array:
        for length in pc.unique(pc.list_value_length(x)).to_pylist():
            if length != width:
                raise ValueError(f"vector has {length} values, matrix {matrix.shape[1]} columns")
        rows = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
        return csr.lists(rows @ matrix[:, :width].T + (matrix[:, -1] if bias else 0.0))

    return once(times)(dense)


def projected(entities: DataFrame, matrix: np.ndarray, bias: bool) -> Column:
    """The projection of an entity table, sparse ``(pos, val)`` or dense ``vec``."""
    if "pos" in entities.columns:
        return csr.projection(F.col("pos"), F.col("val"), matrix, bias)
    return project(F.col("vec"), matrix, bias)


def project_long(entities: DataFrame, factors: DataFrame, key: str) -> DataFrame:
    """The same product as joins and sums over the long factor table: ``(key, row, value)``.

    Suits sparse vectors: only non-zero values meet the matrix. How to join is left to Catalyst.
    """
    values = entities.select(key, F.posexplode("vec").alias("col", "x")).where(F.col("x") != 0)
    return values.join(factors, "col").groupBy(key, "row").agg(
        F.sum(F.col("x") * F.col("value")).alias("value"))


def outer(dense: Column, v2: Column, bias: bool = False) -> Column:
    """v2 ⊗ x as one row-major array of rows."""
    x = F.concat(dense, F.array(F.lit(1.0))) if bias else dense
    return F.transform(v2, lambda a: F.transform(x, lambda b: a * b))


def matrix_of(factors: DataFrame, side: str) -> np.ndarray:
    """One side of the long factor table as an array."""
    from duoscope.session import collect_bounded

    rows = collect_bounded(factors.where(F.col("side") == side), MODEL_LIMIT, "model values")
    m = np.zeros((max(r["row"] for r in rows) + 1, max(r["col"] for r in rows) + 1))
    for r in rows:
        m[r["row"], r["col"]] = r["value"]
    return m


def factors_of(spark: SparkSession, w: np.ndarray, v: np.ndarray) -> DataFrame:
    parts = []
    for side, m in (("W", w), ("V", v)):
        row, col = np.indices(m.shape)
        parts.append(pa.table({"side": pa.repeat(side, m.size), "row": row.ravel().astype(np.int32), "col": col.ravel().astype(np.int32),
                               "value": m.ravel().astype(float)}))
    # whole columns: a Python row per cell takes the driver longer than learning the cells
    return spark.createDataFrame(pa.concat_tables(parts), "side string, row int, col int, value double")


def clip_columns(factors: DataFrame, radius: float = 1.0) -> DataFrame:
    """Matrix columns longer than ``radius`` are scaled down to it."""
    from pyspark.sql import Window as W

    norm = F.sqrt(F.sum(F.col("value") ** 2).over(W.partitionBy("side", "col")))
    scale = F.when(norm > radius, F.lit(radius) / norm).otherwise(F.lit(1.0))
    return factors.withColumn("value", F.col("value") * scale)


@dataclass
class UtilityModel:
    """u(x, y) = sigmoid((Wx)·(Vy)/λ). Scorers map DataFrames to DataFrames."""

    w: np.ndarray
    v: np.ndarray
    lam: float = fixed.LAMBDA
    biased_left: bool = False
    biased_right: bool = False

    def map_left(self, entities: DataFrame) -> DataFrame:
        return entities.withColumn("proj", projected(entities, self.w, self.biased_left))

    def map_right(self, entities: DataFrame) -> DataFrame:
        return entities.withColumn("proj", projected(entities, self.v, self.biased_right))

    def value(self, left_proj: Column, right_proj: Column) -> Column:
        return S.sigmoid(V.dot(left_proj, right_proj), self.lam)

    def score(self, dyads: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
        """Each entity is projected once; dyads carry ids and meet two k-vectors."""
        left = self.map_left(users).select("user_id", F.col("proj").alias("left_proj"))
        right = self.map_right(items).select("item_id", F.col("proj").alias("right_proj"))
        return join_sides(dyads, left, right).withColumn("utility", self.value(F.col("left_proj"), F.col("right_proj")))

    def likes(self, proj: Column, opposite: np.ndarray) -> Column:
        """0/1 per projected opposite vector (centroids or popular items), one product per batch."""
        @F.arrow_udf("array<int>")
        def liked(p: pa.Array) -> pa.Array:
            rows = p.flatten().to_numpy(zero_copy_only=False).reshape(len(p), -1)
            return csr.lists(self.over_half(rows, opposite).astype("int32"))

        return once(liked)(proj)

    def over_half(self, proj: np.ndarray, opposite: np.ndarray) -> np.ndarray:
        """Is the utility of each row with each opposite vector above one half? In blocks of rows,
        so that the doubles in between stay small however many opposite vectors there are."""
        out = np.empty((len(proj), len(opposite)), dtype=bool)
        step = max(1, BLOCK_CELLS // max(1, len(opposite)))
        for i in range(0, len(proj), step):
            d = proj[i:i + step] @ opposite.T
            out[i:i + step] = d > 0 if self.lam > 0 else d < 0
            near = np.abs(d) < NEAR * abs(self.lam)
            if near.any():  # where rounding decides, the utility itself is taken
                out[i:i + step][near] = 1.0 / (1.0 + np.exp(d[near] / -self.lam)) > 0.5
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        from duoscope.sources.tables import write_factors

        write_factors(factors_of(spark, self.w, self.v), path, self.biased_left, self.biased_right)

    @staticmethod
    def load(spark: SparkSession, path: str) -> UtilityModel:
        """From a factor table, or from a CSV pair when the path is its common prefix."""
        from duoscope.sources import tables

        csv = path.endswith(("_true", "_false"))
        factors = tables.read_factor_csv(spark, path) if csv else tables.read_factors(spark, path)
        flags = {r["side"]: r["biased"] for r in factors.select("side", "biased").distinct().collect()}
        return UtilityModel(matrix_of(factors, "W"), matrix_of(factors, "V"), fixed.LAMBDA,
                            flags["W"], flags["V"])
