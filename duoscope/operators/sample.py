"""Sampling and random splits. Every draw is a function of the row's keys, its repeat number and an explicit seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duoscope.functions import draws


def numbered(df: DataFrame) -> DataFrame:
    """The rows with ``repeat``: equal rows are numbered from 1, so that they are drawn one by one.

    Equal rows are counted first, map-side, and written out again after that: many of them cost no more shuffle than one.
    """
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return counted.select(*df.columns, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))).alias("repeat"))


def bernoulli(df: DataFrame, fraction: float, seed: int, tries: int = 100) -> DataFrame:
    """Sample without replacement; an empty sample moves on to the next draw of every row."""
    rows = numbered(df)
    a, b = draws.pair(seed, *df.columns, "repeat")
    for t in range(tries):
        picked = rows.where(draws.number(a, b, t) < draws.limit(fraction)).select(df.columns)
        if not picked.isEmpty():
            return picked
    raise ValueError(f"no rows at fraction {fraction} in {tries} samples")


def split(df: DataFrame, keys: list[str], share: float = 0.7, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Two disjoint parts by a draw of the key: rows of one key stay together."""
    first = first_part(keys, share, seed)
    return df.where(first), df.where(~first)


def first_part(keys: list[str], share: float, seed: int) -> Column:
    """Whether split() puts a row into its first part."""
    a, _ = draws.pair(seed, *keys)
    return a < draws.limit(share)


def minibatches(rows: DataFrame, fraction: float, steps: list[int], seed: int) -> DataFrame:
    """All minibatches of some steps in one scan of numbered rows: each row once per step that drew it."""
    a, b = draws.pair(seed, *rows.columns)
    drawn = rows.select("*", a.alias("_a"), b.alias("_b"))
    hit = F.filter(F.lit(steps), lambda t: draws.number(F.col("_a"), F.col("_b"), t) < draws.limit(fraction))
    return drawn.select(*rows.columns, F.explode(hit).alias("step"))


def random_factors(columns: DataFrame, k: int, seed: int) -> DataFrame:
    """``(row, col, value)`` uniform in [-0.5, 0.5), one column per row of ``columns(col)``."""
    a, b = draws.pair(seed, "col")
    rows = columns.select("col", a.alias("_a"), b.alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("row"))
    return rows.select("row", "col", (draws.number(F.col("_a"), F.col("_b"), F.col("row")) / F.lit(float(draws.P)) - 0.5).alias("value"))


def random_tri_vectors(ids: DataFrame, width: int, seed: int) -> DataFrame:
    """A random tri-state vector for each id: a third each of -1, 0 and 1."""
    a, b = draws.pair(seed, "id")

    def value(i: Column) -> Column:
        x = draws.number(F.col("_a"), F.col("_b"), i)
        return F.when(x < draws.limit(0.33), -1).when(x >= draws.limit(0.67), 1).otherwise(0).cast("double")

    paired = ids.select("id", a.alias("_a"), b.alias("_b"))
    return paired.select("id", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), value).alias("vec"))
