"""Histograms over thresholds and the best split per variable."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duoscope import fixed
from duoscope.functions import scalars as S
from duoscope.session import collect_bounded

MAX_CLUSTERS = 100_000
# Variables times clusters from which matrix products beat unpivoted sums (measured). Both give the same histogram.
WIDE_FROM = 2_000
WIDE_CELLS = 32_000_000
WIDE_ROWS = 1024


def cluster_sizes_array(sizes: DataFrame) -> Column:
    """Sizes by cluster id 0..k-1; a cluster without members has size 0. Model-sized."""
    found = {r["cluster_id"]: r["size"] for r in collect_bounded(sizes, MAX_CLUSTERS, "clusters")}
    return F.lit([float(found.get(i, 0)) for i in range(max(found) + 1)])


def with_bins(rows: DataFrame, thresholds: list[list[float]]) -> DataFrame:
    """Attributes to bin numbers: ``bins array<smallint>``, all variables at once."""
    table = F.array(*[F.array(*[F.lit(float(t)) for t in thr]).cast("array<double>") for thr in thresholds])
    bins = F.transform("x", lambda v, i: S.bin_of(v, F.get(table, i)).cast("smallint"))
    return rows.withColumn("bins", bins)


def utility_columns(rows: DataFrame, width: int) -> DataFrame:
    """``u array`` to columns ``u0 …`` so that sums run in code generation."""
    cols = [F.get("u", F.lit(i)).cast("bigint").alias(f"u{i}") for i in range(width)]
    return rows.select(*[c for c in rows.columns if c != "u"], *cols)


def vote_arrays(rows: DataFrame) -> DataFrame:
    """Count and utilities of a row in one array ``votes``, for as many clusters as would make too many columns."""
    return rows.select(*[c for c in rows.columns if c != "u"], F.concat(F.array(F.lit(1.0)), F.col("u").cast("array<double>")).alias("votes"))


def collapse(rows: DataFrame, width: int) -> DataFrame:
    """Rows with equal bins become one with summed counts and utilities."""
    if "votes" in rows.columns:
        return rows.groupBy("bins").agg(F.array(*[F.sum(F.get("votes", F.lit(i))) for i in range(width + 1)]).alias("votes"))
    return rows.groupBy("bins").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"u{i}").alias(f"u{i}") for i in range(width)]
    )


def histogram(rows: DataFrame, width: int, *keys: str) -> DataFrame:
    """``(keys…, var, bin, n, pos array)``.

    The unpivoted rows only exist inside the map-side aggregation; what is shuffled is at most one
    row per (key, variable, bin) and task.
    """
    sums = [f"u{i}" for i in range(width)]
    # bins are never empty; the outer form spares a size filter that would bin every row twice
    long = rows.select(*keys, F.posexplode_outer("bins").alias("var", "bin"), "n", *sums)
    hist = long.groupBy(*keys, "var", "bin").agg(
        F.sum("n").alias("n"), *[F.sum(u).alias(u) for u in sums]
    )
    return hist.select(*keys, "var", "bin", "n", F.array(*sums).alias("pos"))


def wide_histogram(rows: DataFrame, width: int, key: str, num_vars: int, num_bins: int) -> DataFrame:
    """The same histogram for many variables times clusters, as matrix products per Arrow batch.

    Unpivoting would make ``num_vars`` rows of ``width`` sums out of every row. Here a batch adds
    indicator(bin)ᵀ · utilities per bin, and a task emits its sums per (key, variable, bin).
    """
    schema = f"{key} int, var int, bin smallint, n bigint, pos array<double>"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            bins = b.column("bins").flatten().to_numpy().reshape(-1, num_vars)
            votes = b.column("votes").flatten().to_numpy().reshape(-1, width + 1)
            owner = b.column(key).to_numpy()
            for k in np.unique(owner):
                at = np.flatnonzero(owner == k)
                if k not in sums:
                    if (len(sums) + 1) * num_vars * num_bins * (width + 1) > WIDE_CELLS:
                        yield from emit(sums)
                        sums = {}
                    sums[k] = np.zeros((num_bins, num_vars, width + 1))
                for i in range(0, len(at), WIDE_ROWS):
                    part = at[i:i + WIDE_ROWS]
                    mine, theirs = bins[part], votes[part]
                    for j in range(num_bins):
                        sums[k][j] += (mine == j).astype(float).T @ theirs
        yield from emit(sums)

    def emit(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for k, total in sums.items():
            j, v = np.nonzero(total[:, :, 0])
            cells = total[j, v]
            pos = pa.ListArray.from_arrays(
                np.arange(0, len(j) * width + 1, width, dtype="int32"), np.ascontiguousarray(cells[:, 1:]).ravel())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(j), k, "int32")), pa.array(v.astype("int32")), pa.array(j.astype("int16")),
                 pa.array(cells[:, 0].astype("int64")), pos], [key, "var", "bin", "n", "pos"])

    if "votes" not in rows.columns:
        votes = F.array(F.col("n").cast("double"), *[F.col(f"u{i}").cast("double") for i in range(width)])
        rows = rows.withColumn("votes", votes)
    sent = rows.select(F.col(key).cast("int").alias(key), "bins", "votes")
    sums = sent.mapInArrow(partial, schema).groupBy(key, "var", "bin").agg(
        F.sum("n").alias("n"), Summarizer.sum(array_to_vector("pos")).alias("pos"))
    return sums.withColumn("pos", vector_to_array("pos"))


def prefix_counts(hist: DataFrame, width: int, *keys: str) -> DataFrame:
    """Running counts and utility sums in bin order next to the totals of the variable.

    One scan of whole vectors per (key, variable), however many clusters there are: the sorted rows of a partition pass in Arrow
    batches, and a variable is given out when its last bin has come. What is held is the bins of one variable and one batch.
    """
    vector = hist.schema["pos"].dataType
    whole = vector.elementType.typeName() in ("long", "integer")
    names = [*keys, "var", "bin"]
    fields = [T.StructField(c, hist.schema[c].dataType) for c in names]
    number, sums = T.LongType(), T.ArrayType(T.LongType() if whole else T.DoubleType())
    schema = T.StructType([*fields, T.StructField("left_n", number), T.StructField("left_pos", sums), T.StructField("n", number),
                           T.StructField("total_pos", sums)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            starts = changes(held)
            if len(starts) > 1:  # the last variable may go on in the next batch
                yield from summed(held.slice(0, starts[-1]))
                held = held.slice(starts[-1])
        if held is not None and held.num_rows:
            yield from summed(held)

    def changes(rows: pa.Table) -> np.ndarray:
        new = np.zeros(rows.num_rows, bool)
        new[:1] = True
        for c in names[:-1]:
            values = rows[c].to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(new)

    def summed(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        starts = changes(rows)
        lengths = np.diff([*starts, rows.num_rows])
        pos = rows["pos"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, width)
        n = rows["n"].to_numpy()

        def running(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            total = np.cumsum(values, axis=0)
            before = np.concatenate([np.zeros_like(total[:1]), total])[starts]
            left = total - np.repeat(before, lengths, axis=0)
            return left, np.repeat(left[starts + lengths - 1], lengths, axis=0)

        def lists(values: np.ndarray) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).ravel()))

        (left_n, total_n), (left, total) = running(n), running(pos)
        columns = [*[rows[c].combine_chunks() for c in names], pa.array(left_n), lists(left), pa.array(total_n), lists(total)]
        yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    ordered = hist.select(*names, F.col("n").cast("bigint").alias("n"), F.col("pos").cast(sums).alias("pos"))
    return ordered.repartition(*keys, "var").sortWithinPartitions(*names).mapInArrow(scan, schema)


def split_scores(prefix: DataFrame, sizes: Column, *keys: str) -> DataFrame:
    """Both sides' weighted entropies for every cut that leaves rows on both sides."""
    right_n = F.col("n") - F.col("left_n")
    right_pos = F.zip_with("total_pos", "left_pos", lambda t, l: t - l)
    ratio = F.col("left_n") / F.col("n")
    scored = prefix.where(right_n > 0).select(
        *keys, "var", "bin", "n", ratio.alias("left_ratio"), (1 - ratio).alias("right_ratio"),
        S.weighted_entropy(F.col("left_n"), F.col("left_pos"), sizes).alias("left_we"),
        S.weighted_entropy(right_n, right_pos, sizes).alias("right_we"),
    )
    we = F.col("left_we") * F.col("left_ratio") + F.col("right_we") * F.col("right_ratio")
    return scored.withColumn("we", F.round(we, fixed.TIE_DIGITS))


def best_per_variable(scores: DataFrame, *keys: str) -> DataFrame:
    """Lowest weighted entropy per variable; the first bin wins ties."""
    cols = ["left_ratio", "right_ratio", "left_we", "right_we", "n"]
    best = scores.groupBy(*keys, "var").agg(F.min(F.struct("we", "bin", *cols)).alias("b"))
    return best.select(*keys, "var", "b.*")


def top_candidates(best: DataFrame, c: int, *keys: str) -> DataFrame:
    """The best ``c`` variables per node by (entropy, variable)."""
    order = W.partitionBy(*keys).orderBy("we", "var")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= c)


def best_splits(rows: DataFrame, sizes: Column, width: int, thresholds: list[list[float]]) -> DataFrame:
    """Best split per variable over all rows ``(x, u)``, with the threshold value."""
    binned = utility_columns(with_bins(rows, thresholds), width).withColumn("n", F.lit(1))
    scores = split_scores(prefix_counts(histogram(binned, width), width), sizes)
    table = F.array(*[F.array(*[F.lit(float(t)) for t in thr]).cast("array<double>") for thr in thresholds])
    value = F.get(F.get(table, F.col("var")), F.col("bin"))
    return best_per_variable(scores).withColumn("split_value", value)
