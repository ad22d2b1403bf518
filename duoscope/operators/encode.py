"""From raw interactions and attributes to mixed vectors."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duoscope import fixed
from duoscope.functions import scalars as S
from duoscope.functions import vectors as V
from duoscope.operators import joins
from duoscope.session import collect_bounded, cut_lineage

MAX_PARTS = 1_000_000


def with_outcome(ratings: DataFrame, bound: float = fixed.POSITIVE_RATING) -> DataFrame:
    return ratings.select("user_id", "item_id", S.outcome(F.col("rating"), bound).alias("outcome"))


def parsed_items(items: DataFrame, names=fixed.GENRES) -> DataFrame:
    """Items with a year: ``item_id, year, bin``."""
    parsed = items.select(
        "item_id", S.title_year(F.col("title")).alias("year"),
        S.multi_hot(F.col("genres"), names).alias("bin"),
    )
    return parsed.where(F.col("year").isNotNull())


def scaled_years(parsed: DataFrame) -> DataFrame:
    """Year to [0, 1] by the range of all parsed items (scalar subqueries, no join)."""
    low, high = (parsed.agg(f("year")).scalar() for f in (F.min, F.max))
    return parsed.withColumn("year_scaled", S.min_max(F.col("year"), low, high))


def distinct_genres(items: DataFrame) -> DataFrame:
    return items.select(F.explode(F.split("genres", r"\|")).alias("genre")).distinct()


def position_entries(entries: DataFrame, key: str) -> DataFrame:
    """``(key, pos, value)`` to ``(key, entries)``: the sparse vector of each key.

    Repeated positions keep the largest value; that first aggregation runs map-side, so a key with
    very many raw rows reaches the second one with at most one row per vector position.
    """
    unique = entries.groupBy(key, "pos").agg(F.max("value").alias("value"))
    return unique.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("entries"))


def tag_vectors(tags: DataFrame) -> DataFrame:
    """``(item_id, vec)`` over 1-based tag ids; the width is the largest tag id."""
    width = tags.agg(F.max("tag_id")).scalar()
    entries = tags.select(
        "item_id", (F.col("tag_id") - 1).alias("pos"), F.col("relevance").alias("value")
    )
    return position_entries(entries, "item_id").select(
        "item_id", V.fill_positions(F.col("entries"), width).alias("vec"))


def item_counts(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


def dense_index(counts: DataFrame, min_ratings: int = fixed.MIN_RATINGS, parts: int | None = None) -> DataFrame:
    """0-based index of the items with enough ratings, by falling count, then by id.

    A global ``row_number`` would sort every item in one task. Here the items are dealt to ranges of (count, id), which sampling
    makes about equally large and which are stored, so that a task that is run again sees the same ranges. The index is the
    number of items in the ranges before, a running sum over one number per range, plus the rank inside the range.
    """
    kept = counts.where(F.col("n") >= min_ratings).select(F.col("item_id").cast("bigint").alias("item_id"), "n")
    order = (F.desc("n"), F.asc("item_id"))
    ranges = kept.repartitionByRange(parts, *order) if parts else kept.repartitionByRange(*order)
    placed = cut_lineage(ranges.withColumn("part", F.spark_partition_id()))
    sizes = sorted(collect_bounded(placed.groupBy("part").agg(F.count(F.lit(1)).alias("m")), MAX_PARTS, "ranges"))
    before = dict(zip([r["part"] for r in sizes], accumulate((r["m"] for r in sizes), initial=0)))
    offsets = placed.sparkSession.createDataFrame(list(before.items()), "part int, before bigint")
    ranked = placed.withColumn("rn", F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1)
    # one row per range
    return ranked.join(F.broadcast(offsets), "part").select("item_id", "n", (F.col("before") + F.col("rn")).cast("int").alias("idx"))


def user_entries(outcomes: DataFrame, id_map: DataFrame) -> DataFrame:
    """Sparse tri-state vectors of users over the popular items: +1 / -1 where rated."""
    entries = joins.popular_ratings(outcomes, id_map).select(
        "user_id", F.col("idx").alias("pos"), F.when(F.col("outcome"), 1.0).otherwise(-1.0).alias("value"))
    return position_entries(entries, "user_id")


def user_vectors(outcomes: DataFrame, id_map: DataFrame) -> DataFrame:
    """The same as dense ``tri`` arrays, unrated 0."""
    width = id_map.agg(F.count(F.lit(1))).scalar()
    return user_entries(outcomes, id_map).select(
        "user_id", V.fill_positions(F.col("entries"), width, "tinyint").alias("tri"))


def without_item(tri: Column, idx: Column) -> Column:
    """The vector with the rated item itself set to missing (no label leak)."""
    return F.transform(tri, lambda v, i: F.when(i == idx, F.lit(0).cast("tinyint")).otherwise(v))


def item_vectors(scaled: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Items as ``(item_id, bin, num)`` with ``num`` = tags then year; items without tags drop out."""
    if tags is None:
        return scaled.select("item_id", "bin", F.array("year_scaled").alias("num"))
    return joins.grown(scaled).join(joins.grown(tags), "item_id").select(
        "item_id", "bin", F.concat("vec", F.array("year_scaled")).alias("num")
    )


def dyad_ids(outcomes: DataFrame, items: DataFrame, users: DataFrame) -> DataFrame:
    """Interactions whose two entities are both encoded; only ids travel."""
    kept = outcomes.join(joins.grown(items.select("item_id")), "item_id", "left_semi")
    return kept.join(joins.grown(users.select("user_id")), "user_id", "left_semi")


def sparse_dyads(outcomes: DataFrame, items: DataFrame, users: DataFrame, left_width: int) -> DataFrame:
    """``(user_id, item_id, label, indices, values)``: both vectors side by side, zeros left out.

    ``items`` is ``(item_id, bin, num)``, ``users`` is ``(user_id, entries)``. Users rate few of the
    popular items, so a row costs what was rated and not the width of the vectors.
    """
    dense = V.to_dense(F.col("bin"), F.lit(None).cast("array<tinyint>"), F.col("num"))
    right = items.select("item_id", V.nonzero(dense).alias("r")).select(
        "item_id", F.transform("r.pos", lambda p: p + left_width).alias("rp"), F.col("r.value").alias("rv"))
    left = users.select("user_id", F.col("entries.pos").alias("lp"), F.col("entries.value").alias("lv"))
    return joins.join_sides(outcomes, left, right).select(
        "user_id", "item_id", F.col("outcome").alias("label"),
        F.concat("lp", "rp").alias("indices"), F.concat("lv", "rv").alias("values"))


# -- names of vector positions --------------------------------------------------------------------

def item_variables(tag_names: DataFrame, tag_width: int, genres=fixed.GENRES) -> DataFrame:
    """``variable(var, name, kind)`` of item vectors, built to the width the vectors have."""
    spark, n = tag_names.sparkSession, len(genres)
    known = [(i, g, "genre") for i, g in enumerate(genres)] + [(n + tag_width, "Year", "year")]
    tags = tag_names.where(F.col("pos").between(0, tag_width - 1)).select(
        (F.col("pos") + n).alias("var"), "name", F.lit("tag").alias("kind"))
    return spark.createDataFrame(known, "var int, name string, kind string").unionByName(tags)


def user_variables(items: DataFrame, id_map: DataFrame) -> DataFrame:
    """``variable(var, name, kind)`` of user vectors: the titles of the popular items."""
    return items.join(joins.grown(id_map), "item_id").select(
        F.col("idx").alias("var"), F.col("title").alias("name"), F.lit("item").alias("kind"))


# -- categorical points -------------------------------------------------------------------------

def column_maxima(points: DataFrame, n_codes: int) -> list[int]:
    """The largest code of each categorical column: one small row."""
    maxima = [F.max(F.get("features", F.lit(i))).cast("int") for i in range(n_codes)]
    return list(points.agg(*maxima).first())


def categorical_points(points: DataFrame, n_codes: int, n_numeric: int, normalise: bool) -> DataFrame:
    """``(id, label, features)`` to ``(id, label boolean, cat, num, maxima)``.

    Normalising subtracts the mean and divides by the root of the summed squared deviations;
    columns without deviation become 0.
    """
    cat = F.transform(F.slice("features", 1, n_codes), lambda v: v.cast("int"))
    num = F.slice("features", n_codes + 1, n_numeric)
    coded = points.select(
        "id", (F.col("label") == 1).alias("label"), cat.alias("cat"), num.alias("num"),
        F.lit(column_maxima(points, n_codes)).alias("maxima"))
    if not normalise:
        return coded
    means = coded.agg(F.array(*[F.avg(F.get("num", F.lit(i))) for i in range(n_numeric)])).scalar()
    centred = coded.withColumn("_m", means).withColumn(
        "num", F.zip_with("num", "_m", lambda v, m: v - m)).drop("_m")
    norms = centred.agg(
        F.array(*[F.sqrt(F.sum(F.get("num", F.lit(i)) ** 2)) for i in range(n_numeric)])).scalar()
    return centred.withColumn("_s", norms).withColumn(
        "num", F.zip_with("num", "_s", lambda d, s: F.when(s > 0, d / s).otherwise(F.lit(0.0)))).drop("_s")


def column_stats(points: DataFrame, width: int) -> DataFrame:
    """Per column: max, sum, count and summed squared deviation."""
    long = points.select(F.posexplode("features").alias("col", "v"))
    stats = long.groupBy("col").agg(
        F.max("v").alias("max"), F.sum("v").alias("sum"), F.count("v").alias("n"),
        F.avg("v").alias("mean"),
    )
    # At most one row per vector position.
    spread = long.join(F.broadcast(stats.select("col", "mean")), "col").groupBy("col").agg(
        F.sum((F.col("v") - F.col("mean")) ** 2).alias("sq_dev")
    )
    return stats.join(spread, "col").select("col", "max", "sum", "n", "sq_dev")
