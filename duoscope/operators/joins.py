"""Joins that hold under skew.

Sides that grow with the data are never broadcast. The planner guesses their size from the compressed
Parquet files and from arrays of one element, which is far too low: a million entities with their
vectors pass as a few MB and go through the driver. So they are marked with grown(). Only sides with
a proven bound (centroids, grids) carry the hint for broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grown(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the data: shuffled and merged whatever the planner takes its size for."""
    return side.hint("merge")


def join_sides(dyads: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Dyads with the columns of both entities, which are unique per key.

    Hot users and items are split by AQE, which knows the exact sizes of the shuffled parts: dyads are on the side it splits,
    and the one entity row of a hot key is read by each of the parts.
    """
    return dyads.join(grown(items), "item_id").join(grown(users), "user_id")


def rated_items(items: DataFrame, ratings: DataFrame) -> DataFrame:
    """Items with at least one rating; ratings are reduced to their items before they are shuffled."""
    return items.join(grown(ratings.select("item_id").distinct()), "item_id", "left_semi")


def popular_ratings(ratings: DataFrame, id_map: DataFrame) -> DataFrame:
    """Ratings of popular items, with the item's index."""
    return ratings.join(grown(id_map.select("item_id", "idx")), "item_id")


def with_names(df: DataFrame, variables: DataFrame, missing: str = "WRONG VARIABLE") -> DataFrame:
    """Variable names from the ``variable(var, name)`` table."""
    named = df.join(variables.select("var", "name"), "var", "left")
    return named.withColumn("name", F.coalesce("name", F.lit(missing)))
