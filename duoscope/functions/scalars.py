"""Scalar expressions: parsing, outcomes, entropy and bins. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from duoscope import fixed


def outcome(rating: Column, bound: float = fixed.POSITIVE_RATING) -> Column:
    """A rating at or above the bound is a positive outcome."""
    return rating >= F.lit(bound)


def predict(score: Column) -> Column:
    return score > F.lit(0.5)


def sigmoid(dot: Column, scale: float = fixed.LAMBDA) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-dot / F.lit(scale)))


def title_year(title: Column) -> Column:
    """The integer between the last pair of parentheses, or null."""
    digits = F.regexp_extract(title, r"\(([+-]?[0-9]+)\)[^()]*$", 1)
    return digits.try_cast("int")


def multi_hot(field: Column, names: Sequence[str] = fixed.GENRES) -> Column:
    """One boolean per name: does the field contain it as a substring?"""
    return F.array(*[F.contains(field, F.lit(n)) for n in names])


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Place of the value between low and high; 0 where they are equal."""
    return F.when(high == low, F.when(value.isNotNull(), F.lit(0.0))).otherwise(F.try_divide(value - low, (high - low).cast("double")))


def binary_entropy(p: Column) -> Column:
    """Entropy in bits of a yes/no share; 0 where all agree."""
    q = F.lit(1.0) - p
    return F.when((p > 0) & (p < 1), -p * F.log2(p) - q * F.log2(q)).otherwise(F.lit(0.0))


def weighted_entropy(n: Column, positives: Column, sizes: Column) -> Column:
    """Cluster-size-weighted entropy of 0/1 counts: arrays ``positives`` and ``sizes`` align."""
    total = F.aggregate(sizes, F.lit(0.0), lambda a, s: a + s)
    terms = F.zip_with(positives, sizes, lambda pos, s: binary_entropy(pos / n) * s)
    mean = F.coalesce(F.try_divide(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t), total), F.lit(0.0))
    return F.when(n > 0, mean).otherwise(F.lit(0.0))


def filter_holds(x: Column, filt: Column, strict: bool = True) -> Column:
    """One filter struct ``(var, lo, hi)`` on a vector; no variable lets every row through.

    ``strict=False`` is the half-open reading ``[lo, hi)`` used by tree nodes.
    """
    value = F.get(x, filt["var"])
    low = (value > filt["lo"]) if strict else (value >= filt["lo"])
    return F.when(filt["var"].isNull(), F.lit(True)).otherwise(low & (value < filt["hi"]))


def all_filters_hold(x: Column, filters: Column, strict: bool = True) -> Column:
    return F.forall(filters, lambda f: filter_holds(x, f, strict))


def inside_range(thresholds: Column, low: Column, high: Column) -> Column:
    """Thresholds strictly inside a node's range."""
    return F.filter(thresholds, lambda t: (t > low) & (t < high))


def bin_of(value: Column, thresholds: Column) -> Column:
    """How many thresholds are at or below the value."""
    return F.size(F.filter(thresholds, lambda t: t <= value))


def block_of(value: Column, cuts: Column) -> Column:
    """How many sorted cuts are below the value: an order-preserving block number.

    Free of lambdas, so that Catalyst may derive join constraints from it.
    """
    return F.array_position(F.sort_array(F.array_append(cuts, value)), value).cast("int") - 1


def bin_upper(bin_no: Column, thresholds: Column) -> Column:
    return F.coalesce(F.get(thresholds, bin_no), F.lit(float("inf")))


def two_decimals(value: Column) -> Column:
    return F.format_string("%.2f", F.round(value, 2))


def bound_text(value: Column) -> Column:
    """Interval ends as in the tree report: four decimals, infinities spelt out."""
    return (
        F.when(value == F.lit(float("inf")), F.lit("Infinity"))
        .when(value == F.lit(float("-inf")), F.lit("-Infinity"))
        .otherwise(F.format_string("%.4f", F.round(value, 4)))
    )


def year_names(threshold: Column, low: int = fixed.MIN_YEAR, high: int = fixed.MAX_YEAR) -> tuple[Column, Column]:
    """Names of both sides of a split on the scaled year, in years."""
    year = F.format_string("%.1f", F.round(threshold * (high - low) + low, 1))
    return F.concat(F.lit("< "), year), F.concat(F.lit("> "), year)


def split_names(kind: Column, threshold: Column) -> tuple[Column, Column]:
    """Names of the two sides of a split by the kind of its variable: ``genre`` and ``item`` read as
    dislike and like, ``year`` as a year, everything else as the bound."""
    opinion = kind.isin("genre", "item")
    low_year, high_year = year_names(threshold)
    text = bound_text(threshold)
    low = F.when(opinion, F.lit("👎")).when(kind == "year", low_year).otherwise(F.concat(F.lit("< "), text))
    high = F.when(opinion, F.lit("👍")).when(kind == "year", high_year).otherwise(F.concat(F.lit("> "), text))
    return low, high
