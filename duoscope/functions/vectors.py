"""Mixed vectors: nullable columns ``bin array<boolean>``, ``tri array<tinyint>``, ``num array<double>``.

The dense order is binary, tri-state, numeric. Missing in ``tri`` is the value 0, not null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_VALUES = "array<double>"


def _or_empty(col: Column) -> Column:
    return F.coalesce(col, F.array().cast(NO_VALUES))


def to_dense(bin_col: Column, tri_col: Column, num_col: Column) -> Column:
    return F.concat(
        _or_empty(bin_col.cast(NO_VALUES)),
        _or_empty(tri_col.cast(NO_VALUES)),
        _or_empty(num_col),
    )


def from_dense(dense: Column, n_bin: int, n_tri: int) -> tuple[Column, Column, Column]:
    """Dense values back to blocks; a block of width 0 is null.

    Tri-state: 0 is missing, exactly 1 positive, anything else negative.
    """
    fixed_part = n_bin + n_tri
    bin_col = (
        F.transform(F.slice(dense, 1, n_bin), lambda v: v > 0)
        if n_bin > 0 else F.lit(None).cast("array<boolean>")
    )
    tri_col = (
        F.transform(
            F.slice(dense, n_bin + 1, n_tri),
            lambda v: F.when(v == 0, 0).when(v == 1, 1).otherwise(-1).cast("tinyint"),
        )
        if n_tri > 0 else F.lit(None).cast("array<tinyint>")
    )
    rest = F.size(dense) - F.lit(fixed_part)
    num_col = F.when(rest > 0, F.slice(dense, F.lit(fixed_part + 1), F.greatest(rest, F.lit(0))))
    return bin_col, tri_col, num_col


def block_widths(df: DataFrame, *cols: str) -> DataFrame:
    """One row with the width of every block and whether all rows agree on it."""
    return df.agg(*width_aggregates(*cols))


def width_aggregates(*cols: str) -> list[Column]:
    """The largest and the smallest width of every block."""
    aggs = []
    for c in cols:
        width = F.coalesce(F.size(c), F.lit(0))
        width = F.when(F.col(c).isNull(), 0).otherwise(width)
        aggs += [F.max(width).alias(c), F.min(width).alias(f"{c}_min")]
    return aggs


def nonzero(dense: Column) -> Column:
    """Dense array to sorted ``(pos, value)`` structs of its non-zero values."""
    indexed = F.transform(dense, lambda v, i: F.struct(i.alias("pos"), v.alias("value")))
    return F.filter(indexed, lambda e: e["value"] != 0)


def fill_positions(entries: Column, width: Column, kind: str = "double") -> Column:
    """Array of ``width`` values from sorted ``(pos, value)`` structs with distinct positions, else 0.

    Gaps between consecutive positions are filled, so the cost is linear in the width. ``entries``
    should be a plain column, as it is read for every element. No lambda sits inside another: Spark
    cannot hand such an expression to a Python function.
    """
    n = F.size(entries)
    zero = F.lit(0).cast(kind)

    def piece(e: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(-1)).otherwise(F.get(entries, i - 1)["pos"])
        gap = F.array_repeat(zero, (e["pos"] - before - 1).cast("int"))
        return F.concat(gap, F.array(e["value"].cast(kind)))

    last = F.when(n == 0, F.lit(-1)).otherwise(F.get(entries, n - 1)["pos"])
    tail = F.array_repeat(zero, (width - last - 1).cast("int"))
    return F.concat(F.flatten(F.transform(entries, piece)), tail)


def one_hot(codes: Column, slots: Column) -> Column:
    """Booleans with ``slots[i]`` places for code ``i``."""
    def bits(c: Column, i: Column) -> Column:
        off = F.lit(False)
        after = (F.get(slots, i) - c - 1).cast("int")
        return F.concat(F.array_repeat(off, c), F.array(F.lit(True)), F.array_repeat(off, after))

    return F.flatten(F.transform(codes, bits))


def combinations(maxima: Column) -> Column:
    return F.aggregate(maxima, F.lit(1.0), lambda a, m: a * (m + 1))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


#: So many places of a product are spelt out: Spark compiles that, and interprets functions over arrays.
SPELT_PLACES = 16


def dot_part(a: str, b: str, start: int, n: int) -> Column:
    """dot() of ``n`` places of two columns behind ``start``, added in the same order."""
    if n > SPELT_PLACES:
        return dot(F.slice(a, start + 1, n), F.slice(b, start + 1, n))
    return sum((F.get(a, F.lit(i)) * F.get(b, F.lit(i)) for i in range(start, start + n)), F.lit(0.0))
