"""Split thresholds per variable.

At most ``max_bins`` distinct values: the midpoints between them. Otherwise greedy cuts of nearly
equal frequency over the sorted values. The greedy rule only changes state where an interval closes,
which happens about ``2 * max_bins`` times at most, so there are two exact ways to run it:

* ``fold``: the sorted distinct values of a variable in one array and one JVM fold. Used where the
  number of distinct values is below ``fold_limit``, so that the array has a known bound.
* ``seek``: running counts are computed with distributed prefix sums and each closing point is
  looked up as "first value whose running count reaches the target", for all wide variables at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duoscope import fixed
from duoscope.functions import scalars as S
from duoscope.session import collect_bounded, scratch_path

FOLD_LIMIT = 100_000
MAX_VARIABLES = 100_000
MAX_CUTS = 5_000_000


def value_frequencies(rows: DataFrame) -> DataFrame:
    """``(var, v, c)`` over the attribute vectors ``x``; combined map-side before the shuffle."""
    long = rows.select(F.posexplode("x").alias("var", "v"))
    return long.groupBy("var", "v").agg(F.count(F.lit(1)).alias("c"))


def sorted_values(freq: DataFrame) -> DataFrame:
    """Per variable the sorted list of ``(v, c)``; for variables with few distinct values."""
    lists = freq.groupBy("var").agg(F.collect_list(F.struct("v", "c")).alias("vals"))
    return lists.select("var", F.array_sort("vals").alias("vals"))


def midpoints(vals: Column) -> Column:
    return F.transform(
        F.slice(vals, F.lit(2), F.greatest(F.size(vals) - 1, F.lit(0))),
        lambda e, i: (F.get(vals, i)["v"] + e["v"]) / 2,
    )


_STATE = "struct<room:double,start:double,last:double,prev:double,out:array<double>>"


def greedy_cuts(vals: Column, n: Column, max_bins: int = fixed.MAX_BINS) -> Column:
    """Greedy equal-frequency cuts as one fold over the sorted ``(v, c)`` array."""
    want = n.cast("double") / max_bins
    empty = F.lit(None).cast("double")
    first = F.struct(
        want.alias("room"), empty.alias("start"), empty.alias("last"), empty.alias("prev"),
        F.array().cast("array<double>").alias("out"),
    ).cast(_STATE)

    def step(s: Column, e: Column) -> Column:
        start = F.coalesce(s["start"], e["v"])
        left_over = s["room"] - e["c"]
        closes = left_over <= 0
        big = e["c"] > s["room"] * 2
        alone = closes & big & (e["c"] > want)
        carried = closes & big & (e["c"] <= want)
        cut = F.coalesce((s["last"] + start) / 2, start)
        own_cut = F.when(alone & s["prev"].isNotNull(), F.array((s["prev"] + e["v"]) / 2))
        added = F.concat(F.array(cut), F.coalesce(own_cut, F.array().cast("array<double>")))
        return F.struct(
            F.when(~closes, left_over).when(carried, want - e["c"]).otherwise(want).alias("room"),
            F.when(~closes, start).when(carried, e["v"]).alias("start"),
            F.when(closes, e["v"]).otherwise(s["last"]).alias("last"),
            e["v"].alias("prev"),
            F.when(closes, F.concat(s["out"], added)).otherwise(s["out"]).alias("out"),
        ).cast(_STATE)

    def finish(s: Column) -> Column:
        return F.concat(s["out"], F.array(F.coalesce((s["last"] + s["start"]) / 2, s["last"])))

    return F.aggregate(vals, first, step, finish)


def threshold_arrays(values: DataFrame, n: Column, max_bins: int = fixed.MAX_BINS) -> DataFrame:
    few = F.size("vals") <= max_bins
    thr = F.when(few, midpoints(F.col("vals"))).otherwise(greedy_cuts(F.col("vals"), n, max_bins))
    return values.select("var", thr.alias("thr"))


def thresholds(
    rows: DataFrame, max_bins: int = fixed.MAX_BINS, fold_limit: int = FOLD_LIMIT
) -> DataFrame:
    """``(var, thr array<double>)`` for rows with an attribute vector ``x``."""
    freq = value_frequencies(rows).persist()
    try:
        widths = collect_bounded(
            freq.groupBy("var").agg(F.count(F.lit(1)).alias("d"), F.sum("c").alias("n")),
            MAX_VARIABLES, "variables",
        )
        wide = {r["var"]: r["n"] for r in widths if r["d"] > fold_limit}
        n = max((r["n"] for r in widths), default=0)
        narrow = freq.where(~F.col("var").isin(list(wide))) if wide else freq
        # Small from here on: one short array per variable.
        found = collect_bounded(
            threshold_arrays(sorted_values(narrow), F.lit(n), max_bins), MAX_VARIABLES, "variables"
        )
        table = [(r["var"], r["thr"]) for r in found]
        if wide:
            table += seek_cuts(freq.where(F.col("var").isin(list(wide))), wide, max_bins).items()
    finally:
        freq.unpersist()
    return rows.sparkSession.createDataFrame(sorted(table), "var int, thr array<double>")


# -- wide variables ---------------------------------------------------------------------------

def ranked_values(freq: DataFrame, blocks: int = 256) -> DataFrame:
    """``(var, v, c, pos, cum, prev)``: exact ranks, running counts and previous values per variable.

    A window over a whole variable would sort it in one task. Values are distinct, so quantile
    blocks of a variable hold nearly equal numbers of rows; ranks are block offsets plus the rank
    inside the block.
    """
    shares = F.lit([i / blocks for i in range(1, blocks)])
    # Collected once, so that every scan agrees on the block borders.
    cuts = collect_bounded(
        freq.groupBy("var").agg(F.percentile_approx("v", shares, 10 * blocks).alias("cuts")),
        MAX_VARIABLES, "variables",
    )
    if len(cuts) * blocks > MAX_CUTS:  # the broadcast below stays under 40 MB
        return ranked_values(freq, max(2, MAX_CUTS // len(cuts)))
    table = freq.sparkSession.createDataFrame(
        [(r["var"], sorted(set(r["cuts"]))) for r in cuts], "var int, cuts array<double>")
    placed = freq.join(F.broadcast(table), "var").withColumn(
        "block", S.block_of(F.col("v"), F.col("cuts"))).drop("cuts")
    inside = W.partitionBy("var", "block").orderBy("v")
    local = placed.select(
        "var", "block", "v", "c",
        (F.row_number().over(inside) - 1).alias("local_pos"),
        F.sum("c").over(inside.rowsBetween(W.unboundedPreceding, 0)).alias("local_cum"),
        F.lag("v").over(inside).alias("local_prev"),
    )
    ordered = W.partitionBy("var").orderBy("block")  # at most ``blocks`` rows per variable
    earlier = ordered.rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy("var", "block").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("c").alias("m"), F.max("v").alias("top")
    ).select(
        "var", "block",
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("base_pos"),
        F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("base_cum"),
        F.lag("top").over(ordered).alias("prev_top"),
    )
    return local.join(offsets, ["var", "block"]).select(
        "var", "v", "c", (F.col("base_pos") + F.col("local_pos")).cast("int").alias("pos"),
        (F.col("base_cum") + F.col("local_cum")).alias("cum"),
        F.coalesce("local_prev", "prev_top").alias("prev"),
    )


@dataclass
class _Seek:
    """Where one variable stands: counts used up, space left, open start and last closed value."""

    total: int
    room: float
    used: int = 0
    start: float | None = None
    last: float | None = None
    out: list[float] = field(default_factory=list)

    def close_at(self, hit, opens: float, want: float) -> None:
        start = opens if self.start is None else self.start
        before = self.room - (hit["cum"] - hit["c"] - self.used)
        self.out.append(start if self.last is None else (self.last + start) / 2)
        self.start, self.room = None, want
        if hit["c"] > 2 * before:
            if hit["c"] > want:
                if hit["prev"] is not None:
                    self.out.append((hit["prev"] + hit["v"]) / 2)
            else:
                self.start, self.room = hit["v"], want - hit["c"]
        self.last, self.used = hit["v"], hit["cum"]

    def finish(self, opens: float | None) -> None:
        start = opens if self.start is None else self.start
        self.out.append(self.last if start is None else (self.last + start) / 2)


def seek_cuts(freq: DataFrame, totals: dict[int, int], max_bins: int) -> dict[int, list[float]]:
    """Greedy cuts for variables with very many distinct values.

    Each round is one filtered scan that returns at most two rows per variable; the running counts
    are stored in the shared folder, sorted by value so that Parquet statistics skip most of them.
    """
    spark = freq.sparkSession
    path = scratch_path(spark, "running-counts")
    ranked_values(freq).repartitionByRange("var", "v").sortWithinPartitions(
        "var", "v").write.parquet(path)
    table = spark.read.parquet(path).select("var", "v", "c", "cum", "prev")
    state = {v: _Seek(n, n / max_bins) for v, n in totals.items()}
    active = dict(state)
    while active:
        targets = spark.createDataFrame(
            [(v, float(s.used), s.used + s.room) for v, s in active.items()],
            "var int, used double, target double",
        )
        near = table.where(F.col("cum") > min(s.used for s in active.values()))
        row = F.struct("v", "c", "cum", "prev")
        hits = near.join(F.broadcast(targets), "var").groupBy("var").agg(
            F.min(F.when(F.col("cum") > F.col("used"), F.col("v"))).alias("opens"),
            F.min(F.when((F.col("cum") > F.col("used")) & (F.col("cum") >= F.col("target")), row)).alias("hit"),
        )
        found = {r["var"]: r for r in hits.collect()}
        for var, s in list(active.items()):
            r = found.get(var)
            if r is None or r["hit"] is None:
                s.finish(r["opens"] if r else None)
                del active[var]
            else:
                s.close_at(r["hit"], r["opens"], s.total / max_bins)
    return {v: s.out for v, s in state.items()}
