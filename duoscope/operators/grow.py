"""Growing the explanation tree level by level.

Every level is one Spark job for all open regions. A row is kept once, with the list of the open regions it is in; that level
table goes from level to level, and a plan reads the last one only, so its size does not grow with the depth. Rows are binned
into one histogram per (region, variable), whose running sums give the best splits. The driver only holds regions and
candidates, never rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duoscope import fixed
from duoscope.operators import splits
from duoscope.operators.thresholds import MAX_VARIABLES, thresholds
from duoscope.session import collect_bounded, cut_lineage

NODE_SCHEMA = (
    "path string, var int, lo double, hi double, rel_size double, data_entropy double"
)
# Bin combinations up to which equal rows are merged first; the tree is the same either way.
COLLAPSE_LIMIT = 5_000_000
# Pairs of rows and splits that are followed at once.
PAIRS = 4_000_000
INF = float("inf")


@dataclass
class Region:
    """One open node of the search: rows with the same filters at the same level."""

    id: int
    entropy: float
    filters: tuple = ()
    candidates: list[Candidate] = field(default_factory=list)
    answer: tuple | None = None


@dataclass
class Candidate:
    """A split with its two children: entropy, share of the parent, and the region below, if open."""

    var: int
    cut: int
    value: float
    entropies: tuple[float, float]
    ratios: tuple[float, float]
    children: list[Region | None] = field(default_factory=lambda: [None, None])


def resolve(region: Region | None, entropy: float):
    """``(resulting entropy, chosen candidate)`` of a region; first candidate wins ties.

    Shared regions answer once.
    """
    if region is None or not region.candidates:
        return entropy, None
    if region.answer is None:
        lowest = INF
        for cand in region.candidates:
            parts = [
                resolve(child, e)[0] * r
                for child, e, r in zip(cand.children, cand.entropies, cand.ratios)
            ]
            total = round(sum(parts), fixed.TIE_DIGITS)
            if total < lowest:
                lowest, region.answer = total, (sum(parts), cand)
    return region.answer


def flatten(region: Region | None, entropy: float, size: float = 1.0, path: str = "",
            edge=(None, -INF, INF)) -> list[tuple]:
    """Node rows of the chosen tree in pre-order."""
    nodes = [(path, edge[0], edge[1], edge[2], size, entropy)]
    _, chosen = resolve(region, entropy)
    if chosen:
        for k, side in enumerate("LR"):
            span = (-INF, chosen.value) if side == "L" else (chosen.value, INF)
            nodes += flatten(chosen.children[k], chosen.entropies[k], size * chosen.ratios[k],
                             path + side, (chosen.var, *span))
    return nodes


def grow_tree(
    rows: DataFrame,
    sizes: DataFrame,
    num_vars: int,
    num_clusters: int,
    max_level: int = fixed.MAX_LEVEL,
    num_candidates: int = fixed.NUM_CANDIDATES,
    max_bins: int = fixed.MAX_BINS,
    min_split_entropy: float = fixed.MIN_SPLIT_ENTROPY,
    strict_bounds: bool = False,
    root_entropy: float | None = None,
    max_regions: int = 20_000,
) -> DataFrame:
    """Tree with lookahead over the best ``num_candidates`` splits per node.

    ``rows`` is ``(x array<double>, u array<int>)``, ``sizes`` is ``(cluster_id, size)``. With the
    default half-open bounds every row is in exactly one child and searches that reach the same
    filters at one level share a region. ``strict_bounds`` drops rows equal to a threshold from
    both children; then regions belong to one path each. ``max_regions`` guards the driver: growing
    stops with an error, never with a smaller search.
    """
    spark = rows.sparkSession
    size_array = F.lit([float(v) for v in _sizes(sizes, num_clusters)])
    rows = rows.select("x", "u").persist()
    try:
        found = thresholds(rows, max_bins)
        thr = [r["thr"] for r in sorted(collect_bounded(found, MAX_VARIABLES, "variables"))]
        thr += [[] for _ in range(num_vars - len(thr))]
        wide = num_vars * num_clusters >= splits.WIDE_FROM
        binned = splits.with_bins(rows, thr)
        base = splits.vote_arrays(binned) if wide else splits.utility_columns(binned, num_clusters)
        combos = math.prod(len(t) + 1 for t in thr)
        if not strict_bounds and combos <= COLLAPSE_LIMIT:
            # Bounded by the number of bin combinations, so all levels read a small table.
            base = splits.collapse(base, num_clusters)
        else:
            base = base.drop(*([] if strict_bounds else ["x"]))
            base = base if wide else base.withColumn("n", F.lit(1))
        level_table = base = cut_lineage(base.withColumn("regions", F.array(F.lit(0))))
        root = Region(0, _root_entropy(base, size_array, num_clusters, root_entropy))
        rows.unpersist()  # the binned table is stored
        open_regions = {0: root}
        num_bins = max((len(t) for t in thr), default=0) + 1
        for level in range(max_level):
            if not open_regions:
                break
            located = level_table.withColumn("region", F.explode("regions")).drop("regions")
            if wide:
                hist = splits.wide_histogram(located, num_clusters, "region", num_vars, num_bins)
            else:
                hist = splits.histogram(located, num_clusters, "region")
            scores = splits.split_scores(
                splits.prefix_counts(hist, num_clusters, "region"), size_array, "region")
            top = splits.top_candidates(
                splits.best_per_variable(scores, "region"), num_candidates, "region")
            picked = collect_bounded(top, max_regions * num_candidates, "split candidates")
            open_regions, step = _advance(
                open_regions, picked, thr, min_split_entropy, strict_bounds,
                last=level == max_level - 1)
            if len(open_regions) > max_regions:
                raise ValueError("too many regions: lower num_candidates or raise max_regions")
            if step and open_regions:
                level_table = cut_lineage(_followed(level_table, step, strict_bounds))
    finally:
        rows.unpersist()
    return spark.createDataFrame(flatten(root, root.entropy), NODE_SCHEMA)


def _sizes(sizes: DataFrame, k: int) -> list[float]:
    by_id = {r["cluster_id"]: r["size"] for r in collect_bounded(sizes, MAX_VARIABLES, "clusters")}
    return [by_id.get(i, 0) for i in range(k)]


def _root_entropy(base: DataFrame, sizes: Column, width: int, given: float | None) -> float:
    if given is not None:
        return given
    from duoscope.functions.scalars import weighted_entropy

    if "votes" in base.columns:
        sums = base.agg(vector_to_array(Summarizer.sum(array_to_vector("votes"))).alias("v"))
        return sums.select(weighted_entropy(F.get("v", F.lit(0)), F.slice("v", 2, width), sizes)).first()[0]
    sums = base.agg(F.sum("n").alias("n"), *[F.sum(f"u{i}").alias(f"u{i}") for i in range(width)])
    pos = F.array(*[F.col(f"u{i}") for i in range(width)])
    return sums.select(weighted_entropy(F.col("n"), pos, sizes)).first()[0]


def _followed(level_table: DataFrame, step: list[tuple], strict: bool) -> DataFrame:
    """The level table of the next level: every row follows the splits of its regions; rows in no open region go.

    ``step`` has ``(region, var, cut, value, left, right)``; it is as small as what the driver holds of a level.
    """
    ordered = sorted(step, key=lambda r: r[0])
    region, var, cut = (np.array([r[i] for r in ordered], np.int64) for i in (0, 1, 2))
    value = np.array([r[3] for r in ordered], float)
    left, right = (np.array([-1 if r[i] is None else r[i] for r in ordered], np.int64) for i in (4, 5))
    first = np.searchsorted(region, np.arange(int(region[-1]) + 2))
    shared = level_table.sparkSession.sparkContext.broadcast((var, cut, value, left, right, first))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        var, cut, value, left, right, first = shared.value
        splits_of = np.diff(first)
        for batch in batches:
            at = 0
            lengths = pc.list_value_length(batch.column("regions")).to_numpy()
            ends = np.cumsum(lengths)
            most = max(1, PAIRS // max(1, int(splits_of.max())))
            while at < batch.num_rows:  # few enough regions at once
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
                yield from moved(batch.slice(at, stop - at), splits_of, var, cut, value, left, right, first)
                at = stop

    def moved(batch, splits_of, var, cut, value, left, right, first) -> Iterator[pa.RecordBatch]:
        held = batch.column("regions")
        region = held.flatten().to_numpy()
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(held).to_numpy())
        known = region < len(splits_of)
        region, row = region[known], row[known]
        count = splits_of[region]
        row = np.repeat(row, count)
        split = np.repeat(first[region] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        if strict:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)[row, var[split]]
            target = np.where(x < value[split], left[split], np.where(x > value[split], right[split], -1))
        else:
            bins = batch.column("bins").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)[row, var[split]]
            target = np.where(bins <= cut[split], left[split], right[split])
        row, target = row[target >= 0], target[target >= 0]
        count = np.bincount(row, minlength=batch.num_rows)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(target.astype(np.int32)))
        out = batch.set_column(batch.schema.get_field_index("regions"), "regions", lists).filter(pa.array(count > 0))
        if out.num_rows:
            yield out

    return level_table.mapInArrow(follow, level_table.schema)


def _advance(open_regions, picked, thr, min_split_entropy, strict, last):
    """Attach candidates to their regions and open the regions of the next level."""
    next_regions, by_filter, step = {}, {}, []
    for p in sorted(picked, key=lambda p: (p["region"], p["rank"])):
        parent = open_regions[p["region"]]
        # The gate of the search: only splits that lower the node's entropy.
        if not p["we"] < round(parent.entropy, fixed.TIE_DIGITS):
            continue
        cand = Candidate(p["var"], p["bin"], thr[p["var"]][p["bin"]],
                         (p["left_we"], p["right_we"]), (p["left_ratio"], p["right_ratio"]))
        parent.candidates.append(cand)
        if last:
            continue
        targets = [None, None]
        for k, entropy in enumerate(cand.entropies):
            if entropy <= min_split_entropy:
                continue
            key = _narrow(parent.filters, cand.var, cand.cut, k)
            if strict:
                key = (parent.id, p["rank"], k, key)
            region = by_filter.get(key)
            if region is None:
                region = Region(len(by_filter), entropy, key[3] if strict else key)
                by_filter[key] = next_regions[region.id] = region
                targets[k] = region.id  # this path alone carries the rows
            cand.children[k] = region
        if targets != [None, None]:
            step.append((parent.id, cand.var, cand.cut, cand.value, *targets))
    return next_regions, step


def _narrow(filters: tuple, var: int, cut: int, side: int) -> tuple:
    """Canonical filters: one bin interval per variable, sorted by variable."""
    spans = {v: (lo, hi) for v, lo, hi in filters}
    lo, hi = spans.get(var, (-1, 1 << 15))
    spans[var] = (lo, min(hi, cut)) if side == 0 else (max(lo, cut), hi)
    return tuple((v, a, b) for v, (a, b) in sorted(spans.items()))
