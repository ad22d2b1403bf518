"""Learning the utility function by gradient descent.

The matrices live on the driver and go out as broadcasts; per step one job returns the summed gradient. Entities are sparse
vectors: zero bits and missing states cost nothing. Minibatches are drawn by keys, for many steps in one scan of the ids, and
joined with the entity vectors once. A batch of all rows never meets a vector: dyads carry projections and are summed per entity
first. Grid points share the minibatches and the jobs: a step computes the gradients of all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duoscope import fixed
from duoscope.functions import scalars as S
from duoscope.functions import vectors as V
from duoscope.operators import csr, sample
from duoscope.operators.joins import grown, join_sides
from duoscope.operators.project import UtilityModel
from duoscope.session import collect_bounded, cut_lineage, scratch_path

Matrices = dict[int, tuple[np.ndarray, np.ndarray]]
NO_PROGRESS = 1e-5
NO_PROGRESS_STEPS = 10
#: Minibatches of at most so many rows send the ids of their entities to all tasks; more of them are merged with whole tables.
FEW_DRAWN = 100_000


@dataclass(frozen=True)
class Settings:
    k: int = fixed.SUBSPACE_DIMENSION
    reg: float = fixed.REGULARISATION
    l0: float = fixed.LEARNING_RATE_START
    speed: float = fixed.LEARNING_RATE_SPEED


@dataclass
class _Run:
    settings: Settings
    w: np.ndarray
    v: np.ndarray
    idle: int = 0
    open: bool = True
    failed: bool = False


def with_vectors(dyads: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """``(…, x_pos, x_val, y_pos, y_val, label)`` from id dyads and the two entity tables."""
    left = csr.of_dense(users, "user_id").toDF("user_id", "x_pos", "x_val")
    right = csr.of_dense(items, "item_id").toDF("item_id", "y_pos", "y_val")
    return join_sides(dyads, left, right)


# -- gradients --------------------------------------------------------------------------------

_PARTIAL = "model int, side string, row int, n double, total array<double>"


def _partial_rows(sums: dict[tuple[int, str], np.ndarray], n: float) -> Iterator[pa.RecordBatch]:
    for (model, side), g in sums.items():
        k = len(g)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model] * k, pa.int32()), pa.array([side] * k), pa.array(range(k), pa.int32()), pa.array([float(n)] * k), csr.lists(g)],
            ["model", "side", "row", "n", "total"])


def _summed(partial: DataFrame) -> DataFrame:
    """An element-wise sum in the JVM of what the tasks return."""
    return partial.groupBy("model", "side", "row").agg(
        F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total"))


def batch_gradients(examples: DataFrame, models: Matrices, lam: float = fixed.LAMBDA, shared: Broadcast | None = None) -> DataFrame:
    """Summed gradient rows ``(model, side, row, n, total)`` over examples that carry both vectors.

    Examples are ``(x_pos, x_val, y_pos, y_val, label)`` or, dense, ``(x, y, label)``. One partial sum per task and matrix row.
    ``shared``: the models as a broadcast that the caller releases.
    """
    shared = shared or examples.sparkSession.sparkContext.broadcast(models)
    if "x" in examples.columns:
        both = examples.select(*[V.nonzero(F.col(c)).alias(c) for c in "xy"], "label")
        examples = both.select(*[F.col(f"{c}.{e}").alias(f"{c}_{n}") for c in "xy" for e, n in (("pos", "pos"), ("value", "val"))], "label")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, str], np.ndarray] = {}
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            n += b.num_rows
            z = np.where(b.column("label").to_numpy(zero_copy_only=False).astype(bool), 1.0, -1.0)
            for m, (w, v) in shared.value.items():
                x = csr.Batch(b.column("x_pos"), b.column("x_val"), w.shape[1], True)
                y = csr.Batch(b.column("y_pos"), b.column("y_val"), v.shape[1], True)
                px, py = x.times(w), y.times(v)
                s = 1.0 / (1.0 + np.exp(-z * (px * py).sum(axis=1) / lam))
                f = (-z * (1.0 - s) / lam)[:, None]
                for side, g in (("W", x.outer_sum(f * py)), ("V", y.outer_sum(f * px))):
                    sums[m, side] = sums.get((m, side), 0.0) + g
        # Arrow would turn NaN into null; infinity means "no model" as well
        yield from _partial_rows({key: np.nan_to_num(g, nan=np.inf) for key, g in sums.items()}, n)

    return _summed(examples.select("x_pos", "x_val", "y_pos", "y_val", "label").mapInArrow(partial, _PARTIAL))


def entity_gradients(dyads: DataFrame, users: DataFrame, items: DataFrame, models: Matrices, lam: float = fixed.LAMBDA) -> DataFrame:
    """The same sums over all dyads in one scan of them and without a vector per dyad.

    Σ f·Py ⊗ x over dyads equals Σ over users of (Σ f·Py) ⊗ x. Every dyad, with the two projections, adds to one sum of k values
    for its user and one for its item; one aggregation keyed by (side, entity) holds both and the counts. Each entity's vector
    then meets its sum once.
    """
    names = list(models)
    ks = [len(models[m][0]) for m in names]
    starts = np.cumsum([0, *ks]).tolist()
    w, v = (np.vstack([models[m][side] for m in names]) for side in (0, 1))
    left, right = csr.of_dense(users, "user_id"), csr.of_dense(items, "item_id")
    both = join_sides(
        dyads.select("user_id", "item_id", "label"),
        left.select("user_id", csr.projection(F.col("pos"), F.col("val"), w, True).alias("px")),
        right.select("item_id", csr.projection(F.col("pos"), F.col("val"), v, True).alias("py")))
    z = F.when(F.col("label"), 1.0).otherwise(-1.0)

    def own(side: str, i: int) -> Column:
        return F.slice(side, starts[i] + 1, ks[i])

    factors = [-z * (1 - S.sigmoid(z * V.dot_part("px", "py", starts[i], ks[i]), lam)) / lam for i in range(len(names))]
    both = both.select("*", *[f.alias(f"f{i}") for i, f in enumerate(factors)])

    def times(factor: Column, values: Column) -> Column:
        return F.transform(values, lambda v: factor * v)

    def scaled(side: str) -> Column:
        return F.concat(*[times(F.col(f"f{i}"), own(side, i)) for i in range(len(names))])

    kind = "string" if left.schema["user_id"].dataType != right.schema["item_id"].dataType else None

    def key(name: str) -> Column:
        return F.col(name).cast(kind) if kind else F.col(name)

    sides = F.explode(F.array(
        F.struct(F.lit("W").alias("side"), key("user_id").alias("id"), scaled("py").alias("g")),
        F.struct(F.lit("V").alias("side"), key("item_id").alias("id"), scaled("px").alias("g")))).alias("s")
    sums = both.select(sides).select("s.*").groupBy("side", "id").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.get("g", F.lit(r))) for r in range(starts[-1])]).alias("g"))
    entities = left.select(F.lit("W").alias("side"), key("user_id").alias("id"), "pos", "val").unionByName(
        right.select(F.lit("V").alias("side"), key("item_id").alias("id"), "pos", "val"))
    widths = {"W": w.shape[1], "V": v.shape[1]}

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {side: np.zeros((starts[-1], width)) for side, width in widths.items()}
        n = dict.fromkeys(widths, 0)
        for b in batches:
            for side, width in widths.items():
                rows = b.filter(pc.equal(b.column("side"), side))
                if rows.num_rows:
                    g = rows.column("g").flatten().to_numpy(zero_copy_only=False).reshape(-1, starts[-1])
                    total[side] += csr.Batch(rows.column("pos"), rows.column("val"), width, True).outer_sum(g)
                    n[side] += pc.sum(rows.column("n")).as_py()
        for side in widths:
            if n[side]:
                parts = np.nan_to_num(total[side], nan=np.inf)
                yield from _partial_rows({(m, side): parts[a:a + k] for m, a, k in zip(names, starts, ks)}, n[side])

    return _summed(sums.join(grown(entities), ["side", "id"]).select("side", "n", "g", "pos", "val").mapInArrow(partial, _PARTIAL))


def entity_gradient(dyads: DataFrame, users: DataFrame, items: DataFrame, model: UtilityModel) -> DataFrame:
    """Mean gradient of one model as cells ``(side, row, col, value)``."""
    rows = entity_gradients(dyads, users, items, {0: (model.w, model.v)}, model.lam)
    cells = rows.select("side", "row", "n", F.posexplode("total").alias("col", "g"))
    return cells.select("side", "row", "col", (F.col("g") / F.col("n")).alias("value"))


def stepped(matrix: np.ndarray, gradient: np.ndarray, rate: float, reg: float) -> np.ndarray:
    """One descent step; regularisation is scaled by the matrix size."""
    return matrix - rate * (gradient + 2.0 * reg / np.sqrt(matrix.size) * matrix)


# -- training -----------------------------------------------------------------------------------

def width_of(table: DataFrame) -> int:
    """Length of a vector: of the first dense one, else the largest position that is used."""
    if "vec" in table.columns:
        return table.select(F.size("vec")).first()[0]
    last = table.agg(F.max(F.array_max("pos"))).first()[0]
    return 0 if last is None else last + 1


def learn_many(
    dyads: DataFrame, users: DataFrame, items: DataFrame, settings: list[Settings],
    max_iterations: int = fixed.MAX_ITERATIONS, minibatch: float | None = fixed.MINIBATCH_SIZE,
    data_size: int | None = None, seed: int = 0, lam: float = fixed.LAMBDA,
    start: list[tuple[np.ndarray, np.ndarray]] | None = None, widths: tuple[int, int] | None = None,
) -> list[UtilityModel | None]:
    """One model per setting; ``None`` where the numbers ran away.

    Runs ``max_iterations - 1`` steps at most and stops a model after ten steps in a row whose gradient is close to zero. Dyads
    without an encoded entity are left out before anything is drawn. ``minibatch``: dyads that a step takes on average; ``None``: all
    of them. ``start``: the matrices to start from, bias column last;
    random ones by default. ``widths``: length of user and item vectors, needed where sparse vectors leave places unused.
    """
    d_left, d_right = (w + 1 for w in (widths or (width_of(users), width_of(items))))
    runs = []
    for i, s in enumerate(settings):
        rng = np.random.default_rng([seed, i])
        w, v = start[i] if start else (rng.random((s.k, d_left)) - 0.5, rng.random((s.k, d_right)) - 0.5)
        if w.shape != (s.k, d_left) or v.shape != (s.k, d_right):
            raise ValueError(f"start matrices of {w.shape} and {v.shape}, not {(s.k, d_left)} and {(s.k, d_right)}")
        runs.append(_Run(s, np.array(w, float), np.array(v, float)))
    users, items = csr.of_dense(users, "user_id"), csr.of_dense(items, "item_id")
    ids = dyads.select("user_id", "item_id", "label").join(grown(items.select("item_id")), "item_id", "left_semi")
    ids = ids.join(grown(users.select("user_id")), "user_id", "left_semi").select("user_id", "item_id", "label")
    # a table and no checkpoint, which is rows as they lie in memory: several times as large and slower to write and read
    path = scratch_path(ids.sparkSession, "dyads")
    sample.numbered(ids).write.parquet(path)
    ids = ids.sparkSession.read.parquet(path)
    fraction = 1.0 if minibatch is None else min(1.0, minibatch / max(ids.count() if data_size is None else data_size, 1))
    steps = list(range(1, max_iterations))
    batches = _Batches(ids, users, items, fraction, steps, seed)
    try:
        for t in steps:
            models = {i: (r.w, r.v) for i, r in enumerate(runs) if r.open}
            if not models:
                break
            rows = collect_bounded(batches.gradients(t, models, lam), sum(2 * len(w) for w, _ in models.values()), "gradient rows")
            table = {(r["model"], r["side"], r["row"]): (r["n"], r["total"]) for r in rows}
            if not table:  # there are no encoded dyads: nothing can be learned
                break
            for i in models:
                _update(runs[i], i, table, t)
    finally:
        batches.release()
    return [None if r.failed else UtilityModel(r.w, r.v, lam, True, True) for r in runs]


def _update(run: _Run, i: int, table: dict, t: int) -> None:
    def mean(side: str) -> np.ndarray:
        return np.array([np.array(total) / n for n, total in
                         (table[i, side, row] for row in range(run.settings.k))])

    gw, gv = mean("W"), mean("V")
    progress = np.abs(gw).sum()
    if not np.isfinite(progress):
        run.open, run.failed = False, True
        return
    run.idle = run.idle + 1 if progress < NO_PROGRESS else 0
    rate = run.settings.l0 / (1 + run.settings.speed * (t - 1))
    run.w = stepped(run.w, gw, rate, run.settings.reg)
    run.v = stepped(run.v, gv, rate, run.settings.reg)
    run.open = run.idle < NO_PROGRESS_STEPS


class _Batches:
    """The rows of each step. A batch of everything is summed per entity. Smaller ones are drawn for as many steps at once as
    together take about all rows, so that what is stored never exceeds the data; an empty draw goes on to a later number."""

    def __init__(self, ids: DataFrame, users: DataFrame, items: DataFrame, fraction: float, steps: list[int], seed: int):
        self.ids, self.users, self.items, self.fraction, self.steps, self.seed = ids, users, items, fraction, steps, seed
        self.held: DataFrame | None = None
        self.first = self.last = 0

    def gradients(self, t: int, models: Matrices, lam: float) -> DataFrame:
        if self.fraction >= 1.0:
            return entity_gradients(self.ids, self.users, self.items, models, lam)
        if not self.first <= t < self.last:
            self._draw(t)
        return batch_gradients(self.held.where(F.col("step") == t), models, lam)

    def _draw(self, t: int) -> None:
        self.release()
        together = max(1, int(1 / self.fraction))
        self.first, self.last = t, min(t + together, self.steps[-1] + 1)
        missing, drawn, tries = list(range(self.first, self.last)), None, 0
        while missing and tries < 100:
            shift = tries * (self.steps[-1] + 1)
            rows = sample.minibatches(self.ids, self.fraction, [s + shift for s in missing], self.seed)
            rows = cut_lineage(rows.withColumn("step", F.col("step") - shift))
            have = {r["step"] for r in rows.select("step").distinct().collect()}
            drawn = rows if drawn is None else drawn.unionByName(rows)
            missing = [s for s in missing if s not in have]
            tries += 1 if not self.ids.isEmpty() else 100
        self.held = cut_lineage(with_vectors(drawn, *self._met(drawn))).persist()

    def _met(self, drawn: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Users and items of the drawn rows. Where these are few, entities are looked for where they lie: no vector that no
        row needs is shuffled, and the rows of a step stay in few partitions, each of which returns sums as wide as the model."""
        if drawn.limit(FEW_DRAWN + 1).count() > FEW_DRAWN:
            return self.users, self.items
        users, items = (side.join(F.broadcast(drawn.select(key).distinct()), key, "left_semi")
                        for side, key in ((self.users, "user_id"), (self.items, "item_id")))
        return users, items

    def release(self) -> None:
        if self.held is not None:
            self.held.unpersist()
            self.held = None


def learn(dyads: DataFrame, users: DataFrame, items: DataFrame, settings: Settings | None = None,
          **kwargs) -> UtilityModel | None:
    return learn_many(dyads, users, items, [settings or Settings()], **kwargs)[0]


# -- evaluation ---------------------------------------------------------------------------------

def hit_rate(scored: DataFrame) -> DataFrame:
    """Share of dyads whose prediction equals the outcome."""
    hit = S.predict(F.col("utility")) == F.col("label")
    return scored.agg(F.avg(hit.cast("double")).alias("hit_rate"))


def hit_rates(dyads: DataFrame, users: DataFrame, items: DataFrame, models: dict[int, UtilityModel],
              parts: dict[str, Column] | None = None) -> DataFrame:
    """``(model, hit_rate, n)`` of many models in one pass: entities are projected once for all of them.

    ``parts``: conditions on the dyads by name. Instead of ``hit_rate`` there is then a rate of that name over the dyads of each.
    """
    names = list(models)
    ks = [len(models[i].w) for i in names]
    starts = np.cumsum([0, *ks]).tolist()
    first = models[names[0]]
    left, right = csr.of_dense(users, "user_id"), csr.of_dense(items, "item_id")
    w, v = np.vstack([models[i].w for i in names]), np.vstack([models[i].v for i in names])
    parts = parts or {"hit_rate": F.lit(True)}
    both = join_sides(
        dyads.select("user_id", "item_id", "label", *[c.alias(f"in_{part}") for part, c in parts.items()]),
        left.select("user_id", csr.projection(F.col("pos"), F.col("val"), w, first.biased_left).alias("px")),
        right.select("item_id", csr.projection(F.col("pos"), F.col("val"), v, first.biased_right).alias("py")))
    hits = []
    for i, name in enumerate(names):
        utility = S.sigmoid(V.dot_part("px", "py", starts[i], ks[i]), models[name].lam)
        hits.append((S.predict(utility) == F.col("label")).cast("double").alias(f"hit{i}"))
    rates = [F.array(*[F.avg(F.when(F.col(f"in_{part}"), F.col(f"hit{i}"))) for i in range(len(names))]).alias(part) for part in parts]
    shares = both.select(*[f"in_{part}" for part in parts], *hits).agg(F.count(F.lit(1)).alias("n"), *rates)
    return shares.select(F.posexplode(F.arrays_zip(*parts)).alias("at", "r"), "n").select(
        F.get(F.lit(names), F.col("at")).cast("int").alias("model"), "r.*", "n")


@dataclass
class GridResult:
    model: UtilityModel
    settings: Settings
    hit_rate: float
    table: DataFrame


def grid(ks=fixed.GRID_K, regs=fixed.GRID_REG, l0s=fixed.GRID_L0, speeds=fixed.GRID_SPEED) -> list[Settings]:
    return [Settings(k, r, l0, sp) for k in ks for r in regs for l0 in l0s for sp in speeds]


def learn_tuned(dyads: DataFrame, users: DataFrame, items: DataFrame, points: list[Settings] | None = None,
                minibatch: float | None = fixed.MINIBATCH_SIZE, max_iterations: int = fixed.MAX_ITERATIONS,
                seed: int = 0, train_share: float = 1.0, start: list[tuple[np.ndarray, np.ndarray]] | None = None,
                widths: tuple[int, int] | None = None) -> GridResult:
    """Grid search scored by the hit rate on a 30% test part; the first best point wins.

    ``table`` has one row per grid point with the hit rates on the test part and on the training part, or on a ``train_share``
    of the latter drawn by keys: both in one pass over the dyads.
    """
    points = points or grid()
    keys = ["user_id", "item_id"]
    train, _ = sample.split(dyads, keys, 0.7, seed)
    models = learn_many(train, users, items, points, max_iterations, minibatch, seed=seed, start=start, widths=widths)
    alive = {i: m for i, m in enumerate(models) if m is not None}
    if not alive:
        raise ValueError("no grid point gave a stable model")
    known = sample.first_part(keys, 0.7, seed)
    if train_share < 1.0:
        dyads = dyads.where(~known | sample.first_part(keys, train_share, seed + 1))
    rates = hit_rates(dyads, users, items, alive, {"hit_rate": ~known, "train_hit_rate": known}).drop("n")
    spark = dyads.sparkSession
    meta = spark.createDataFrame(
        [(i, p.k, p.reg, p.l0, p.speed) for i, p in enumerate(points)],
        "model int, k int, reg double, l0 double, speed double")
    table = cut_lineage(meta.join(rates, "model", "left"))
    best = top_grid(table).first()
    return GridResult(alive[best["model"]], points[best["model"]], best["hit_rate"], table)


def top_grid(table: DataFrame) -> DataFrame:
    return table.orderBy(F.desc_nulls_last("hit_rate"), "model").limit(1)
