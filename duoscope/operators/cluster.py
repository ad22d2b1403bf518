"""Clustering of entities, and labelling each side by the clusters of the other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duoscope import fixed
from duoscope.functions import scalars as S
from duoscope.operators import csr, halfspace
from duoscope.operators.project import BLOCK_CELLS, MODEL_LIMIT, UtilityModel, once
from duoscope.session import collect_bounded, spread
from duoscope.sources import tables

MAX_CLUSTERS = 100_000
#: Rows of projections that are worked on together.
JOINED_ROWS = 32_768


def kmeans(entities: DataFrame, vec: str = "vec", k: int = fixed.NUM_CLUSTERS,
           iterations: int = fixed.CLUSTER_ITERATIONS, seed: int = 0) -> KMeansModel:
    return fit(entities.select(array_to_vector(vec).alias("features")), k, iterations, seed)


def fit(vectors: DataFrame, k: int, iterations: int, seed: int) -> KMeansModel:
    """KMeans on ML vectors ``features``, sparse or dense."""
    data = spread(vectors.select("features")).persist()
    try:
        return KMeans(k=k, maxIter=iterations, seed=seed).fit(data)
    finally:
        data.unpersist()


def features(entities: DataFrame, side: str, model: UtilityModel | None = None, width: int | None = None) -> DataFrame:
    """Entities with ``features`` to cluster: their projections, or their own vectors, which stay sparse if they are."""
    if model is not None:
        mapped = model.map_left(entities) if side == "left" else model.map_right(entities)
        return mapped.withColumn("features", array_to_vector("proj"))
    if "vec" in entities.columns:
        return entities.withColumn("features", array_to_vector("vec"))
    return tables.sparse_vectors(entities, width)


def cluster_side(entities: DataFrame, side: str, model: UtilityModel | None = None,
                 k: int = fixed.NUM_CLUSTERS, iterations: int = fixed.CLUSTER_ITERATIONS,
                 seed: int = 0, width: int | None = None) -> tuple[KMeansModel, DataFrame]:
    """KMeans on projected entities (with a utility function) or on their vectors; model and cluster sizes.

    Entities are dense (``vec``) or sparse (``pos, val`` of vectors of ``width`` places).
    """
    vectors = features(entities, side, model, width)
    fitted = fit(vectors, k, iterations, seed)
    return fitted, cluster_counts(fitted.transform(vectors), "prediction")


def cluster_counts(assigned: DataFrame, col: str = "cluster_id") -> DataFrame:
    return assigned.groupBy(F.col(col).alias("cluster_id")).agg(F.count(F.lit(1)).alias("size"))


def centroids(rows: DataFrame, width: int, vec: str = "vec", label: str = "label") -> DataFrame:
    """Mean vector per label: ``(cluster_id, center)``."""
    means = [F.avg(F.get(vec, F.lit(i)).cast("double")) for i in range(width)]
    return rows.groupBy(F.col(label).alias("cluster_id")).agg(F.array(*means).alias("center"))


def center_matrix(centers: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Cluster ids and centers in id order; model-sized."""
    found = sorted((r["cluster_id"], r["center"]) for r in collect_bounded(centers, MAX_CLUSTERS, "clusters"))
    return np.array([i for i, _ in found]), np.array([c for _, c in found], dtype=float)


def assign(vec: Column, ids: np.ndarray, centers: np.ndarray) -> Column:
    """Id of the nearest center; the lower id wins ties."""
    @F.arrow_udf("int")
    def nearest(x: pa.Array) -> pa.Array:
        rows = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(x), -1)
        d = (rows**2).sum(axis=1)[:, None] - 2.0 * rows @ centers.T + (centers**2).sum(axis=1)
        return pa.array(ids[d.argmin(axis=1)].astype("int32"))

    return once(nearest)(vec)


def label_entities(entities: DataFrame, side: str, model: UtilityModel, opposite: np.ndarray) -> DataFrame:
    """Entities with ``u``, 0/1 per opposite cluster; a dense ``vec`` is called ``x``, sparse ones stay ``pos, val``.

    Centers are already in projected space; every entity is projected once and compared with all of
    them in one matrix product per batch.
    """
    mapped = model.map_left(entities) if side == "left" else model.map_right(entities)
    labelled = mapped.withColumn("u", model.likes(F.col("proj"), opposite)).drop("proj")
    return labelled.withColumnRenamed("vec", "x") if "vec" in entities.columns else labelled


class Predictions:
    """Every user against every popular item, in blocks of users: never a (user, item) pair as a row, nor a dense vector.

    ``popular`` is ``(idx, vec)`` with ``vec`` null for items without one, or ``(idx, pos, val)``. ``known`` are the positions of the
    items with a vector, ``width`` counts all. The projected items are model-sized, as user vectors have a place for each; they go out
    as one matrix. What is wanted of a block is made of its likes at once: lists of positions of all users are as large as the
    product of both sides, and to hand them to another Python function would queue and copy them in whole batches.
    """

    def __init__(self, users: DataFrame, popular: DataFrame, model: UtilityModel):
        self.model, self.width = model, popular.count()
        if self.width * len(model.v) > MODEL_LIMIT:
            raise ValueError(f"popular items: {self.width} projections are more than {MODEL_LIMIT} values, too many for the driver")
        given = "pos" if "pos" in popular.columns else "vec"
        # whole columns: a Python object per value takes far more memory than the matrix
        table = model.map_right(popular.where(F.col(given).isNotNull())).select("idx", "proj").toArrow().combine_chunks()
        at = table["idx"].to_numpy().astype(np.int32)
        flat = [c.flatten() for c in table["proj"].chunks]
        matrix = np.concatenate([f.to_numpy(zero_copy_only=False) for f in flat] or [np.zeros(0)]).reshape(len(at), -1)
        order = np.lexsort((*matrix.T[::-1], at)) if len(np.unique(at)) < len(at) else np.argsort(at)
        self.at, self.matrix = at[order], np.ascontiguousarray(matrix[order])
        # k values per user are shuffled to spread work that grows with the number of popular items
        self.mapped = spread(model.map_left(users).select("user_id", "proj"), "user_id")

    @property
    def known(self) -> list[int]:
        return self.at.tolist()

    def _made(self, shared: object, block: Callable[[object, np.ndarray], Iterator[tuple[int, int, list[pa.Array]]]], columns: str) -> DataFrame:
        """``user_id`` and what ``block`` makes of the projections of some users, piece by piece as (first, last, columns)."""
        kind = self.mapped.schema["user_id"].dataType.simpleString()
        sent = self.mapped.sparkSession.sparkContext.broadcast(shared)
        names = ["user_id", *(c.split()[0] for c in columns.split(", "))]

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for some in _joined(batches):
                proj = some.column("proj").flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1)
                for start, end, made in block(sent.value, proj):
                    yield pa.RecordBatch.from_arrays([some.column("user_id").slice(start, end - start), *made], names)

        return self.mapped.mapInArrow(code, f"user_id {kind}, {columns}")

    def _of_likes(self, shared: object, made: Callable[[object, np.ndarray], list[pa.Array]], columns: str) -> DataFrame:
        model = _lambda_of(self.model)

        def block(both: tuple[np.ndarray, object], proj: np.ndarray) -> Iterator[tuple[int, int, list[pa.Array]]]:
            matrix, own = both
            step = max(1, BLOCK_CELLS // max(1, len(matrix)))
            for start in range(0, len(proj), step):
                end = min(start + step, len(proj))
                likes = model.over_half(proj[start:end], matrix) if len(matrix) else np.zeros((end - start, 0), bool)
                yield start, end, made(own, likes)

        return self._made((self.matrix, shared), block, columns)

    def liked(self) -> DataFrame:
        """``(user_id, liked)``: the positions of the items that a user should like."""
        return self._of_likes(self.at, lambda at, likes: [_positions(at, likes)], "liked array<int>")

    def counts(self) -> DataFrame:
        """``(user_id, n)``: how many items a user should like. Boxes of items on one side of a user count as a whole."""
        model = _lambda_of(self.model)

        def block(boxes: dict[str, object], proj: np.ndarray) -> Iterator[tuple[int, int, list[pa.Array]]]:
            yield 0, len(proj), [pa.array(halfspace.counts(boxes, proj, model))]

        return self._made(halfspace.boxes(self.matrix), block, "n bigint")

    def spelt(self, marks: tuple[list[str], list[str]], between: str, opposite: np.ndarray | None = None) -> DataFrame:
        """``(user_id, text)``: the vector of a user as in spelt(); with ``opposite`` also ``u``, the labels of label_predicted()."""
        label = None if opposite is None else _labels(self.model, self.known, opposite)

        def made(shared: tuple[pa.Array, np.ndarray], likes: np.ndarray) -> list[pa.Array]:
            table, at = shared
            return [_texts(table, likes), *([label(_positions(at, likes))] if label else [])]

        return self._of_likes((_marked(marks, between), self.at), made, "text string" + (", u array<int>" if label else ""))


def _lambda_of(model: UtilityModel) -> UtilityModel:
    """What of a model decides between projections, without its matrices."""
    return UtilityModel(np.zeros((0, 0)), np.zeros((0, 0)), model.lam)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of projections, small ones put together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= JOINED_ROWS:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _positions(at: np.ndarray, likes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(likes.sum(axis=1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(at[np.nonzero(likes)[1]]))


def _marked(marks: tuple[list[str], list[str]], between: str) -> pa.Array:
    """Per known position its mark where liked and that where not, with what is between marks before them."""
    return pa.array([(between if i else "") + mark for i, both in enumerate(zip(*marks, strict=True)) for mark in both], pa.string())


def _texts(table: pa.Array, likes: np.ndarray) -> pa.Array:
    """One text per row of ``likes``: its marks lie one after another in what is taken from the table."""
    n, width = likes.shape
    if not width:
        return pa.array([""] * n, pa.string())
    at = np.arange(0, 2 * width, 2, dtype=np.int32) + ~likes
    taken = table.take(pa.array(at.ravel()))
    ends = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset:taken.offset + n * width + 1:width]
    return pa.StringArray.from_buffers(n, pa.py_buffer(np.ascontiguousarray(ends)), taken.buffers()[2])


def predicted_users(users: DataFrame, popular: DataFrame, model: UtilityModel) -> tuple[DataFrame, list[int], int]:
    """Users coded by predictions: ``(user_id, liked)``, the positions of the popular items they should like.

    Their vector is +1 there, -1 at the other known positions (the second result) and 0 where a popular item has no vector; its
    width is the third.
    """
    predicted = Predictions(users, popular, model)
    return predicted.liked(), predicted.known, predicted.width


def spelt(liked: Column, known: list[int], width: int, marks: tuple[list[str], list[str]], between: str) -> Column:
    """The vector of a predicted user as one text: per known position its first mark where liked, else its second one.

    ``liked`` holds positions of ``known``. Users times popular items are written, so a row is a look-up of bytes, in blocks of rows,
    and no value of it an object. Marks are ASCII.
    """
    table = _marked(marks, between)
    place = np.full(width, -1, np.int64)
    place[known] = np.arange(len(known))

    @F.arrow_udf("string")
    def text(positions: pa.Array) -> pa.Array:
        lengths = pc.list_value_length(positions).to_numpy(zero_copy_only=False)
        at, starts = place[positions.flatten().to_numpy()], np.concatenate([[0], np.cumsum(lengths)])
        step = max(1, BLOCK_CELLS // max(1, len(known)))
        out = []
        for a in range(0, len(lengths), step):
            b = min(a + step, len(lengths))
            likes = np.zeros((b - a, len(known)), bool)
            likes[np.repeat(np.arange(b - a), lengths[a:b]), at[starts[a]:starts[b]]] = True
            out.append(_texts(table, likes))
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    return once(text)(liked)


def _labels(model: UtilityModel, known: list[int], opposite: np.ndarray) -> Callable[[pa.Array], pa.Array]:
    """From liked positions to 0/1 per opposite cluster: with +1 there and -1 at the other known positions, W·x is twice the sum of
    the liked columns minus that of all known ones."""
    w, bias, decides = model.w, model.biased_left, _lambda_of(model)
    constant = w[:, known].sum(axis=1)

    def label(liked: pa.Array) -> pa.Array:
        twos = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(liked).to_numpy())]).astype(np.int32)),
                                        pa.array(np.full(len(liked.flatten()), 2.0)))
        proj = csr.Batch(liked, twos, w.shape[1], bias).times(w) - constant
        return csr.lists(decides.over_half(proj, opposite).astype("int32"))

    return label


def label_predicted(predicted: DataFrame, known: list[int], model: UtilityModel, opposite: np.ndarray) -> DataFrame:
    """Predicted users with ``u``, 0/1 per opposite cluster, from the liked positions alone."""
    return predicted.withColumn("u", once(F.arrow_udf("array<int>")(_labels(model, known, opposite)))(F.col("liked")))


def clustering_entropy(assigned: DataFrame, sizes: Column, width: int) -> DataFrame:
    """Per cluster count and utility sums of ``(cluster_id, u)``, with its weighted entropy."""
    sums = assigned.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.get("u", F.lit(i))).alias(f"u{i}") for i in range(width)])
    pos = F.array(*[F.col(f"u{i}") for i in range(width)])
    return sums.select("cluster_id", "n", pos.alias("pos"), S.weighted_entropy(F.col("n"), pos, sizes).alias("we"))


def mean_entropy(per_cluster: DataFrame) -> DataFrame:
    return per_cluster.agg((F.sum(F.col("n") * F.col("we")) / F.sum("n")).alias("entropy"))
