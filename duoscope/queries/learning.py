"""Scoring, learning, clustering, labelling, and the jobs that chain them."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeansModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoscope.functions import draws
from duoscope.operators import cluster, csr, encode, learn, project, sample, trees
from duoscope.plans import jobs
from duoscope.queries import inputs as I
from duoscope.queries.encoding import long, model
from duoscope.queries.files import DYAD_SQL, dyad_totals, mixed_dyads, vectors
from duoscope.queries.node_tables import supplier_trees
from duoscope.queries.registry import query, sql_of, view
from duoscope.session import scratch_path, spread, table
from duoscope.sources import tables, text

EMBEDDING_WIDTH = 64


def sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return I.labelled(spark, sf), I.users_vec(spark, sf), I.items_vec(spark, sf)


# -- scoring ------------------------------------------------------------------------------------------

view("pairs", "SELECT DISTINCT user_id, item_id FROM outcomes", "outcomes")
view("scored", "SELECT user_id, item_id, sum(pu.p * pi.p) AS d FROM pairs JOIN pu USING (user_id) JOIN pi USING (item_id) WHERE pu.row = pi.row GROUP BY 1, 2",
     "pairs", "pu", "pi")


@query("ml_score", sql_of("SELECT user_id, item_id, round(1.0 / (1.0 + exp(-d)), 6) AS utility FROM scored", "scored"))
def ml_score(spark: SparkSession, sf: str) -> DataFrame:
    dyads, users, items = sides(spark, sf)
    scored = model().score(dyads.select("user_id", "item_id").distinct(), users, items)
    return scored.select("user_id", "item_id", F.round("utility", 6).alias("utility"))


@query("ml_map_left", sql_of("SELECT user_id, CAST(row AS INTEGER) AS row, round(p, 8) AS value FROM pu", "pu"))
def ml_map_left(spark: SparkSession, sf: str) -> DataFrame:
    return long(model().map_left(I.users_vec(spark, sf)), "user_id", "proj", "row", digits=8)


@query("ml_map_right", sql_of("SELECT item_id, CAST(row AS INTEGER) AS row, round(p, 8) AS value FROM pi", "pi"))
def ml_map_right(spark: SparkSession, sf: str) -> DataFrame:
    """The right side through the long factor table: joins and sums only."""
    dense = I.items_vec(spark, sf).select("item_id", F.concat("vec", F.array(F.lit(1.0))).alias("vec"))
    v = project.factors_of(spark, I.matrix(I.K, 1), I.matrix(I.K, I.ITEM_WIDTH + 1, 2)).where("side = 'V'").drop("side")
    return project.project_long(dense, v, "item_id").select("item_id", "row", F.round("value", 8).alias("value"))


# -- gradients -------------------------------------------------------------------------------------------

view("grad_f", """SELECT o.user_id, o.item_id, CASE WHEN outcome THEN 1.0 ELSE -1.0 END AS z, d FROM outcomes o JOIN scored s USING (user_id, item_id)""", "outcomes", "scored")
view("grad_w", """SELECT user_id, item_id, -z * (1.0 - 1.0 / (1.0 + exp(-z * d))) AS f FROM grad_f""", "grad_f")
view("gradient", """SELECT 'W' AS side, s.row, b.col, sum(s.g * b.x) / (SELECT count(*) FROM outcomes) AS value FROM
    (SELECT user_id, row, sum(f * p) AS g FROM grad_w JOIN pi USING (item_id) GROUP BY 1, 2) s JOIN users_bias b USING (user_id) GROUP BY 1, 2, 3
  UNION ALL SELECT 'V', s.row, b.col, sum(s.g * b.x) / (SELECT count(*) FROM outcomes) FROM
    (SELECT item_id, row, sum(f * p) AS g FROM grad_w JOIN pu USING (user_id) GROUP BY 1, 2) s JOIN items_bias b USING (item_id) GROUP BY 1, 2, 3""",
     "grad_w", "pi", "pu", "users_bias", "items_bias", "outcomes")
_GRADIENT = sql_of("SELECT side, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, round(value, 6) + 0.0 AS value FROM gradient", "gradient")


def shown_cells(cells: DataFrame) -> DataFrame:
    return cells.select("side", "row", "col", (F.round("value", 6) + 0.0).alias("value"))


@query("agg_gradient", _GRADIENT)
def agg_gradient(spark: SparkSession, sf: str) -> DataFrame:
    """Summed per entity first, so dyads never carry vectors."""
    return shown_cells(learn.entity_gradient(*sides(spark, sf), model()))


@query("agg_gradient_batches", _GRADIENT)
def agg_gradient_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The same gradient as partial matrix sums per task, as used for minibatches."""
    m = model()
    grads = learn.batch_gradients(learn.with_vectors(*sides(spark, sf)), {0: (m.w, m.v)})
    cells = grads.select("side", "row", "n", F.posexplode("total").alias("col", "g"))
    return shown_cells(cells.select("side", "row", "col", (F.col("g") / F.col("n")).alias("value")))


@query("ml_sgd_step", sql_of(f"""SELECT g.side, CAST(g.row AS INTEGER) AS row, CAST(g.col AS INTEGER) AS col,
  round(m.value - 0.5 * (g.value + 2.0 * 0.1 / sqrt({I.K}.0 * {I.USER_WIDTH + 1}) * m.value), 6) + 0.0 AS value
  FROM gradient g JOIN (SELECT 'W' AS side, * FROM w UNION ALL SELECT 'V', * FROM v) m ON m.side = g.side AND m.row = g.row AND m.col = g.col""", "gradient", "w", "v"))
def ml_sgd_step(spark: SparkSession, sf: str) -> DataFrame:
    """One full-batch step at learning rate 0.5 and regularisation 0.1."""
    m = model()
    cells = learn.entity_gradient(*sides(spark, sf), m)
    factors = project.factors_of(spark, m.w, m.v).withColumnRenamed("value", "old")
    scale = F.when(F.col("side") == "W", m.w.size).otherwise(m.v.size)
    new = F.col("old") - 0.5 * (F.col("value") + 2.0 * 0.1 / F.sqrt(scale) * F.col("old"))
    return shown_cells(cells.join(F.broadcast(factors), ["side", "row", "col"]).withColumn("value", new))


@query("agg_hit_rate", sql_of("SELECT round(avg(CASE WHEN (1.0 / (1.0 + exp(-d)) > 0.5) = outcome THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM outcomes JOIN scored USING (user_id, item_id)",
                              "outcomes", "scored"))
def agg_hit_rate(spark: SparkSession, sf: str) -> DataFrame:
    dyads, users, items = sides(spark, sf)
    return learn.hit_rate(model().score(dyads, users, items)).select(F.round("hit_rate", 6).alias("hit_rate"))


# -- learning ---------------------------------------------------------------------------------------------

def start_of(points: list[learn.Settings], widths: tuple[int, int]) -> list:
    """Arithmetic start matrices, the same in Spark and SQL."""
    return [(I.matrix(p.k, widths[0] + 1), I.matrix(p.k, widths[1] + 1, 2)) for p in points]


def training_views(name: str, rows: str, users: str, items: str, points: list[learn.Settings], steps: int,
                   minibatch: float | None, seed: int, widths: tuple[str, str]) -> str:
    """Views of ``steps`` descent steps of all points over the dyads of ``rows`` (user_id, item_id, outcome); returns the last one.

    ``users`` and ``items`` are long vectors with the bias; ``widths`` count their places with it. Without ``minibatch`` every
    step takes all rows.
    """
    values = ", ".join(f"({i}, {p.k}, {p.reg!r}, {p.l0!r}, {p.speed!r})" for i, p in enumerate(points))
    view(f"{name}_points", f"SELECT * FROM (VALUES {values}) AS t(model, k, reg, l0, speed)")
    most = max(p.k for p in points)

    def start(side: str, width: str, shift: int) -> str:
        return (f"SELECT model, '{side}' AS side, row, col, ((row * 7 + col * 3 + {shift}) % 11 - 5) / 10.0 AS value FROM {name}_points "
                f"CROSS JOIN (SELECT unnest(range(0, {most})) AS row) CROSS JOIN (SELECT unnest(range(0, {width})) AS col) WHERE row < k")

    needs = re.findall(r"FROM (\w+)\)", " ".join(widths))
    view(f"{name}_w0", f"{start('W', widths[0], 0)} UNION ALL {start('V', widths[1], 2)}", f"{name}_points", *needs, kept=True)
    a, b = draws.pair_sql(seed, "user_id", "item_id", "outcome", "repeat")
    view(f"{name}_rows", f"SELECT *, {a} AS a, {b} AS b FROM (SELECT user_id, item_id, outcome, row_number() OVER "
         f"(PARTITION BY user_id, item_id, outcome) AS repeat FROM {rows})", rows, kept=True)
    for t in range(1, steps + 1):
        drawn = "" if minibatch is None else (f" WHERE (a + {t} * b) % {draws.P} < (SELECT CAST(floor({float(minibatch)!r} / count(*) * {float(draws.P)!r}) "
                                              f"AS BIGINT) FROM {name}_rows)")
        view(f"{name}_b{t}", f"SELECT user_id, item_id, outcome FROM {name}_rows{drawn}", f"{name}_rows", kept=True)
        for side, table_name, key in (("W", users, "user_id"), ("V", items, "item_id")):
            view(f"{name}_p{side}{t}", f"SELECT model, {key}, row, sum(x * value) AS p FROM {table_name} JOIN {name}_w{t - 1} USING (col) "
                 f"WHERE side = '{side}' AND {key} IN (SELECT {key} FROM {name}_b{t}) GROUP BY ALL", table_name, f"{name}_w{t - 1}", f"{name}_b{t}", kept=True)
        view(f"{name}_d{t}", f"SELECT u.model, u.user_id, v.item_id, sum(u.p * v.p) AS d FROM (SELECT DISTINCT user_id, item_id FROM {name}_b{t}) b "
             f"JOIN {name}_pW{t} u ON u.user_id = b.user_id JOIN {name}_pV{t} v ON v.item_id = b.item_id AND v.model = u.model AND v.row = u.row GROUP BY ALL",
             f"{name}_b{t}", f"{name}_pW{t}", f"{name}_pV{t}")
        view(f"{name}_f{t}", f"SELECT model, user_id, item_id, -z * (1.0 - 1.0 / (1.0 + exp(-z * d))) AS f FROM {name}_d{t} JOIN "
             f"(SELECT user_id, item_id, CASE WHEN outcome THEN 1.0 ELSE -1.0 END AS z FROM {name}_b{t}) USING (user_id, item_id)",
             f"{name}_d{t}", f"{name}_b{t}", kept=True)
        parts = [f"SELECT g.model, '{side}' AS side, g.row, x.col, sum(g.g * x.x) / (SELECT count(*) FROM {name}_b{t}) AS value FROM "
                 f"(SELECT f.model, f.{key}, o.row, sum(f * p) AS g FROM {name}_f{t} f JOIN {name}_p{other}{t} o ON o.model = f.model AND o.{okey} = f.{okey} "
                 f"GROUP BY ALL) g JOIN {table_name} x ON x.{key} = g.{key} GROUP BY ALL"
                 for side, other, table_name, key, okey in (("W", "V", users, "user_id", "item_id"), ("V", "W", items, "item_id", "user_id"))]
        view(f"{name}_g{t}", " UNION ALL ".join(parts), f"{name}_f{t}", f"{name}_pW{t}", f"{name}_pV{t}", f"{name}_b{t}", users, items)
        view(f"{name}_w{t}", f"""SELECT w.model, w.side, w.row, w.col, w.value - l0 / (1 + speed * {t - 1}) *
          (coalesce(g.value, 0.0) + 2.0 * reg / sqrt(k * CASE w.side WHEN 'W' THEN {widths[0]} ELSE {widths[1]} END) * w.value) AS value
          FROM {name}_w{t - 1} w JOIN {name}_points s USING (model) LEFT JOIN {name}_g{t} g USING (model, side, row, col)""",
             f"{name}_w{t - 1}", f"{name}_points", f"{name}_g{t}", *needs, kept=True)
    return f"{name}_w{steps}"


def shown_model(model_: project.UtilityModel, spark: SparkSession) -> DataFrame:
    return project.factors_of(spark, model_.w, model_.v).withColumn("value", F.round("value", 6) + 0.0)


def model_sql(last: str) -> str:
    return sql_of(f"SELECT side, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, round(value, 6) + 0.0 AS value FROM {last}", last)


SMALL = (I.USER_WIDTH, I.ITEM_WIDTH)
SMALL_SQL = (str(I.USER_WIDTH + 1), str(I.ITEM_WIDTH + 1))
ONE_POINT = [learn.Settings(k=4, reg=0.01, l0=0.5)]


@query("ml_sgd", model_sql(training_views("sgd", "outcomes", "users_bias", "items_bias", ONE_POINT, 5, 100, 3, SMALL_SQL)))
def ml_sgd(spark: SparkSession, sf: str) -> DataFrame:
    """Five steps on minibatches drawn by keys, from fixed start matrices."""
    fitted = learn.learn(*sides(spark, sf), ONE_POINT[0], max_iterations=6, minibatch=100, seed=3, start=start_of(ONE_POINT, SMALL))
    return shown_model(fitted, spark)


@query("ml_sgd_full", model_sql(training_views("sgdf", "outcomes", "users_bias", "items_bias", ONE_POINT, 3, None, 3, SMALL_SQL)))
def ml_sgd_full(spark: SparkSession, sf: str) -> DataFrame:
    """Three steps over all dyads, summed per entity."""
    fitted = learn.learn(*sides(spark, sf), ONE_POINT[0], max_iterations=4, minibatch=1e15, seed=3, start=start_of(ONE_POINT, SMALL))
    return shown_model(fitted, spark)


def small_grid() -> list[learn.Settings]:
    return learn.grid((2, 4), (0.1, 1.0), (0.1, 1.0), (0.01,))


_SPLIT = draws.pair_sql(3, "user_id", "item_id")[0]
view("grid_train", f"SELECT * FROM outcomes WHERE {_SPLIT} < {draws.limit(0.7)}", "outcomes")
view("grid_test", f"SELECT * FROM outcomes WHERE {_SPLIT} >= {draws.limit(0.7)}", "outcomes")
_LAST = training_views("grid", "grid_train", "users_bias", "items_bias", small_grid(), 4, 200, 3, SMALL_SQL)
view("grid_pu", f"SELECT model, user_id, row, sum(x * value) AS p FROM users_bias JOIN {_LAST} USING (col) WHERE side = 'W' GROUP BY ALL", "users_bias", _LAST, kept=True)
view("grid_pi", f"SELECT model, item_id, row, sum(x * value) AS p FROM items_bias JOIN {_LAST} USING (col) WHERE side = 'V' GROUP BY ALL", "items_bias", _LAST, kept=True)
for _part in ("train", "test"):
    view(f"grid_{_part}_rate", f"""SELECT model, avg(CASE WHEN (1.0 / (1.0 + exp(-d)) > 0.5) = outcome THEN 1.0 ELSE 0.0 END) AS rate FROM grid_{_part} JOIN
      (SELECT u.model, u.user_id, v.item_id, sum(u.p * v.p) AS d FROM (SELECT DISTINCT user_id, item_id FROM grid_{_part}) b JOIN grid_pu u ON u.user_id = b.user_id
       JOIN grid_pi v ON v.item_id = b.item_id AND v.model = u.model AND v.row = u.row GROUP BY ALL) USING (user_id, item_id) GROUP BY 1""",
         f"grid_{_part}", "grid_pu", "grid_pi")
view("grid_table", """SELECT CAST(model AS INTEGER) AS model, CAST(k AS INTEGER) AS k, CAST(reg AS DOUBLE) AS reg, CAST(l0 AS DOUBLE) AS l0,
  CAST(speed AS DOUBLE) AS speed, round(e.rate, 6) AS hit_rate, round(t.rate, 6) AS train_hit_rate
  FROM grid_points JOIN grid_test_rate e USING (model) JOIN grid_train_rate t USING (model)""", "grid_points", "grid_test_rate", "grid_train_rate")


def tuned(spark: SparkSession, sf: str) -> learn.GridResult:
    return learn.learn_tuned(*sides(spark, sf), small_grid(), minibatch=200, max_iterations=5, seed=3, start=start_of(small_grid(), SMALL))


def shown_grid(table_: DataFrame) -> DataFrame:
    return table_.withColumns({c: F.round(c, 6) for c in ("hit_rate", "train_hit_rate")})


@query("ml_grid", sql_of("SELECT * FROM grid_table", "grid_table"))
def ml_grid(spark: SparkSession, sf: str) -> DataFrame:
    return shown_grid(tuned(spark, sf).table)


@query("top1_grid", sql_of("SELECT * FROM grid_table ORDER BY hit_rate DESC, model LIMIT 1", "grid_table"))
def top1_grid(spark: SparkSession, sf: str) -> DataFrame:
    return shown_grid(learn.top_grid(tuned(spark, sf).table))


_REPEATED = "SELECT user_id, item_id, outcome AS label, row_number() OVER (PARTITION BY user_id, item_id, outcome) AS repeat FROM outcomes"


@query("smp_bernoulli", sql_of(f"SELECT user_id, item_id, label FROM ({_REPEATED}) WHERE "
                               f"{draws.pair_sql(5, 'user_id', 'item_id', 'label', 'repeat')[0]} < {draws.limit(0.1)}", "outcomes"))
def smp_bernoulli(spark: SparkSession, sf: str) -> DataFrame:
    return sample.bernoulli(I.labelled(spark, sf), 0.1, 5)


@query("smp_split", sql_of(f"SELECT CASE WHEN {draws.pair_sql(5, 'user_id', 'item_id')[0]} < {draws.limit(0.7)} THEN 'train' ELSE 'test' END AS part, "
                           "count(*) AS n, sum(user_id * 31 + item_id)::BIGINT AS keys FROM outcomes GROUP BY 1", "outcomes"))
def smp_split(spark: SparkSession, sf: str) -> DataFrame:
    train, test = sample.split(I.labelled(spark, sf), ["user_id", "item_id"], 0.7, 5)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))).groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("user_id") * 31 + F.col("item_id")).alias("keys"))


# -- clusters -----------------------------------------------------------------------------------------------

view("centers", f"""SELECT label AS cluster_id, pos, avg(v) AS c FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS v,
  unnest(range(0, {EMBEDDING_WIDTH})) AS pos FROM embeddings) GROUP BY 1, 2""")
view("vec_long", f"SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(0, {EMBEDDING_WIDTH})) AS pos FROM embeddings")
view("near", """SELECT vec_id, cluster_id FROM (SELECT vec_id, cluster_id, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 12), cluster_id) AS rn FROM
  (SELECT vec_id, cluster_id, sum((v - c) * (v - c)) AS d FROM vec_long JOIN centers USING (pos) GROUP BY 1, 2)) WHERE rn = 1""", "vec_long", "centers")


def assigned(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    ids, centers = cluster.center_matrix(cluster.centroids(rows, EMBEDDING_WIDTH))
    return rows.withColumn("cluster_id", cluster.assign(F.col("vec"), ids, centers))


@query("ml_assign", sql_of("SELECT vec_id, cluster_id FROM near", "near"))
def ml_assign(spark: SparkSession, sf: str) -> DataFrame:
    return assigned(spark, sf).select("vec_id", "cluster_id")


@query("agg_cluster_counts", sql_of("SELECT cluster_id, count(*) AS size FROM near GROUP BY 1", "near"))
def agg_cluster_counts(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.cluster_counts(assigned(spark, sf))


def nearest_flags(predicted: DataFrame, fitted: KMeansModel, sizes: DataFrame) -> DataFrame:
    """What holds for every clustering: all rows are counted, and every row is in the cluster of its nearest center."""
    centers = np.array(fitted.clusterCenters())

    @F.arrow_udf("boolean")
    def near(features: pa.Array, cluster_id: pa.Array) -> pa.Array:
        x = features.flatten().to_numpy(zero_copy_only=False).reshape(len(features), -1)
        d = np.stack([((x - c) ** 2).sum(axis=1) for c in centers], axis=1)
        return pa.array(d[np.arange(len(x)), cluster_id.to_numpy()] <= d.min(axis=1) + 1e-9)

    checked = predicted.select(project.once(near)(vector_to_array("features"), F.col("prediction")).alias("near"))
    flags = checked.agg(F.count(F.lit(1)).alias("n"), F.bool_and("near").alias("nearest"))
    total = sizes.agg(F.sum("size").alias("total"), (F.count(F.lit(1)) <= len(centers)).alias("bounded"))
    return flags.crossJoin(total)  # two tables of one row


def flags_sql(source: str) -> str:
    return f"SELECT count(*) AS n, true AS nearest, count(*) AS total, true AS bounded FROM {source}"


def side_flags(entities: DataFrame, side: str, model_: project.UtilityModel | None, k: int, width: int) -> DataFrame:
    fitted, sizes = cluster.cluster_side(entities, side, model_, k, 10, 1, width)
    return nearest_flags(fitted.transform(cluster.features(entities, side, model_, width)), fitted, sizes)


@query("ml_kmeans", flags_sql("embeddings"))
def ml_kmeans(spark: SparkSession, sf: str) -> DataFrame:
    fitted = cluster.kmeans(vectors(spark, sf), k=10, iterations=10, seed=1)
    predicted = fitted.transform(vectors(spark, sf).withColumn("features", array_to_vector("vec")))
    return nearest_flags(predicted, fitted, cluster.cluster_counts(predicted, "prediction"))


@query("ml_cluster_left", flags_sql("customer"))
def ml_cluster_left(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse users, clustered in the learned space."""
    return side_flags(csr.of_dense(I.users_vec(spark, sf), "user_id"), "left", model(), 8, I.USER_WIDTH)


@query("ml_cluster_right", flags_sql("part"))
def ml_cluster_right(spark: SparkSession, sf: str) -> DataFrame:
    """Items by their own vectors, which stay sparse."""
    return side_flags(csr.of_dense(I.items_vec(spark, sf), "item_id"), "right", None, 8, I.ITEM_WIDTH)


# Fixed opposite centers: the mean projection per customer segment and per part type.
view("user_centers", "SELECT pos AS cluster_id, row, avg(p) AS c FROM pu JOIN customer ON c_custkey = user_id JOIN "
     f"(SELECT unnest({I.sql_list(I.SEGMENTS)}) AS name, unnest(range(0, 5)) AS pos) ON name = c_mktsegment GROUP BY 1, 2", "pu")
view("item_centers", "SELECT pos AS cluster_id, row, avg(p) AS c FROM pi JOIN part ON p_partkey = item_id JOIN "
     f"(SELECT unnest({I.sql_list(I.TYPES)}) AS name, unnest(range(0, 6)) AS pos) ON name = p_type GROUP BY 1, 2", "pi")
view("item_likes", "SELECT item_id, cluster_id, CASE WHEN round(sum(p * c), 9) > 0 THEN 1 ELSE 0 END AS u FROM pi JOIN user_centers USING (row) GROUP BY 1, 2", "pi", "user_centers")
view("user_likes", "SELECT user_id, cluster_id, CASE WHEN round(sum(p * c), 9) > 0 THEN 1 ELSE 0 END AS u FROM pu JOIN item_centers USING (row) GROUP BY 1, 2", "pu", "item_centers")


def opposite_centers(spark: SparkSession, sf: str, side: str):
    """Centers of the users (``left``) or items in projected space."""
    m = model()
    if side == "left":
        t, key, col, names = table(spark, sf, "customer"), "c_custkey", "c_mktsegment", I.SEGMENTS
        mapped = m.map_left(I.users_vec(spark, sf)).withColumnRenamed("user_id", key)
    else:
        t, key, col, names = table(spark, sf, "part"), "p_partkey", "p_type", I.TYPES
        mapped = m.map_right(I.items_vec(spark, sf)).withColumnRenamed("item_id", key)
    group = (F.array_position(F.lit(names), F.col(col)) - 1).cast("int")
    rows = mapped.join(t.select(key, group.alias("g")), key)
    return cluster.center_matrix(cluster.centroids(rows, I.K, "proj", "g"))[1]


def likes(spark: SparkSession, sf: str, side: str) -> DataFrame:
    entities = I.users_vec(spark, sf) if side == "left" else I.items_vec(spark, sf)
    return cluster.label_entities(entities, side, model(), opposite_centers(spark, sf, "right" if side == "left" else "left"))


@query("ml_label_items", sql_of("SELECT item_id, string_agg(u::VARCHAR, ',' ORDER BY cluster_id) AS u FROM item_likes GROUP BY 1", "item_likes"))
def ml_label_items(spark: SparkSession, sf: str) -> DataFrame:
    return likes(spark, sf, "right").select("item_id", F.array_join("u", ",").alias("u"))


@query("ml_label_users", sql_of("SELECT user_id, string_agg(u::VARCHAR, ',' ORDER BY cluster_id) AS u FROM user_likes GROUP BY 1", "user_likes"))
def ml_label_users(spark: SparkSession, sf: str) -> DataFrame:
    return likes(spark, sf, "left").select("user_id", F.array_join("u", ",").alias("u"))


@query("jn_cross_centroids", sql_of("SELECT item_id, count(*) AS centroids, sum(u)::BIGINT AS liked FROM item_likes GROUP BY 1", "item_likes"))
def jn_cross_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Every item against every user centroid: a product with a broadcast matrix, no pair rows."""
    liked = F.size(F.filter("u", lambda v: v == 1)).cast("bigint")
    return likes(spark, sf, "right").select("item_id", F.size("u").cast("bigint").alias("centroids"), liked.alias("liked"))


# Parts grouped by brand as the clustering whose labels are summed.
view("brand_votes", """SELECT p_brand AS cluster_id, seg, count(*) AS n, sum(u) AS pos FROM u_long JOIN part ON p_partkey = id GROUP BY 1, 2""", "u_long")
view("brand_we", f"""SELECT cluster_id, max(n) AS n, round(sum(({I.entropy_sql('pos', 'n')}) * size) / max(total), 12) AS we FROM brand_votes JOIN sizes s ON s.cluster_id = seg CROSS JOIN total_size GROUP BY 1"""
     .replace("SELECT cluster_id", "SELECT brand_votes.cluster_id"), "brand_votes", "sizes", "total_size")


def brand_entropy(spark: SparkSession, sf: str) -> DataFrame:
    brands = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("cluster_id"))
    rows = I.explanation(spark, sf).join(brands, "id")
    return cluster.clustering_entropy(rows, I.size_array(spark, sf), len(I.SEGMENTS))


@query("agg_cluster_labels", sql_of("SELECT cluster_id, max(n) AS n, string_agg(pos::BIGINT::VARCHAR, ',' ORDER BY seg) AS pos FROM brand_votes GROUP BY 1", "brand_votes"))
def agg_cluster_labels(spark: SparkSession, sf: str) -> DataFrame:
    return brand_entropy(spark, sf).select("cluster_id", "n", F.array_join("pos", ",").alias("pos"))


@query("agg_clustering_entropy", sql_of("SELECT round(sum(n * we) / sum(n), 6) AS entropy FROM brand_we", "brand_we"))
def agg_clustering_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.mean_entropy(brand_entropy(spark, sf)).select(F.round("entropy", 6).alias("entropy"))


# -- jobs -----------------------------------------------------------------------------------------------------

def coded(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Encoded inputs as the jobs make them from files, here from the tables."""
    work = scratch_path(spark, "codes")
    rated = tables.save_once(I.outcomes(spark, sf), f"{work}/outcomes")
    items = encode.item_vectors(I.scaled(spark, sf), encode.tag_vectors(I.tags(spark, sf)))
    return jobs.store_codes(rated, items, encode.dense_index(encode.item_counts(rated), I.MIN_COUNT), work)


view("coded_dyads", "SELECT user_id, item_id, outcome FROM outcomes SEMI JOIN user_pos USING (user_id) SEMI JOIN "
     "(SELECT item_id FROM scaled SEMI JOIN tags USING (item_id)) s USING (item_id)", "outcomes", "user_pos", "scaled", "tags", kept=True)
_CELLS = """SELECT side, CAST(pos AS INTEGER) AS pos, sum(n)::BIGINT AS n, round(sum(n * value), 4) + 0.0 AS total FROM (
  SELECT 'left' AS side, p.pos, p.value, o.n FROM user_pos p JOIN (SELECT user_id, count(*) AS n FROM coded_dyads GROUP BY 1) o USING (user_id)
  UNION ALL SELECT 'right', l.pos, l.value, o.n FROM item_long l JOIN (SELECT item_id, count(*) AS n FROM coded_dyads GROUP BY 1) o USING (item_id) WHERE l.value <> 0
  UNION ALL SELECT 'label', 0, CAST(outcome AS INTEGER), 1 FROM coded_dyads) GROUP BY 1, 2"""


@query("job_export_dyads", sql_of(_CELLS, "coded_dyads", "user_pos", "item_long"))
def job_export_dyads(spark: SparkSession, sf: str) -> DataFrame:
    """What is stored, per position: how many rows have a value there, and their sum."""
    path, parts = scratch_path(spark, "dyads"), coded(spark, sf)
    jobs.export_dyads(parts, path)
    width = tables.read_widths(spark, path)["left_tri"]
    rows = spark.read.schema(tables.STORED_ROWS).parquet(f"{path}/rows")
    cells = rows.select(F.explode(F.arrays_zip(F.col("features.indices").alias("pos"), F.col("features.values").alias("value"))).alias("c")).select("c.*")
    cells = cells.select(F.when(F.col("pos") < width, "left").otherwise("right").alias("side"),
                         F.when(F.col("pos") < width, F.col("pos")).otherwise(F.col("pos") - width).alias("pos"), "value")
    labels = rows.select(F.lit("label").alias("side"), F.lit(0).alias("pos"), F.col("label").alias("value"))
    return cells.unionByName(labels).groupBy("side", "pos").agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("value"), 4) + 0.0).alias("total"))


@query("job_to_object", sql_of(DYAD_SQL, "outcomes"))
def job_to_object(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "dyads")
    tables.write_dyads(mixed_dyads(spark, sf), path)
    return dyad_totals(spark.read.orc(jobs.to_object(spark, path)))


@query("job_to_parquet", sql_of("SELECT count(DISTINCT id) AS n, round(sum(v), 4) AS attributes FROM x_long", "x_long"))
def job_to_parquet(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(jobs.to_parquet(spark, label_file(spark, sf), 9))
    x, _ = tables.split_at(F.col("features"), 4)
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(total), 4).alias("attributes"))


@query("job_export_codifications", sql_of("""SELECT 'user' AS side, user_id AS id, round(sum(abs(value)), 4) AS weight FROM user_tri GROUP BY 2
  UNION ALL SELECT 'item', item_id, round(sum(abs(value)), 4) FROM item_long GROUP BY 2""", "user_tri", "item_long"))
def job_export_codifications(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "codes")
    jobs.export_codes(coded(spark, sf), path)
    total = F.aggregate("val", F.lit(0.0), lambda a, v: a + F.abs(v))

    def side(name: str) -> DataFrame:
        return tables.read_codes(spark, f"{path}/{name}s").select(F.lit(name).alias("side"), "id", F.round(total, 4).alias("weight"))

    return side("user").unionByName(side("item"))


view("coded_users", "SELECT user_id, pos AS col, CAST(value AS DOUBLE) AS x FROM user_pos UNION ALL "
     "SELECT DISTINCT user_id, (SELECT count(*) FROM id_map), 1.0 FROM user_pos", "user_pos", "id_map", kept=True)
view("coded_items", "SELECT item_id, pos AS col, value AS x FROM item_long WHERE value <> 0 UNION ALL "
     "SELECT DISTINCT item_id, (SELECT max(pos) + 1 FROM item_long), 1.0 FROM item_long", "item_long", kept=True)
CODED_SQL = ("(SELECT count(*) + 1 FROM id_map)", "(SELECT max(pos) + 2 FROM item_long)")
JOB_POINT = [learn.Settings(k=4, reg=0.01, l0=0.5, speed=0.1)]
_SPLIT_JOB = draws.pair_sql(1, "user_id", "item_id")[0]
view("job_train", f"SELECT * FROM outcomes WHERE {_SPLIT_JOB} < {draws.limit(0.7)} AND user_id IN (SELECT user_id FROM user_pos) AND "
     "item_id IN (SELECT item_id FROM item_long)", "outcomes", "user_pos", "item_long", kept=True)


@query("job_learn_utility", model_sql(training_views("job", "job_train", "coded_users", "coded_items", JOB_POINT, 5, None, 1, CODED_SQL)))
def job_learn_utility(spark: SparkSession, sf: str) -> DataFrame:
    """Five steps over the whole training part of the coded tables; the stored factors are read back."""
    path, parts = scratch_path(spark, "utility"), coded(spark, sf)
    jobs.learn_utility(parts, path, JOB_POINT, None, 6, 1, start=start_of(JOB_POINT, jobs.sparse_sides(parts)[2]))
    return tables.read_factors(spark, path).select("side", "row", "col", (F.round("value", 6) + 0.0).alias("value"))


@query("job_learn_stored", model_sql(training_views("stored", "coded_dyads", "coded_users", "coded_items", JOB_POINT, 2, None, 1, CODED_SQL)))
def job_learn_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Exported dyads have no ids: distinct vectors become a dictionary, and two steps over all rows learn from it."""
    path = scratch_path(spark, "dyads")
    jobs.export_dyads(coded(spark, sf), path)
    ids, users, items, widths = tables.read_dyad_sides(spark, path)
    fitted = learn.learn(ids, users, items, JOB_POINT[0], max_iterations=3, minibatch=1e15, start=start_of(JOB_POINT, widths), widths=widths)
    return shown_model(fitted, spark)


def stand_in(parts: dict[str, DataFrame]) -> project.UtilityModel:
    users, items = jobs.sparse_sides(parts)[2]
    return project.UtilityModel(I.matrix(I.K, users + 1), I.matrix(I.K, items + 1, 2), 1.0, True, True)


@query("job_cluster", sql_of("SELECT 'user' AS side, count(DISTINCT user_id) AS total, true AS bounded FROM user_pos UNION ALL "
                             "SELECT 'item', count(DISTINCT item_id), true FROM item_long", "user_pos", "item_long"))
def job_cluster(spark: SparkSession, sf: str) -> DataFrame:
    """Both sides clustered in the learned space; the written sizes count every entity."""
    path, parts = scratch_path(spark, "clusters"), coded(spark, sf)
    jobs.cluster_sides(parts, stand_in(parts), path, k=6, iterations=5, seed=1)

    def sizes(name: str) -> DataFrame:
        return text.read_cluster_sizes(spark, f"{path}/{name}s_sizes").agg(
            F.lit(name).alias("side"), F.sum("size").alias("total"), (F.count(F.lit(1)) <= 6).alias("bounded"))

    return sizes("user").unionByName(sizes("item"))


def label_file(spark: SparkSession, sf: str) -> str:
    """Explanation rows as libsvm, four attributes then five utilities."""
    path = scratch_path(spark, "labels")
    rows = I.explanation(spark, sf)
    tables.write_libsvm(rows.select(F.concat("x", F.col("u").cast("array<double>")).alias("f")), "f", path)
    return path


def size_file(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark, "sizes")
    text.write_pairs(I.segment_sizes(spark, sf), "cluster_id", "size", path)
    return path


@query("job_kmeans", sql_of("SELECT count(*) AS n, true AS nearest, count(*) AS total, true AS bounded FROM ids", "ids"))
def job_kmeans(spark: SparkSession, sf: str) -> DataFrame:
    path, labels = scratch_path(spark, "attributes"), label_file(spark, sf)
    jobs.cluster_attributes(spark, labels, 9, 4, path, k=8, iterations=10, seed=1)
    x, _ = tables.split_at(F.col("features"), 4)
    fitted = KMeansModel.load(path)
    predicted = fitted.transform(tables.read_libsvm(spark, labels, 9).select(array_to_vector(x).alias("features")))
    return nearest_flags(predicted, fitted, cluster.cluster_counts(predicted, "prediction"))


@query("job_entropy", "SELECT true AS same, true AS inside")
def job_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """The job's entropy against sums over the long rows of the same clusters."""
    path, labels = scratch_path(spark, "attributes"), label_file(spark, sf)
    jobs.cluster_attributes(spark, labels, 9, 4, path, k=8, iterations=10, seed=1)
    found = jobs.clustering_entropy(spark, labels, 9, 4, path, size_file(spark, sf))
    x, u = tables.split_at(F.col("features"), 4)
    rows = KMeansModel.load(path).transform(tables.read_libsvm(spark, labels, 9).select(u.alias("u"), array_to_vector(x).alias("features")))
    votes = rows.select("prediction", F.posexplode("u").alias("cluster_id", "v")).groupBy("prediction", "cluster_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("p"))
    p = F.col("p")
    h = F.when((p > 0) & (p < 1), -p * F.log2(p) - (1 - p) * F.log2(1 - p)).otherwise(0.0)
    weighed = votes.join(I.segment_sizes(spark, sf), "cluster_id").agg((F.sum(h * F.col("n") * F.col("size")) / F.sum(F.col("n") * F.col("size"))).alias("again"))
    return found.crossJoin(weighed).select((F.abs(F.col("entropy") - F.col("again")) < 1e-9).alias("same"), F.col("entropy").between(0, 1).alias("inside"))


# Fixed centers of the opposite side, in projected space.
CENTERS = 6
_CENTER = f"(SELECT c.i AS cluster_id, r.i AS row, ((c.i * 7 + r.i * 3 + 1) % 11 - 5) / 10.0 AS c FROM (SELECT unnest(range(0, {CENTERS})) AS i) c CROSS JOIN (SELECT unnest(range(0, {I.K})) AS i) r)"


def _projection_sql(key: str, source: str, shift: int) -> str:
    return (f"SELECT {key}, r.i AS row, sum(x * (((r.i * 7 + col * 3 + {shift}) % 11 - 5) / 10.0)) AS p FROM {source} "
            f"CROSS JOIN (SELECT unnest(range(0, {I.K})) AS i) r GROUP BY 1, 2")


view("user_cells", "SELECT user_id, pos AS col, CAST(value AS DOUBLE) AS x FROM user_pos", "user_pos")
view("item_cells", "SELECT item_id, pos AS col, value AS x FROM item_long WHERE value <> 0", "item_long")
view("coded_pu", _projection_sql("user_id", "coded_users", 0), "coded_users", kept=True)
view("coded_pi", _projection_sql("item_id", "coded_items", 2), "coded_items", kept=True)
# users coded by predictions: +1 or -1 for every popular item that has a vector
view("predicted_coded", """SELECT u.user_id, m.idx AS col, CASE WHEN round(sum(u.p * v.p), 9) > 0 THEN 1.0 ELSE -1.0 END AS x FROM coded_pu u JOIN coded_pi v USING (row)
  JOIN id_map m ON m.item_id = v.item_id GROUP BY 1, 2""", "coded_pu", "coded_pi", "id_map", kept=True)
view("predicted_bias", "SELECT * FROM predicted_coded UNION ALL SELECT DISTINCT user_id, (SELECT count(*) FROM id_map), 1.0 FROM predicted_coded", "predicted_coded", "id_map")
view("predicted_pu", _projection_sql("user_id", "predicted_bias", 0), "predicted_bias")


def _labels_sql(mode: str, key: str, projected: str, cells: str) -> str:
    """Per cluster how many entities like it, and per attribute position its sum, shown as negative cluster ids."""
    return f"""SELECT '{mode}' AS mode, CAST(cluster_id AS INTEGER) AS place, 'label' AS kind, count(*) AS n, sum(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END) AS total FROM
      (SELECT {key}, cluster_id, round(sum(p * c), 9) AS d FROM {projected} JOIN {_CENTER} USING (row) GROUP BY 1, 2) GROUP BY 2
      UNION ALL SELECT '{mode}', CAST(col AS INTEGER), 'attribute', count(*), round(sum(x), 4) + 0.0 FROM {cells} GROUP BY 2"""


def shown_labels(spark: SparkSession, path: str, split: int, mode: str) -> DataFrame:
    """Sums per position of the written lines: attributes that are not 0, and all labels."""
    found = Summarizer.metrics("count", "numNonZeros", "sum").summary(F.col("features"))  # whole vectors, no row per position
    sums = tables.read_libsvm_vectors(spark, path, split + CENTERS).groupBy(F.lit(mode).alias("mode")).agg(found.alias("s"))
    cells = F.arrays_zip(vector_to_array("s.numNonZeros").alias("n"), vector_to_array("s.sum").alias("total"))
    places = sums.select("mode", F.col("s.count").alias("rows"), F.posexplode(cells).alias("pos", "c"))
    label = F.col("pos") >= split
    return places.where(label | (F.col("c.n") > 0)).select(
        "mode", F.when(label, F.col("pos") - split).otherwise(F.col("pos")).alias("place"), F.when(label, "label").otherwise("attribute").alias("kind"),
        F.when(label, F.col("rows")).otherwise(F.col("c.n").cast("bigint")).alias("n"), (F.round("c.total", 4) + 0.0).alias("total"))


@query("job_export_users", sql_of(_labels_sql("rated", "user_id", "coded_pu", "user_cells") + " UNION ALL " +
                                  _labels_sql("predicted", "user_id", "predicted_pu", "predicted_coded"), "coded_pu", "predicted_pu", "user_cells", "predicted_coded"))
def job_export_users(spark: SparkSession, sf: str) -> DataFrame:
    """Users against fixed item centers, coded by their ratings and by predictions."""
    parts = coded(spark, sf)
    users, items, widths = jobs.sparse_sides(parts)
    m, centers = stand_in(parts), I.matrix(CENTERS, I.K, 1)
    path = scratch_path(spark, "labels")
    split = jobs.export_labels(users, "left", m, centers, widths[0], f"{path}/rated")
    popular = parts["id_map"].join(items, "item_id", "left").select("idx", "pos", "val")
    jobs.export_predicted_users(users, popular, m, centers, f"{path}/predicted")
    return shown_labels(spark, f"{path}/rated", split, "rated").unionByName(shown_labels(spark, f"{path}/predicted", split, "predicted"))


@query("job_export_items", sql_of(_labels_sql("items", "item_id", "coded_pi", "item_cells"), "coded_pi", "item_cells"))
def job_export_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items against fixed user centers."""
    parts = coded(spark, sf)
    path = scratch_path(spark, "labels")
    _, items, widths = jobs.sparse_sides(parts)
    split = jobs.export_labels(items, "right", stand_in(parts), I.matrix(CENTERS, I.K, 1), widths[1], path)
    return shown_labels(spark, path, split, "items")


@query("job_explain", sql_of("""SELECT path, CAST(var AS INTEGER) AS var, round(lo, 6) AS lo, round(hi, 6) AS hi, round(rel_size, 6) AS rel_size, round(data_entropy, 6) AS data_entropy,
  true AS reported FROM tree2_3""", "tree2_3"))
def job_explain(spark: SparkSession, sf: str) -> DataFrame:
    """The written nodes, and whether the written report says the same of each to its digits."""
    out = scratch_path(spark, "tree")
    jobs.explain(spark, label_file(spark, sf), 9, 4, size_file(spark, sf), out, max_level=2, num_candidates=3)
    nodes = spark.read.parquet(f"{out}/nodes")
    report = spark.read.text(f"{out}/report", wholetext=True).where(F.trim("value") != "").select(F.lit(0).alias("tree_id"), "value")
    said = trees.parse_reports(report).select("path", *[F.col(c).alias(f"r_{c}") for c in ("var", "lo", "hi", "rel_size", "data_entropy")])

    def near(c: str, tolerance: float) -> F.Column:
        return (F.col(c) == F.col(f"r_{c}")) | (F.abs(F.col(c) - F.col(f"r_{c}")) < tolerance)

    same = F.col("var").eqNullSafe(F.col("r_var")) & near("lo", 6e-5) & near("hi", 6e-5) & near("rel_size", 6e-5) & near("data_entropy", 6e-3)
    both = nodes.join(said, "path", "left")
    return both.select("path", F.col("var").cast("int").alias("var"), *[
        F.when(F.abs(F.col(c)) < float("inf"), F.round(c, 6)).alias(c) for c in ("lo", "hi")],
        F.round("rel_size", 6).alias("rel_size"), F.round("data_entropy", 6).alias("data_entropy"), F.coalesce(same, F.lit(False)).alias("reported"))


@query("job_prune_sweep", sql_of("""SELECT b.tree_id, round(b.lam, 9) AS lam, f.leaves AS fixed_leaves
  FROM (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY pruned_quality DESC, lam DESC) AS rn FROM sw_sweep) b JOIN fx_sweep f USING (tree_id) WHERE rn = 1""",
                                 "sw_sweep", "fx_sweep"))
def job_prune_sweep(spark: SparkSession, sf: str) -> DataFrame:
    picked = jobs.prune_sweep(supplier_trees(spark, sf), scratch_path(spark, "sweep"))
    return picked.select("tree_id", F.round("lam", 9).alias("lam"), "fixed_leaves")


@query("job_gradient_bench")
def job_gradient_bench(spark: SparkSession, sf: str) -> DataFrame:
    """One full-batch gradient over a random 100+100 tri-state dyad per order, k = 20."""
    ids = spread(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), "id")
    left = sample.random_tri_vectors(ids, 100, 1).select(F.col("id"), F.col("vec").alias("x"))
    both = left.join(sample.random_tri_vectors(ids, 100, 2).select("id", F.col("vec").alias("y")), "id")
    grads = learn.batch_gradients(both.withColumn("label", F.lit(True)), {0: (I.matrix(20, 101), I.matrix(20, 101, 2))})
    norm = F.aggregate("total", F.lit(0.0), lambda a, v: a + F.abs(v))
    return grads.select("side", "row", "n", F.round(norm, 3).alias("size"))

