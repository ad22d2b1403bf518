"""Sources and sinks: tables are written in the layouts of the jobs and read back."""

from __future__ import annotations

from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoscope import fixed
from duoscope.functions import vectors as V
from duoscope.operators import cluster, csr, encode, joins, learn, project
from duoscope.queries import inputs as I
from duoscope.queries.registry import query, sql_of
from duoscope.session import scratch_path, spread, table
from duoscope.sources import tables, text


def write_lines(lines: DataFrame, header: str, path: str) -> None:
    """Text lines in several parts; the header is one line of its own, the other parts have none."""
    head = lines.sparkSession.createDataFrame([(header,)], "value string")
    head.unionByName(spread(lines)).write.text(path)


@query("src_items_csv", sql_of("SELECT item_id, title, genres FROM items", "items"))
def src_items_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "items")
    lines = I.items(spark, sf).select(F.concat_ws(",", F.col("item_id").cast("string"), "title", "genres").alias("value"))
    write_lines(lines, fixed.ITEMS_HEADER, path)
    return text.read_items(spark, path)


@query("src_ratings_csv", sql_of("SELECT user_id, item_id, rating FROM ratings", "ratings"))
def src_ratings_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "ratings")
    write_lines(I.ratings(spark, sf).select(F.concat_ws(",", "user_id", "item_id", "rating", "user_id").alias("value")),
                fixed.RATINGS_HEADER, path)
    return text.read_ratings(spark, path)


@query("src_tags_csv", sql_of("SELECT item_id, tag_id, relevance FROM tags", "tags"))
def src_tags_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "tags")
    rows = I.tags(spark, sf).toDF("item_id", "tag_id", "relevance")
    write_lines(rows.select(F.concat_ws(",", *rows.columns).alias("value")), fixed.TAGS_HEADER, path)
    return text.read_tags(spark, path)


@query("src_names_csv", "SELECT CAST(p_partkey AS INTEGER) AS pos, p_name || ', ' || p_brand AS name FROM part")
def src_names_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "names")
    p = table(spark, sf, "part")
    name = F.concat((F.col("p_partkey") + 1).cast("string"), F.lit(","), "p_name", F.lit(", "), "p_brand")
    write_lines(p.select(name.alias("value")), fixed.TAG_NAMES_HEADER, path)
    return text.read_tag_names(spark, path)


@query("src_libsvm", sql_of(
    "SELECT CAST(user_id AS DOUBLE) AS label, CAST(col AS INTEGER) AS col, round(x, 6) AS value FROM users_long", "users_long"))
def src_libsvm(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "libsvm")
    tables.write_libsvm(I.users_vec(spark, sf), "vec", path, "user_id")
    rows = tables.read_libsvm(spark, path, I.USER_WIDTH)
    return rows.select("label", F.posexplode("features").alias("col", "v")).select(
        "label", "col", F.round("v", 6).alias("value"))


@query("src_cluster_sizes", sql_of("SELECT CAST(cluster_id AS BIGINT) AS cluster_id, size FROM sizes ORDER BY 1", "sizes"))
def src_cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "sizes")
    text.write_pairs(I.segment_sizes(spark, sf), "cluster_id", "size", path)
    return text.read_cluster_sizes(spark, path).orderBy("cluster_id")


@query("src_id_map", sql_of("SELECT item_id, CAST(idx AS BIGINT) AS idx FROM id_map", "id_map"))
def src_id_map(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "idmap")
    text.write_pairs(I.id_map(spark, sf).withColumn("item_id", F.col("item_id").cast("double")), "item_id", "idx", path)
    return text.read_id_map(spark, path)


@query("snk_id_map", sql_of("SELECT item_id, idx FROM id_map", "id_map"))
def snk_id_map(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "idmap")
    mapping = I.id_map(spark, sf).select("item_id", "idx")
    tables.save_once(mapping, path)
    return tables.save_once(mapping.withColumn("idx", F.lit(-1)), path)  # exists: left as it is


def mixed_dyads(spark: SparkSession, sf: str) -> DataFrame:
    left = I.mixed_users(spark, sf).toDF("user_id", *[f"left_{b}" for b in tables.BLOCKS])
    right = I.mixed_items(spark, sf).toDF("item_id", *[f"right_{b}" for b in tables.BLOCKS])
    return joins.join_sides(I.labelled(spark, sf), left, right)


DYAD_SQL = """SELECT count(*) AS n, sum(CASE WHEN outcome THEN 1 ELSE 0 END)::BIGINT AS positive,
  sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END)::BIGINT AS building,
  sum(c_nationkey % 3 - 1)::BIGINT AS tri, round(sum(c_acctbal / 10000.0), 4) AS left_num,
  sum(CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END)::BIGINT AS promo, round(sum(p_retailprice / 2000.0), 4) AS right_num
  FROM outcomes JOIN customer ON c_custkey = user_id JOIN part ON p_partkey = item_id"""


def dyad_totals(rows: DataFrame) -> DataFrame:
    def flag(col) -> F.Column:
        return F.sum(F.when(col, 1).otherwise(0))

    return rows.agg(
        F.count(F.lit(1)).alias("n"), flag(F.col("label")).alias("positive"),
        flag(F.get("left_bin", F.lit(1))).alias("building"), F.sum(F.get("left_tri", F.lit(0))).alias("tri"),
        F.round(F.sum(F.get("left_num", F.lit(0))), 4).alias("left_num"),
        flag(F.get("right_bin", F.lit(3))).alias("promo"),
        F.round(F.sum(F.get("right_num", F.lit(1))), 4).alias("right_num"))


@query("snk_dyads", sql_of(f"SELECT {', '.join(str(n) + ' AS ' + w for w, n in zip(tables.WIDTHS, (5, 2, 1, 6, 0, 2)))}, "
                           "(SELECT count(*) FROM outcomes) AS n", "outcomes"))
def snk_dyads(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "dyads")
    tables.write_dyads(mixed_dyads(spark, sf), path)
    n = spark.read.parquet(f"{path}/rows").agg(F.count(F.lit(1))).scalar()
    return spark.read.parquet(f"{path}/widths").select(*tables.WIDTHS, n.alias("n"))


@query("src_dyads", sql_of(DYAD_SQL, "outcomes"))
def src_dyads(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "dyads")
    tables.write_dyads(mixed_dyads(spark, sf), path)
    return dyad_totals(tables.read_dyads(spark, path))


@query("snk_dyads_object", sql_of(DYAD_SQL, "outcomes"))
def snk_dyads_object(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "dyads")
    tables.write_dyads(mixed_dyads(spark, sf), path)
    tables.copy_dyads_orc(spark, path, path + "-orc")
    return dyad_totals(spark.read.orc(path + "-orc"))


@query("cnv_libsvm_parquet", sql_of(
    "SELECT CAST(item_id AS DOUBLE) AS label, CAST(col AS INTEGER) AS col, round(x, 6) AS value FROM items_long", "items_long"))
def cnv_libsvm_parquet(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "libsvm")
    tables.write_libsvm(I.items_vec(spark, sf), "vec", path, "item_id")
    tables.libsvm_to_parquet(spark, path, I.ITEM_WIDTH, path + "-parquet")
    return spark.read.parquet(path + "-parquet").select("label", F.posexplode("features").alias("col", "v")).select(
        "label", "col", F.round("v", 6).alias("value"))


@query("snk_codifications", sql_of(
    "SELECT item_id AS id, CAST(pos AS INTEGER) AS pos, round(value, 6) AS value FROM item_long WHERE value <> 0", "item_long"))
def snk_codifications(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "codes")
    coded = encode.item_vectors(I.scaled(spark, sf), encode.tag_vectors(I.tags(spark, sf)))
    vec = V.to_dense(F.col("bin"), F.lit(None).cast("array<tinyint>"), F.col("num"))
    dense = coded.select(F.col("item_id").alias("id"), vec.alias("vec"))
    tables.write_codes(csr.of_dense(dense, "id"), learn.width_of(dense), path)
    cells = tables.read_codes(spark, path).select("id", F.posexplode("pos").alias("at", "pos"), "val")
    return cells.select("id", "pos", F.round(F.get("val", F.col("at")), 6).alias("value"))


@query("snk_libsvm", sql_of("""SELECT count(DISTINCT id) AS n, round(sum(v), 4) AS attributes,
  (SELECT sum(u) FROM u_long)::DOUBLE AS utilities FROM x_long""", "x_long", "u_long"))
def snk_libsvm(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "labels")
    rows = I.explanation(spark, sf)
    tables.write_libsvm(rows.select(F.concat("x", F.col("u").cast("array<double>")).alias("f")), "f", path)
    x, u = tables.split_at(F.col("features"), 4)
    total = tables.read_libsvm(spark, path, 9).select(x.alias("x"), u.alias("u")).select(
        F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("x"), F.aggregate("u", F.lit(0), lambda a, v: a + v).alias("u"))
    return total.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 4).alias("attributes"),
                     F.sum("u").cast("double").alias("utilities"))


def factor_cells(spark: SparkSession, sf: str) -> DataFrame:
    cells = I.id_map(spark, sf).select(
        F.explode(F.array(F.lit("W"), F.lit("V"))).alias("side"), F.col("idx").alias("col")
    ).select("side", "col", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("row"))
    return cells.withColumn("value", F.round(((F.col("row") * 7 + F.col("col") * 3) % 11 - 5) / 10.0, 6))


@query("io_factors", sql_of("""SELECT side, CAST(row AS INTEGER) AS row, CAST(idx AS INTEGER) AS col, round(((row * 7 + idx * 3) % 11 - 5) / 10.0, 6) AS value, side = 'W' AS biased
  FROM id_map CROSS JOIN (SELECT unnest(['W', 'V']) AS side) CROSS JOIN (SELECT unnest(range(0, 3)) AS row)""", "id_map"))
def io_factors(spark: SparkSession, sf: str) -> DataFrame:
    """One matrix column per popular item on each side, written and read back."""
    path = scratch_path(spark, "factors")
    tables.write_factors(factor_cells(spark, sf), path, True, False)
    return tables.read_factors(spark, path).select("side", "row", "col", "value", "biased")


@query("io_factors_csv", sql_of("""SELECT side, CAST(row AS INTEGER) AS row, CAST(idx AS INTEGER) AS col, round(((row * 7 + idx * 3) % 11 - 5) / 10.0, 6) AS value, side = 'V' AS biased
  FROM id_map CROSS JOIN (SELECT unnest(['W', 'V']) AS side) CROSS JOIN (SELECT unnest(range(0, 3)) AS row)""", "id_map"))
def io_factors_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The same matrices as a CSV pair of several files each."""
    full = tables.write_factor_csv(factor_cells(spark, sf), scratch_path(spark, "factors"), False, True, parts=3)
    return tables.read_factor_csv(spark, full)


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")


@query("io_kmeans", "SELECT vec_id, true AS same FROM embeddings")
def io_kmeans(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    path = scratch_path(spark, "kmeans")
    fitted = cluster.kmeans(vectors(spark, sf), k=10, iterations=5, seed=1)
    fitted.write().overwrite().save(path)
    rows = vectors(spark, sf).withColumn("features", array_to_vector("vec"))
    again = KMeansModel.load(path).transform(rows).withColumnRenamed("prediction", "again")
    return fitted.transform(again).select("vec_id", (F.col("prediction") == F.col("again")).alias("same"))


@query("snk_cluster_counts", "SELECT CAST(label AS BIGINT) AS cluster_id, count(*) AS size FROM embeddings GROUP BY 1")
def snk_cluster_counts(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "counts")
    text.write_pairs(cluster.cluster_counts(vectors(spark, sf), "label"), "cluster_id", "size", path)
    return text.read_cluster_sizes(spark, path)
