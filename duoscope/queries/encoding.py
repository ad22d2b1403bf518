"""Encoders, projections and scalar functions."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoscope import fixed
from duoscope.functions import draws
from duoscope.functions import scalars as S
from duoscope.functions import vectors as V
from duoscope.operators import cluster, csr, encode, joins, project, sample
from duoscope.queries import inputs as I
from duoscope.queries.registry import query, sql_of, view
from duoscope.session import cut_lineage, scratch_path, spread, table
from duoscope.sources import tables


def long(df: DataFrame, key: str, vec: str = "vec", pos: str = "pos", value: str = "value", digits: int = 6) -> DataFrame:
    """Vector to rounded rows ``(key, pos, value)``."""
    return df.select(key, F.posexplode(vec).alias(pos, "_v")).select(
        key, pos, F.round(F.col("_v").cast("double"), digits).alias(value))


# -- items ------------------------------------------------------------------------------------------

@query("prj_outcome", sql_of("SELECT outcome, count(*) AS n FROM outcomes GROUP BY 1", "outcomes"))
def prj_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return I.outcomes(spark, sf).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("prj_year", sql_of("SELECT item_id, year FROM parsed", "parsed"))
def prj_year(spark: SparkSession, sf: str) -> DataFrame:
    year = S.title_year(F.col("title"))
    return I.items(spark, sf).select("item_id", year.alias("year")).where("year IS NOT NULL")


@query("prj_multihot", sql_of(f"SELECT item_id, CAST(pos AS INTEGER) AS pos, contains(genres, name) AS hot FROM items CROSS JOIN "
                              f"(SELECT unnest({I.sql_list(fixed.GENRES)}) AS name, unnest(range(0, 20)) AS pos)", "items"))
def prj_multihot(spark: SparkSession, sf: str) -> DataFrame:
    hot = S.multi_hot(F.col("genres"))
    return I.items(spark, sf).select("item_id", F.posexplode(hot).alias("pos", "hot"))


@query("prj_minmax", sql_of("SELECT item_id, round(year_scaled, 6) AS year_scaled FROM scaled", "scaled"))
def prj_minmax(spark: SparkSession, sf: str) -> DataFrame:
    return I.scaled(spark, sf).select("item_id", F.round("year_scaled", 6).alias("year_scaled"))


@query("prj_split_at", sql_of("""SELECT id, CAST(var AS INTEGER) AS pos, 'x' AS part, round(v, 6) AS value FROM x_long
  UNION ALL SELECT id, CAST(seg AS INTEGER), 'u', CAST(u AS DOUBLE) FROM u_long""", "x_long", "u_long"))
def prj_split_at(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.explanation(spark, sf).select("id", F.concat("x", F.col("u").cast("array<double>")).alias("f"))
    x, u = tables.split_at(F.col("f"), 4)
    parts = rows.select("id", F.explode(F.array(
        F.struct(F.lit("x").alias("part"), x.alias("vec")),
        F.struct(F.lit("u").alias("part"), u.cast("array<double>").alias("vec")))).alias("p"))
    return parts.select("id", "p.part", F.posexplode("p.vec").alias("pos", "v")).select(
        "id", "part", "pos", F.round("v", 6).alias("value"))


@query("enc_dense", sql_of("SELECT user_id, CAST(col AS INTEGER) AS pos, round(x, 6) AS value FROM users_long", "users_long"))
def enc_dense(spark: SparkSession, sf: str) -> DataFrame:
    return long(I.users_vec(spark, sf), "user_id")


@query("enc_undense", """SELECT c_custkey AS user_id, c_mktsegment = 'BUILDING' AS second_bit,
  CAST(CASE WHEN c_nationkey % 3 = 0 THEN 0 WHEN c_nationkey % 3 = 1 THEN 1 ELSE -1 END AS INTEGER) AS first_tri,
  CAST(CASE WHEN c_acctbal / 1000.0 = 0 THEN 0 WHEN c_acctbal / 1000.0 = 1 THEN 1 ELSE -1 END AS INTEGER) AS odd_tri,
  TRUE AS no_numbers FROM customer""")
def enc_undense(spark: SparkSession, sf: str) -> DataFrame:
    """Tri-state values other than 0 and 1 decode to -1; a block of width 0 is null."""
    rows = I.users_vec(spark, sf).join(
        table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_nationkey", "c_acctbal"), "user_id")
    dense = F.concat(F.slice("vec", 1, 5), F.array(
        (F.col("c_nationkey") % 3).cast("double"), F.col("c_acctbal") / 1000.0))
    b, t, n = V.from_dense(dense, 5, 2)
    return rows.select("user_id", F.get(b, F.lit(1)).alias("second_bit"), F.get(t, F.lit(0)).cast("int").alias("first_tri"),
                       F.get(t, F.lit(1)).cast("int").alias("odd_tri"), n.isNull().alias("no_numbers"))


@query("enc_widths", """SELECT CAST(max(5) AS INTEGER) AS bin, CAST(min(5) AS INTEGER) AS bin_min, CAST(max(2) AS INTEGER) AS tri,
  CAST(min(2) AS INTEGER) AS tri_min, CAST(max(1) AS INTEGER) AS num, CAST(min(1) AS INTEGER) AS num_min FROM customer""")
def enc_widths(spark: SparkSession, sf: str) -> DataFrame:
    return V.block_widths(I.mixed_users(spark, sf), "bin", "tri", "num")


@query("enc_tags", sql_of("SELECT item_id, CAST(pos AS INTEGER) AS pos, round(value, 6) AS value FROM tag_long", "tag_long"))
def enc_tags(spark: SparkSession, sf: str) -> DataFrame:
    return long(encode.tag_vectors(I.tags(spark, sf)), "item_id")


view("user_tri", """SELECT u.user_id, i.idx, coalesce(p.value, 0) AS value FROM (SELECT DISTINCT user_id FROM user_pos) u
  CROSS JOIN id_map i LEFT JOIN user_pos p ON p.user_id = u.user_id AND p.pos = i.idx""", "user_pos", "id_map")


@query("enc_user_tri", sql_of("SELECT user_id, CAST(pos AS INTEGER) AS pos, CAST(value AS INTEGER) AS value, (SELECT count(*) FROM id_map)::INTEGER AS width FROM user_pos",
                              "user_pos", "id_map"))
def enc_user_tri(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse tri-state vectors: what a user rated, next to the width of the vector."""
    mapping = cut_lineage(I.id_map(spark, sf))
    users = csr.of_entries(encode.user_entries(I.outcomes(spark, sf), mapping), "user_id")
    places = users.select("user_id", F.posexplode("pos").alias("at", "pos"), "val").select(
        "user_id", "pos", F.get("val", F.col("at")).cast("int").alias("value"))
    return places.select("*", F.lit(mapping.count()).cast("int").alias("width"))


@query("enc_item", sql_of("SELECT item_id, CAST(pos AS INTEGER) AS pos, round(value, 6) AS value FROM item_long", "item_long"))
def enc_item(spark: SparkSession, sf: str) -> DataFrame:
    coded = encode.item_vectors(I.scaled(spark, sf), encode.tag_vectors(I.tags(spark, sf)))
    return long(I.dense(coded.withColumn("tri", F.lit(None).cast("array<tinyint>")), "item_id"), "item_id")


@query("enc_item_names", sql_of(f"""SELECT CAST(pos AS INTEGER) AS var, name, 'genre' AS kind FROM (SELECT unnest({I.sql_list(fixed.GENRES)}) AS name, unnest(range(0, 20)) AS pos)
  UNION ALL SELECT CAST(19 + tag_id AS INTEGER), 'tag ' || tag_id, 'tag' FROM (SELECT DISTINCT tag_id FROM tags) UNION ALL SELECT CAST(20 + w AS INTEGER), 'Year', 'year' FROM tag_width""", "tags", "tag_width"))
def enc_item_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of the positions of item vectors."""
    tags = I.tags(spark, sf)
    names = tags.select("tag_id").distinct().select((F.col("tag_id") - 1).cast("int").alias("pos"), F.concat(F.lit("tag "), F.col("tag_id").cast("string")).alias("name"))
    return encode.item_variables(names, tags.agg(F.max("tag_id")).first()[0])


@query("enc_user_names", sql_of("SELECT idx AS var, title AS name, 'item' AS kind FROM items JOIN id_map USING (item_id)", "items", "id_map"))
def enc_user_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of the positions of user vectors: the titles of the popular items."""
    return encode.user_variables(I.items(spark, sf), I.id_map(spark, sf))


view("popular_proj", "SELECT idx, row, p FROM id_map JOIN pi USING (item_id)", "id_map", "pi")
view("pair_scores", "SELECT pu.user_id, q.idx, sum(pu.p * q.p) AS d FROM pu JOIN popular_proj q USING (row) GROUP BY 1, 2",
     "pu", "popular_proj")


def model() -> project.UtilityModel:
    return project.UtilityModel(
        I.matrix(I.K, I.USER_WIDTH + 1), I.matrix(I.K, I.ITEM_WIDTH + 1, 2), 1.0, True, True)


def popular_vectors(spark: SparkSession, sf: str) -> DataFrame:
    mapping = tables.save_once(I.id_map(spark, sf), scratch_path(spark, "id-map"))
    return mapping.select("item_id", "idx").join(joins.grown(I.items_vec(spark, sf)), "item_id", "left")


_PREDICTED = sql_of("""SELECT user_id, '[' || string_agg(CASE WHEN round(d, 9) > 0 THEN '1' ELSE '-1' END, ',' ORDER BY idx) || ']' AS tri
  FROM pair_scores GROUP BY 1""", "pair_scores")


def predicted(spark: SparkSession, sf: str) -> cluster.Predictions:
    return cluster.Predictions(I.users_vec(spark, sf), popular_vectors(spark, sf), model())


@query("enc_user_predicted", _PREDICTED)
def enc_user_predicted(spark: SparkSession, sf: str) -> DataFrame:
    """Liked positions, spelt out only to be shown; every popular item has a vector here."""
    users = predicted(spark, sf)
    known, width = users.known, users.width
    assert len(known) == width
    if len(set(known)) == width:
        rows = users.spelt((["1"] * width, ["-1"] * width), ",").withColumnRenamed("text", "marks")
    else:  # an item with several rows has a value for each that is liked
        filled = V.fill_positions(F.transform("liked", lambda p: F.struct(p.alias("pos"), F.lit(1).alias("value"))), F.lit(width), "int")
        rows = users.liked().withColumn("marks", F.array_join(F.transform(filled, lambda m: m * 2 - 1), ","))
    return rows.select("user_id", F.concat(F.lit("["), "marks", F.lit("]")).alias("tri"))


@query("jn_cross_popular", sql_of("""SELECT user_id, count(*) AS pairs, sum(CASE WHEN round(d, 9) > 0 THEN 1 ELSE 0 END)::BIGINT AS liked
  FROM pair_scores GROUP BY 1""", "pair_scores"))
def jn_cross_popular(spark: SparkSession, sf: str) -> DataFrame:
    """Every user against every popular item, never as pair rows: items of like directions count together where all are on one side."""
    users = predicted(spark, sf)
    return users.counts().select("user_id", F.lit(len(users.known)).cast("bigint").alias("pairs"), F.col("n").alias("liked"))


@query("enc_labeled_point", sql_of("""SELECT o_orderkey AS order_id, CAST(o_totalprice > 200000 AS DOUBLE) AS label, CAST(col AS INTEGER) AS pos, round(x, 6) AS value
  FROM orders JOIN users_long ON user_id = o_custkey""", "users_long"))
def enc_labeled_point(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), "o_totalprice")
    points = o.join(I.users_vec(spark, sf), "user_id").select(
        F.col("o_orderkey").alias("order_id"), *tables.labeled_point(F.col("o_totalprice") > 200000, F.col("vec")))
    return points.select("order_id", "label", F.posexplode(vector_to_array("features")).alias("pos", "v")).select(
        "order_id", "label", "pos", F.round("v", 6).alias("value"))


# -- categorical points ---------------------------------------------------------------------------------

def points(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as points: priority and status codes, then price and key parity."""
    o = table(spark, sf, "orders")
    status = F.array_position(F.lit(["F", "O", "P"]), F.col("o_orderstatus")) - 1
    f = F.array(F.substring("o_orderpriority", 1, 1).cast("double"), status.cast("double"),
                F.col("o_totalprice") / 1000.0, (F.col("o_custkey") % 7).cast("double"))
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 3).cast("double").alias("label"), f.alias("features"))


view("points", """SELECT o_orderkey AS id, CAST(o_custkey % 3 AS DOUBLE) AS label, CAST(left(o_orderpriority, 1) AS INTEGER) AS c0,
  CAST(list_position(['F','O','P'], o_orderstatus) - 1 AS INTEGER) AS c1, o_totalprice / 1000.0 AS n0, CAST(o_custkey % 7 AS DOUBLE) AS n1 FROM orders""")


view("avgs", "SELECT avg(n0) AS a0, avg(n1) AS a1 FROM points", "points")


@query("enc_cat_from_points", sql_of("""SELECT id, label = 1 AS label, c0, c1, round(n0, 6) AS n0, n1, (SELECT max(c0) FROM points) AS m0,
  (SELECT max(c1) FROM points) AS m1 FROM points""", "points"))
def enc_cat_from_points(spark: SparkSession, sf: str) -> DataFrame:
    return flat_points(encode.categorical_points(points(spark, sf), 2, 2, False))


def flat_points(coded: DataFrame) -> DataFrame:
    def at(name: str, i: int):
        return F.get(name, F.lit(i))

    return coded.select("id", "label", at("cat", 0).alias("c0"), at("cat", 1).alias("c1"), F.round(at("num", 0), 6).alias("n0"),
                        F.round(at("num", 1), 6).alias("n1"), at("maxima", 0).alias("m0"), at("maxima", 1).alias("m1"))


@query("enc_cat_normalised", sql_of("""SELECT id, label = 1 AS label, c0, c1,
  round((n0 - a0) / sqrt((SELECT sum((n0 - a0) * (n0 - a0)) FROM points CROSS JOIN avgs)), 6) AS n0,
  round((n1 - a1) / sqrt((SELECT sum((n1 - a1) * (n1 - a1)) FROM points CROSS JOIN avgs)), 6) AS n1,
  (SELECT max(c0) FROM points) AS m0, (SELECT max(c1) FROM points) AS m1 FROM points CROSS JOIN avgs""", "points", "avgs"))
def enc_cat_normalised(spark: SparkSession, sf: str) -> DataFrame:
    return flat_points(encode.categorical_points(points(spark, sf), 2, 2, True))


view("hot", """SELECT id, CAST(pos AS INTEGER) AS pos, pos = c0 AS hot FROM points CROSS JOIN (SELECT unnest(range(0, (SELECT max(c0) + 1 FROM points))) AS pos)
  UNION ALL SELECT id, CAST(pos + (SELECT max(c0) + 1 FROM points) AS INTEGER), pos = c1 FROM points CROSS JOIN (SELECT unnest(range(0, (SELECT max(c1) + 1 FROM points))) AS pos)""", "points")


@query("enc_onehot", sql_of("SELECT id, pos, hot FROM hot", "hot"))
def enc_onehot(spark: SparkSession, sf: str) -> DataFrame:
    coded = encode.categorical_points(points(spark, sf), 2, 2, False)
    slots = F.transform("maxima", lambda m: m + 1)
    return coded.select("id", F.posexplode(V.one_hot(F.col("cat"), slots)).alias("pos", "hot"))


@query("enc_combinations", sql_of("SELECT CAST((max(c0) + 1) * (max(c1) + 1) AS DOUBLE) AS combinations FROM points", "points"))
def enc_combinations(spark: SparkSession, sf: str) -> DataFrame:
    maxima = points(spark, sf).agg(F.array(*[F.max(F.get("features", F.lit(i))) for i in range(2)]).alias("m"))
    return maxima.select(V.combinations(F.col("m")).alias("combinations"))


# -- projections ------------------------------------------------------------------------------------------

@query("vec_project", sql_of("SELECT user_id, CAST(row AS INTEGER) AS row, round(p, 8) AS value FROM pu", "pu"))
def vec_project(spark: SparkSession, sf: str) -> DataFrame:
    """Through sparse lists: zero bits and missing states are neither stored nor multiplied."""
    users = csr.of_dense(I.users_vec(spark, sf), "user_id")
    mapped = users.select("user_id", csr.projection(F.col("pos"), F.col("val"), I.matrix(I.K, I.USER_WIDTH + 1), True).alias("vec"))
    return long(mapped, "user_id", pos="row", digits=8)


# one explicit cardinality for encoder and matrix: slots 6 and 3, then the numbers and the bias
view("cat_long", """SELECT id, pos AS col, CAST(hot AS DOUBLE) AS x FROM hot UNION ALL SELECT id, (SELECT max(c0) + max(c1) + 2 FROM points), n0 FROM points
  UNION ALL SELECT id, (SELECT max(c0) + max(c1) + 3 FROM points), n1 FROM points
  UNION ALL SELECT id, (SELECT max(c0) + max(c1) + 4 FROM points), 1.0 FROM points""", "points", "hot")
view("cat_w", I.factor_sql(I.K, 64))


def cat_dense(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    coded = encode.categorical_points(points(spark, sf), 2, 2, False)
    slots = F.transform("maxima", lambda m: m + 1)
    dense = coded.select("id", F.concat(V.one_hot(F.col("cat"), slots).cast("array<double>"), "num").alias("vec"))
    return dense, dense.select(F.size("vec")).first()[0]


@query("vec_project_cat", sql_of("SELECT id, CAST(row AS INTEGER) AS row, round(sum(x * value), 8) AS value FROM cat_long JOIN cat_w USING (col) GROUP BY 1, 2",
                                 "cat_long", "cat_w"))
def vec_project_cat(spark: SparkSession, sf: str) -> DataFrame:
    dense, width = cat_dense(spark, sf)
    mapped = dense.select("id", project.project(F.col("vec"), I.matrix(I.K, width + 1), True).alias("vec"))
    return long(mapped, "id", pos="row", digits=8)


def outer_rows(df: DataFrame, key: str) -> DataFrame:
    """Non-zero cells of v2 ⊗ x for v2 = (50, 100), with the bias."""
    v2 = F.array(F.lit(50.0), F.lit(100.0))
    rows = df.select(key, F.posexplode(project.outer(F.col("vec"), v2, True)).alias("row", "r"))
    return rows.select(key, "row", F.posexplode("r").alias("col", "v")).where("v <> 0").select(
        key, "row", "col", F.round("v", 6).alias("value"))


def _outer_sql(key: str, source: str) -> str:
    return sql_of(f"SELECT {key}, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, round((row + 1) * 50.0 * x, 6) AS value "
                  f"FROM {source} CROSS JOIN (SELECT unnest([0, 1]) AS row) WHERE x <> 0", source)


@query("vec_outer", _outer_sql("user_id", "users_bias"))
def vec_outer(spark: SparkSession, sf: str) -> DataFrame:
    return outer_rows(I.users_vec(spark, sf), "user_id")


@query("vec_outer_cat", _outer_sql("id", "cat_long"))
def vec_outer_cat(spark: SparkSession, sf: str) -> DataFrame:
    return outer_rows(cat_dense(spark, sf)[0], "id")


@query("vec_normalise_cols", sql_of("""SELECT CAST(row AS INTEGER) AS row, CAST(idx AS INTEGER) AS col, round(a / greatest(1.0, sqrt(sum(a * a) OVER (PARTITION BY idx))), 6) AS value
  FROM (SELECT row, idx, ((row * 7 + idx * 3) % 11 - 5) / 5.0 AS a FROM id_map CROSS JOIN (SELECT unnest(range(0, 3)) AS row))""", "id_map"))
def vec_normalise_cols(spark: SparkSession, sf: str) -> DataFrame:
    cells = I.id_map(spark, sf).select(F.lit("W").alias("side"), F.col("idx").alias("col"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("row"))
    clipped = project.clip_columns(cells.withColumn("value", ((F.col("row") * 7 + F.col("col") * 3) % 11 - 5) / 5.0))
    return clipped.select("row", "col", F.round("value", 6).alias("value"))


# -- scalar functions -----------------------------------------------------------------------------------------

@query("fn_sigmoid", "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, round(1.0 / (1.0 + exp(-(l_quantity - 25.5) / 2.0)), 6) AS u FROM lineitem")
def fn_sigmoid(spark: SparkSession, sf: str) -> DataFrame:
    u = S.sigmoid(F.col("l_quantity") - 25.5, 2.0)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", F.round(u, 6).alias("u"))


@query("fn_bin", sql_of("""SELECT id, CAST(var AS INTEGER) AS var, CAST(bin AS INTEGER) AS bin,
  (SELECT round(t, 6) FROM thr WHERE thr.var = b.var AND thr.pos = b.bin) AS upper FROM binned b""", "binned", "thr"))
def fn_bin(spark: SparkSession, sf: str) -> DataFrame:
    """Bin and upper bound per value; the open upper bound (infinity) is shown as null."""
    rows = cut_lineage(I.explanation(spark, sf))
    thr = F.lit([[float(t) for t in ts] for ts in I.thresholds_list(spark, rows)])
    long_rows = rows.select("id", F.posexplode("x").alias("var", "v")).withColumn("t", F.get(thr, F.col("var")))
    b = S.bin_of(F.col("v"), F.col("t"))
    upper = S.bin_upper(b, F.col("t"))
    return long_rows.select("id", "var", b.alias("bin"), F.when(upper < float("inf"), F.round(upper, 6)).alias("upper"))


@query("fn_year_label", sql_of(f"""SELECT item_id, printf('< %.1f', round(year_scaled * {fixed.MAX_YEAR - fixed.MIN_YEAR} + {fixed.MIN_YEAR}, 1)) AS low_name,
  printf('> %.1f', round(year_scaled * {fixed.MAX_YEAR - fixed.MIN_YEAR} + {fixed.MIN_YEAR}, 1)) AS high_name FROM scaled""", "scaled"))
def fn_year_label(spark: SparkSession, sf: str) -> DataFrame:
    low, high = S.split_names(F.lit("year"), F.col("year_scaled"))
    return I.scaled(spark, sf).select("item_id", low.alias("low_name"), high.alias("high_name"))


_A, _B = draws.pair_sql(7, "idx")


@query("smp_init", sql_of(f"""SELECT CAST(row AS INTEGER) AS row, idx AS col, round(((a + row * b) % {draws.P}) / {float(draws.P)!r} - 0.5, 9) AS value FROM
  (SELECT idx, {_A} AS a, {_B} AS b FROM id_map) CROSS JOIN (SELECT unnest(range(0, 10)) AS row)""", "id_map"))
def smp_init(spark: SparkSession, sf: str) -> DataFrame:
    """Start factors with one column per popular item."""
    cells = sample.random_factors(I.id_map(spark, sf).select(F.col("idx").alias("col")), 10, 7)
    return cells.select("row", "col", F.round("value", 9).alias("value"))


def tri_sql(seed: int, name: str) -> str:
    a, b = draws.pair_sql(seed, "o_orderkey")
    return (f"SELECT o_orderkey AS id, string_agg(CASE WHEN x < {draws.limit(0.33)} THEN '-1' WHEN x >= {draws.limit(0.67)} THEN '1' ELSE '0' END, "
            f"',' ORDER BY i) AS {name} FROM (SELECT o_orderkey, i, (a + i * b) % {draws.P} AS x FROM (SELECT o_orderkey, {a} AS a, {b} AS b FROM orders) "
            "CROSS JOIN (SELECT unnest(range(0, 10)) AS i)) GROUP BY 1")


@query("smp_synthetic", f"SELECT id, left_tri, right_tri FROM ({tri_sql(1, 'left_tri')}) JOIN ({tri_sql(2, 'right_tri')}) USING (id)")
def smp_synthetic(spark: SparkSession, sf: str) -> DataFrame:
    """A random tri-state vector on each side of every order."""
    ids = spread(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), "id")
    left = sample.random_tri_vectors(ids, 10, 1).withColumnRenamed("vec", "left_vec")
    return left.join(sample.random_tri_vectors(ids, 10, 2), "id").select(
        "id", F.array_join(F.col("left_vec").cast("array<int>"), ",").alias("left_tri"),
        F.array_join(F.col("vec").cast("array<int>"), ",").alias("right_tri"))
