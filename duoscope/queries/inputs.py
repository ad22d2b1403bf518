"""The dyadic reading of the given tables: customers rate parts through their line items."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoscope import fixed
from duoscope.functions import vectors as V
from duoscope.operators import encode, joins, splits, thresholds
from duoscope.queries.registry import view
from duoscope.session import table

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
MIN_COUNT = 35
K = 3
USER_WIDTH, ITEM_WIDTH = 8, 8
POSITIONS = 5000


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else repr(v) for v in values) + "]"


# -- interactions ---------------------------------------------------------------------------------

def ratings(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("item_id"),
        (F.col("l_quantity") / 10.0).alias("rating"))
    return joins.grown(o).join(li, "o_orderkey").select("user_id", "item_id", "rating")


view("ratings", "SELECT o_custkey AS user_id, l_partkey AS item_id, l_quantity / 10.0 AS rating "
     "FROM orders JOIN lineitem ON o_orderkey = l_orderkey")


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return encode.with_outcome(ratings(spark, sf))


view("outcomes", "SELECT user_id, item_id, rating >= 4.0 AS outcome FROM ratings", "ratings")


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return outcomes(spark, sf).withColumnRenamed("outcome", "label")


# -- items with names, years, genres and tags -----------------------------------------------------

def items(spark: SparkSession, sf: str) -> DataFrame:
    """Part names as titles with commas and years; some without a year, some malformed."""
    p = table(spark, sf, "part")
    names = F.lit(fixed.GENRES)
    year = (F.col("p_size") + 1950).cast("string")
    title = (
        F.when(F.col("p_partkey") % 10 == 7, F.col("p_name"))
        .when(F.col("p_partkey") % 10 == 8, F.concat(F.lit("a) "), F.col("p_name"), F.lit(" (b")))
        .when(F.col("p_partkey") % 10 == 9, F.concat(F.col("p_name"), F.lit(" (x"), year, F.lit(")")))
        .otherwise(F.concat(F.lit('"'), F.col("p_name"), F.lit(', The (old) ('), year, F.lit(')"')))
    )
    genres = F.concat_ws(
        "|", F.get(names, (F.col("p_partkey") % 20).cast("int")), F.get(names, F.col("p_size") % 20))
    return p.select(F.col("p_partkey").alias("item_id"), title.alias("title"), genres.alias("genres"))


_G = sql_list(fixed.GENRES)
view("items", f"""SELECT p_partkey AS item_id, CASE p_partkey % 10 WHEN 7 THEN p_name
  WHEN 8 THEN 'a) ' || p_name || ' (b' WHEN 9 THEN p_name || ' (x' || (p_size + 1950) || ')'
  ELSE '"' || p_name || ', The (old) (' || (p_size + 1950) || ')"' END AS title,
  {_G}[1 + p_partkey % 20] || '|' || {_G}[1 + p_size % 20] AS genres FROM part""")

view("parsed", r"""SELECT item_id, genres, TRY_CAST(regexp_extract(title, '\(([+-]?[0-9]+)\)[^()]*$', 1) AS INTEGER) AS year
  FROM items WHERE TRY_CAST(regexp_extract(title, '\(([+-]?[0-9]+)\)[^()]*$', 1) AS INTEGER) IS NOT NULL""", "items")
view("scaled", "SELECT *, (year - (SELECT min(year) FROM parsed)) / CAST((SELECT max(year) - min(year) FROM parsed) "
     "AS DOUBLE) AS year_scaled FROM parsed", "parsed")


def scaled(spark: SparkSession, sf: str) -> DataFrame:
    return encode.scaled_years(encode.parsed_items(items(spark, sf)))


def tags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(
        F.col("l_partkey").alias("item_id"), F.col("l_linenumber").alias("tag_id")
    ).agg(F.round(F.avg("l_discount") * 10, 6).alias("relevance"))


view("tags", "SELECT l_partkey AS item_id, l_linenumber AS tag_id, round(avg(l_discount) * 10, 6) AS relevance "
     "FROM lineitem GROUP BY 1, 2")
view("tag_width", "SELECT max(tag_id) AS w FROM tags", "tags")
view("tag_long", "SELECT i.item_id, r.pos, coalesce(t.relevance, 0.0) AS value FROM (SELECT DISTINCT item_id FROM tags) i "
     "CROSS JOIN (SELECT unnest(range(0, (SELECT w FROM tag_width))) AS pos) r "
     "LEFT JOIN tags t ON t.item_id = i.item_id AND t.tag_id = r.pos + 1", "tags", "tag_width")

view("counts", "SELECT item_id, count(*) AS n FROM ratings GROUP BY 1", "ratings")
view("id_map", f"SELECT item_id, n, CAST(row_number() OVER (ORDER BY n DESC, item_id) - 1 AS INTEGER) AS idx "
     f"FROM counts WHERE n >= {MIN_COUNT}", "counts")


def id_map(spark: SparkSession, sf: str) -> DataFrame:
    return encode.dense_index(encode.item_counts(ratings(spark, sf)), MIN_COUNT)


# user x popular item, ±1 where rated
view("user_pos", "SELECT user_id, idx AS pos, max(CASE WHEN outcome THEN 1 ELSE -1 END) AS value "
     "FROM outcomes JOIN id_map USING (item_id) GROUP BY 1, 2", "outcomes", "id_map")
# dense item vector in long form: genres, tags, year
view("item_long", f"""SELECT item_id, g.pos AS pos, CAST(contains(genres, g.name) AS DOUBLE) AS value
  FROM scaled SEMI JOIN tags USING (item_id) CROSS JOIN
  (SELECT unnest({_G}) AS name, unnest(range(0, 20)) AS pos) g
  UNION ALL SELECT item_id, 20 + pos, value FROM tag_long SEMI JOIN scaled USING (item_id)
  UNION ALL SELECT item_id, 20 + (SELECT w FROM tag_width), year_scaled FROM scaled SEMI JOIN tags USING (item_id)""",
     "scaled", "tags", "tag_long", "tag_width")


# -- small mixed vectors of both sides ------------------------------------------------------------

def mixed_users(spark: SparkSession, sf: str) -> DataFrame:
    """Customers: segment bits, two tri-state values, one number."""
    c = table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("user_id"),
        F.array(*[F.col("c_mktsegment") == s for s in SEGMENTS]).alias("bin"),
        F.array(F.col("c_nationkey") % 3 - 1, F.col("c_custkey") % 3 - 1).cast("array<tinyint>").alias("tri"),
        F.array(F.col("c_acctbal") / 10000.0).alias("num"))


def mixed_items(spark: SparkSession, sf: str) -> DataFrame:
    """Parts: type bits and two numbers."""
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("item_id"),
        F.array(*[F.col("p_type") == t for t in TYPES]).alias("bin"),
        F.lit(None).cast("array<tinyint>").alias("tri"),
        F.array(F.col("p_size") / 50.0, F.col("p_retailprice") / 2000.0).alias("num"))


def dense(mixed: DataFrame, key: str) -> DataFrame:
    return mixed.select(key, V.to_dense(F.col("bin"), F.col("tri"), F.col("num")).alias("vec"))


def users_vec(spark: SparkSession, sf: str) -> DataFrame:
    return dense(mixed_users(spark, sf), "user_id")


def items_vec(spark: SparkSession, sf: str) -> DataFrame:
    return dense(mixed_items(spark, sf), "item_id")


view("users_long", f"""SELECT c_custkey AS user_id, s.pos AS col, CAST(c_mktsegment = s.name AS DOUBLE) AS x FROM customer
  CROSS JOIN (SELECT unnest({sql_list(SEGMENTS)}) AS name, unnest(range(0, 5)) AS pos) s
  UNION ALL SELECT c_custkey, 5, CAST(c_nationkey % 3 - 1 AS DOUBLE) FROM customer
  UNION ALL SELECT c_custkey, 6, CAST(c_custkey % 3 - 1 AS DOUBLE) FROM customer
  UNION ALL SELECT c_custkey, 7, c_acctbal / 10000.0 FROM customer""")
view("items_long", f"""SELECT p_partkey AS item_id, s.pos AS col, CAST(p_type = s.name AS DOUBLE) AS x FROM part
  CROSS JOIN (SELECT unnest({sql_list(TYPES)}) AS name, unnest(range(0, 6)) AS pos) s
  UNION ALL SELECT p_partkey, 6, p_size / 50.0 FROM part
  UNION ALL SELECT p_partkey, 7, p_retailprice / 2000.0 FROM part""")
view("users_bias", f"SELECT * FROM users_long UNION ALL SELECT c_custkey, {USER_WIDTH}, 1.0 FROM customer", "users_long")
view("items_bias", f"SELECT * FROM items_long UNION ALL SELECT p_partkey, {ITEM_WIDTH}, 1.0 FROM part", "items_long")


def matrix(k: int, d: int, shift: int = 0) -> np.ndarray:
    """Arithmetic stand-in for learned factors, the same in Spark and SQL."""
    row, col = np.indices((k, d))
    return ((row * 7 + col * 3 + shift) % 11 - 5) / 10.0


def factor_sql(k: int, d: int, shift: int = 0) -> str:
    return (f"SELECT r.row AS row, c.col AS col, ((r.row * 7 + c.col * 3 + {shift}) % 11 - 5) / 10.0 AS value FROM "
            f"(SELECT unnest(range(0, {k})) AS row) r CROSS JOIN (SELECT unnest(range(0, {d})) AS col) c")


view("w", factor_sql(K, USER_WIDTH + 1))
view("v", factor_sql(K, ITEM_WIDTH + 1, 2))
view("pu", "SELECT user_id, row, sum(x * value) AS p FROM users_bias JOIN w USING (col) GROUP BY 1, 2", "users_bias", "w")
view("pi", "SELECT item_id, row, sum(x * value) AS p FROM items_bias JOIN v USING (col) GROUP BY 1, 2", "items_bias", "v")


# -- explanation rows: part attributes and what each customer segment thinks ----------------------------

ATTRIBUTES = ["size", "price", "economy", "name length"]


def explanation(spark: SparkSession, sf: str) -> DataFrame:
    """Parts having line items: four attributes and a 0/1 utility per segment."""
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.array(F.col("p_size").cast("double"), F.col("p_retailprice"),
                (F.col("p_type") == "ECONOMY").cast("double"), F.length("p_name").cast("double")).alias("x"))
    segment = F.array_position(F.lit(SEGMENTS), F.col("c_mktsegment")) - 1
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), segment.alias("seg"))
    rated = ratings(spark, sf).join(joins.grown(c), "user_id")
    # quantity > 25.5 on average; one aggregation per part with a conditional mean per segment
    means = [F.avg(F.when(F.col("seg") == i, F.col("rating") * 10)) for i in range(len(SEGMENTS))]
    liked = rated.groupBy(F.col("item_id").alias("id")).agg(
        F.array(*[F.coalesce(F.when(F.round(m, 6) > 25.5, 1), F.lit(0)) for m in means]).alias("u"))
    return joins.grown(p).join(liked, "id")


def segment_sizes(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    seg = (F.array_position(F.lit(SEGMENTS), F.col("c_mktsegment")) - 1).cast("int")
    return c.groupBy(seg.alias("cluster_id")).agg(F.count(F.lit(1)).alias("size"))


def thresholds_list(spark: SparkSession, rows: DataFrame) -> list[list[float]]:
    return [r["thr"] for r in sorted(thresholds.thresholds(rows).collect())]


def size_array(spark: SparkSession, sf: str):
    return splits.cluster_sizes_array(segment_sizes(spark, sf))


_SEG = sql_list(SEGMENTS)
view("segs", f"SELECT unnest({_SEG}) AS name, unnest(range(0, 5)) AS seg")
view("sizes", "SELECT CAST(seg AS INTEGER) AS cluster_id, count(*) AS size FROM customer JOIN segs ON c_mktsegment = name GROUP BY 1", "segs")
view("seg_mean", "SELECT l_partkey AS id, seg, CASE WHEN round(avg(l_quantity), 6) > 25.5 THEN 1 ELSE 0 END AS u "
     "FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey "
     "JOIN segs ON c_mktsegment = name GROUP BY 1, 2", "segs")
view("ids", "SELECT DISTINCT id FROM seg_mean", "seg_mean")
view("u_long", "SELECT i.id, s.seg, coalesce(m.u, 0) AS u FROM ids i CROSS JOIN segs s "
     "LEFT JOIN seg_mean m ON m.id = i.id AND m.seg = s.seg", "ids", "segs", "seg_mean")
view("x_long", """SELECT p_partkey AS id, 0 AS var, CAST(p_size AS DOUBLE) AS v FROM part SEMI JOIN ids ON id = p_partkey
  UNION ALL SELECT p_partkey, 1, p_retailprice FROM part SEMI JOIN ids ON id = p_partkey
  UNION ALL SELECT p_partkey, 2, CAST(p_type = 'ECONOMY' AS DOUBLE) FROM part SEMI JOIN ids ON id = p_partkey
  UNION ALL SELECT p_partkey, 3, CAST(length(p_name) AS DOUBLE) FROM part SEMI JOIN ids ON id = p_partkey""", "ids")
view("freq", "SELECT var, v, count(*) AS c FROM x_long GROUP BY 1, 2", "x_long")
view("vals", "SELECT var, v, c, row_number() OVER (PARTITION BY var ORDER BY v) AS i, "
     "count(*) OVER (PARTITION BY var) AS d, sum(c) OVER (PARTITION BY var) / 10.0 AS want FROM freq", "freq")
# The greedy cuts as a recursion over the sorted values; t1 and t2 are the cuts added by the value.
view("fold", """SELECT var, CAST(0 AS BIGINT) AS i, max(want) AS room, NULL::DOUBLE AS start, NULL::DOUBLE AS last,
    NULL::DOUBLE AS prev, NULL::DOUBLE AS t1, NULL::DOUBLE AS t2 FROM vals WHERE d > 10 GROUP BY var
  UNION ALL
  SELECT v.var, v.i,
    CASE WHEN f.room - v.c > 0 THEN f.room - v.c WHEN v.c > 2 * f.room AND v.c <= v.want THEN v.want - v.c ELSE v.want END,
    CASE WHEN f.room - v.c > 0 THEN coalesce(f.start, v.v) WHEN v.c > 2 * f.room AND v.c <= v.want THEN v.v END,
    CASE WHEN f.room - v.c > 0 THEN f.last ELSE v.v END,
    v.v,
    CASE WHEN f.room - v.c <= 0 THEN coalesce((f.last + coalesce(f.start, v.v)) / 2, f.start, v.v) END,
    CASE WHEN f.room - v.c <= 0 AND v.c > 2 * f.room AND v.c > v.want THEN (f.prev + v.v) / 2 END
  FROM fold f JOIN vals v ON v.var = f.var AND v.i = f.i + 1""", "vals")
view("cuts", """SELECT a.var, a.i * 2.0 AS ord, (a.v + b.v) / 2 AS t FROM vals a JOIN vals b ON a.var = b.var AND b.i = a.i + 1 WHERE a.d <= 10
  UNION ALL SELECT var, i * 2.0, t1 FROM fold WHERE t1 IS NOT NULL
  UNION ALL SELECT var, i * 2.0 + 1, t2 FROM fold WHERE t2 IS NOT NULL
  UNION ALL SELECT f.var, f.i * 2.0 + 2, coalesce((f.last + f.start) / 2, f.last) FROM fold f JOIN
    (SELECT var, max(d) AS d FROM vals GROUP BY 1) m ON m.var = f.var AND m.d = f.i AND f.i > 0""", "vals", "fold")
view("thr", "SELECT var, row_number() OVER (PARTITION BY var ORDER BY ord) - 1 AS pos, t FROM cuts", "cuts")
view("binned", "SELECT x.id, x.var, x.v, (SELECT count(*) FROM thr WHERE thr.var = x.var AND thr.t <= x.v) AS bin FROM x_long x",
     "x_long", "thr")
view("hist", "SELECT var, bin, seg, count(*) AS n, sum(u) AS pos FROM binned JOIN u_long USING (id) GROUP BY 1, 2, 3",
     "binned", "u_long")


def entropy_sql(pos: str, n: str) -> str:
    p = f"(CAST({pos} AS DOUBLE) / {n})"
    return (f"CASE WHEN {p} > 0 AND {p} < 1 THEN -{p} * log2({p}) - (1 - {p}) * log2(1 - {p}) ELSE 0.0 END")


view("total_size", "SELECT CAST(sum(size) AS DOUBLE) AS total FROM sizes", "sizes")
view("prefix", "SELECT var, bin, seg, sum(n) OVER w AS ln, sum(pos) OVER w AS lp, sum(n) OVER a AS n, sum(pos) OVER a AS p "
     "FROM hist WINDOW w AS (PARTITION BY var, seg ORDER BY bin), a AS (PARTITION BY var, seg)", "hist")
view("scores", f"""SELECT var, bin, max(ln) / CAST(max(n) AS DOUBLE) AS left_ratio, 1 - max(ln) / CAST(max(n) AS DOUBLE) AS right_ratio,
    sum(({entropy_sql('lp', 'ln')}) * size / total) AS left_we,
    sum(({entropy_sql('p - lp', '(n - ln)')}) * size / total) AS right_we
  FROM prefix JOIN sizes ON seg = cluster_id CROSS JOIN total_size WHERE ln < n GROUP BY 1, 2""",
     "prefix", "sizes", "total_size")
view("ranked", "SELECT *, round(left_we * left_ratio + right_we * right_ratio, 12) AS we, row_number() OVER "
     "(PARTITION BY var ORDER BY round(left_we * left_ratio + right_we * right_ratio, 12), bin) AS rn FROM scores", "scores")
view("best", "SELECT r.*, t AS split_value FROM ranked r JOIN thr ON thr.var = r.var AND thr.pos = r.bin WHERE rn = 1",
     "ranked", "thr")


# -- the same with many clusters: 30 arithmetic attributes of a part, and what 400 groups of customers think ------------

WIDE_VARS, WIDE_GROUPS = 30, 400


def wide_explanation(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array(
        *[((F.col("p_partkey") * (j + 3) + F.col("p_size")) % (11 + j)).cast("double") for j in range(WIDE_VARS)]).alias("x"))
    rated = ratings(spark, sf).select(F.col("item_id").alias("id"), (F.col("user_id") % WIDE_GROUPS).alias("pos"), "rating")
    liked = rated.groupBy("id", "pos").agg(F.when(F.round(F.avg(F.col("rating") * 10), 6) > 25.5, 1).otherwise(0).alias("value"))
    entries = liked.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("entries"))
    return joins.grown(p).join(entries.select("id", V.fill_positions(F.col("entries"), F.lit(WIDE_GROUPS), "int").alias("u")), "id")


def wide_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").groupBy((F.col("c_custkey") % WIDE_GROUPS).cast("int").alias("cluster_id")).agg(F.count(F.lit(1)).alias("size"))


view("many_ids", "SELECT DISTINCT l_partkey AS id FROM lineitem", kept=True)
view("many_sizes", f"SELECT CAST(c_custkey % {WIDE_GROUPS} AS INTEGER) AS cluster_id, count(*) AS size FROM customer GROUP BY 1")
view("many_mean", f"""SELECT l_partkey AS id, o_custkey % {WIDE_GROUPS} AS seg, CASE WHEN round(avg(l_quantity), 6) > 25.5 THEN 1 ELSE 0 END AS u
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""")
view("many_u_long", f"SELECT i.id, s.seg, coalesce(m.u, 0) AS u FROM many_ids i CROSS JOIN (SELECT unnest(range(0, {WIDE_GROUPS})) AS seg) s "
     "LEFT JOIN many_mean m ON m.id = i.id AND m.seg = s.seg", "many_ids", "many_mean", kept=True)
view("many_x_long", f"SELECT p_partkey AS id, var, CAST((p_partkey * (var + 3) + p_size) % (11 + var) AS DOUBLE) AS v FROM part SEMI JOIN many_ids ON id = p_partkey "
     f"CROSS JOIN (SELECT CAST(unnest(range(0, {WIDE_VARS})) AS INTEGER) AS var)", "many_ids", kept=True)
