"""Filters, joins, aggregations, ranking and sorting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoscope import fixed
from duoscope.functions import scalars as S
from duoscope.operators import encode, joins, splits, thresholds
from duoscope.queries import inputs as I
from duoscope.queries.files import write_lines
from duoscope.queries.registry import query, sql_of
from duoscope.session import cut_lineage, scratch_path, spread, table

INF = float("inf")


# -- filters -----------------------------------------------------------------------------------------

@query("flt_header", "SELECT count(*) AS n FROM part")
def flt_header(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "header")
    write_lines(table(spark, sf, "part").select(F.concat_ws(",", F.col("p_partkey").cast("string"), "p_name", "p_type").alias("value")),
                fixed.ITEMS_HEADER, path)
    return spark.read.text(path).where(F.col("value") != fixed.ITEMS_HEADER).agg(F.count(F.lit(1)).alias("n"))


@query("flt_interval", sql_of("SELECT a.id FROM x_long a WHERE a.var = 0 AND a.v > 10.0 AND a.v < 30.0", "x_long"))
def flt_interval(spark: SparkSession, sf: str) -> DataFrame:
    filt = F.struct(F.lit(0).alias("var"), F.lit(10.0).alias("lo"), F.lit(30.0).alias("hi"))
    return I.explanation(spark, sf).where(S.filter_holds(F.col("x"), filt)).select("id")


@query("flt_conjunction", sql_of("""SELECT a.id FROM x_long a JOIN x_long b USING (id) JOIN x_long c USING (id) WHERE a.var = 0 AND b.var = 1 AND c.var = 3
  AND a.v > 10.0 AND b.v > 910.0 AND b.v < 960.0 AND c.v < 11.0""", "x_long"))
def flt_conjunction(spark: SparkSession, sf: str) -> DataFrame:
    spans = [(None, -INF, INF), (0, 10.0, INF), (1, 910.0, 960.0), (3, -INF, 11.0)]
    filters = F.array(*[F.struct(F.lit(v).cast("int").alias("var"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for v, lo, hi in spans])
    return I.explanation(spark, sf).where(S.all_filters_hold(F.col("x"), filters)).select("id")


@query("flt_split_range", sql_of("SELECT CAST(var AS INTEGER) AS var, round(t, 6) AS t FROM thr WHERE t > 8.5 AND t < 950.0", "thr"))
def flt_split_range(spark: SparkSession, sf: str) -> DataFrame:
    inside = S.inside_range(F.col("thr"), F.lit(8.5), F.lit(950.0))
    return thresholds.thresholds(I.explanation(spark, sf)).select("var", F.explode(inside).alias("t")).select(
        "var", F.round("t", 6).alias("t"))


@query("flt_min_support", sql_of(f"SELECT item_id, n FROM counts WHERE n >= {I.MIN_COUNT}", "counts"))
def flt_min_support(spark: SparkSession, sf: str) -> DataFrame:
    return encode.item_counts(I.ratings(spark, sf)).where(F.col("n") >= I.MIN_COUNT)


@query("flt_has_tags", sql_of("SELECT item_id FROM scaled SEMI JOIN tags USING (item_id)", "scaled", "tags"))
def flt_has_tags(spark: SparkSession, sf: str) -> DataFrame:
    tagged = I.tags(spark, sf).select("item_id")
    return I.scaled(spark, sf).join(tagged, "item_id", "left_semi").select("item_id")


@query("flt_popular", sql_of("SELECT user_id, item_id, count(*) AS n FROM outcomes SEMI JOIN id_map USING (item_id) GROUP BY 1, 2",
                             "outcomes", "id_map"))
def flt_popular(spark: SparkSession, sf: str) -> DataFrame:
    kept = I.outcomes(spark, sf).join(I.id_map(spark, sf).select("item_id"), "item_id", "left_semi")
    return kept.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"))


@query("prj_predict", sql_of("SELECT l_orderkey, l_partkey, l_linenumber, 1.0 / (1.0 + exp(-(l_quantity - 25.0))) > 0.5 AS liked FROM lineitem"))
def prj_predict(spark: SparkSession, sf: str) -> DataFrame:
    liked = S.predict(S.sigmoid(F.col("l_quantity") - 25.0))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", liked.alias("liked"))


# -- joins -----------------------------------------------------------------------------------------------

@query("jn_rated_items", sql_of("SELECT item_id, year FROM scaled SEMI JOIN ratings USING (item_id)", "scaled", "ratings"))
def jn_rated_items(spark: SparkSession, sf: str) -> DataFrame:
    return joins.rated_items(I.scaled(spark, sf), I.ratings(spark, sf)).select("item_id", "year")


@query("jn_items_tags", sql_of("""SELECT item_id, round(year_scaled, 6) AS year_scaled, round(sum(value), 4) AS relevance FROM scaled JOIN tag_long USING (item_id) GROUP BY 1, 2""",
                               "scaled", "tag_long"))
def jn_items_tags(spark: SparkSession, sf: str) -> DataFrame:
    both = I.scaled(spark, sf).join(encode.tag_vectors(I.tags(spark, sf)), "item_id")
    total = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v)
    return both.select("item_id", F.round("year_scaled", 6).alias("year_scaled"), F.round(total, 4).alias("relevance"))


@query("jn_ratings_items", sql_of("""SELECT user_id, item_id, year, outcome, count(*) AS n FROM outcomes JOIN scaled USING (item_id) SEMI JOIN tags USING (item_id)
  GROUP BY 1, 2, 3, 4""", "outcomes", "scaled", "tags"))
def jn_ratings_items(spark: SparkSession, sf: str) -> DataFrame:
    coded = I.scaled(spark, sf).join(encode.tag_vectors(I.tags(spark, sf)), "item_id")
    both = I.outcomes(spark, sf).join(coded.select("item_id", "year"), "item_id")
    return both.groupBy("user_id", "item_id", "year", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("jn_ratings_users", sql_of("""SELECT o.user_id, o.item_id, o.outcome, count(*) AS n, max(r.rated) AS rated FROM outcomes o JOIN
  (SELECT user_id, count(*) AS rated FROM user_pos GROUP BY 1) r ON r.user_id = o.user_id GROUP BY 1, 2, 3""", "outcomes", "user_pos"))
def jn_ratings_users(spark: SparkSession, sf: str) -> DataFrame:
    """Users stay sparse across the join; a row costs what the user rated, not the vector's width."""
    rated = I.outcomes(spark, sf)
    users = encode.user_entries(rated, I.id_map(spark, sf))
    both = spread(rated, "user_id").join(joins.grown(users), "user_id")
    return both.groupBy("user_id", "item_id", "outcome").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("entries")).cast("bigint").alias("rated"))


@query("jn_title_map", sql_of("SELECT idx, title FROM items JOIN id_map USING (item_id)", "items", "id_map"))
def jn_title_map(spark: SparkSession, sf: str) -> DataFrame:
    return I.items(spark, sf).join(I.id_map(spark, sf), "item_id").select("idx", "title")


@query("jn_cluster_size", sql_of("SELECT id, sum(u * size)::BIGINT AS liked_by FROM u_long JOIN sizes ON seg = cluster_id GROUP BY 1", "u_long", "sizes"))
def jn_cluster_size(spark: SparkSession, sf: str) -> DataFrame:
    votes = I.explanation(spark, sf).select("id", F.posexplode("u").alias("cluster_id", "u"))
    return votes.join(I.segment_sizes(spark, sf), "cluster_id").groupBy("id").agg(F.sum(F.col("u") * F.col("size")).alias("liked_by"))


@query("jn_names", sql_of("""SELECT id, CAST(var AS INTEGER) AS var, coalesce(name, 'WRONG VARIABLE') AS name FROM x_long LEFT JOIN
  (SELECT unnest(['size', 'price', 'economy']) AS name, unnest([0, 1, 2]) AS v2) ON v2 = var""", "x_long"))
def jn_names(spark: SparkSession, sf: str) -> DataFrame:
    names = spark.createDataFrame(list(enumerate(I.ATTRIBUTES[:3])), "var int, name string")
    rows = I.explanation(spark, sf).select("id", F.posexplode("x").alias("var", "v"))
    return joins.with_names(rows, names).select("id", "var", "name")


# -- aggregations ----------------------------------------------------------------------------------------------

@query("agg_minmax", sql_of("SELECT min(year) AS low, max(year) AS high FROM parsed", "parsed"))
def agg_minmax(spark: SparkSession, sf: str) -> DataFrame:
    return encode.parsed_items(I.items(spark, sf)).agg(F.min("year").alias("low"), F.max("year").alias("high"))


@query("agg_max_tag", "SELECT max(l_linenumber) AS width FROM lineitem")
def agg_max_tag(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").agg(F.max("l_linenumber").alias("width"))


@query("agg_item_counts", sql_of("SELECT item_id, n FROM counts", "counts"))
def agg_item_counts(spark: SparkSession, sf: str) -> DataFrame:
    return encode.item_counts(I.ratings(spark, sf))


@query("agg_collect", sql_of("SELECT user_id, string_agg(pos || ':' || value, ',' ORDER BY pos) AS rated FROM user_pos GROUP BY 1", "user_pos"))
def agg_collect(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct (index, ±1) lists per user; a list is at most as long as there are popular items."""
    entries = joins.popular_ratings(I.outcomes(spark, sf), I.id_map(spark, sf)).groupBy("user_id", F.col("idx").alias("pos")).agg(
        F.max(F.when(F.col("outcome"), 1).otherwise(-1)).alias("value"))
    lists = entries.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("e"))
    pair = F.transform("e", lambda e: F.concat_ws(":", e["pos"].cast("string"), e["value"].cast("string")))
    return lists.select("user_id", F.array_join(pair, ",").alias("rated"))


@query("agg_distinct_genres", sql_of("SELECT DISTINCT unnest(string_split(genres, '|')) AS genre FROM items", "items"))
def agg_distinct_genres(spark: SparkSession, sf: str) -> DataFrame:
    return encode.distinct_genres(I.items(spark, sf))


@query("agg_distinct_items", sql_of("SELECT DISTINCT item_id FROM ratings", "ratings"))
def agg_distinct_items(spark: SparkSession, sf: str) -> DataFrame:
    return I.ratings(spark, sf).select("item_id").distinct()


@query("agg_value_freq", sql_of("SELECT CAST(var AS INTEGER) AS var, round(v, 6) AS v, c FROM freq", "freq"))
def agg_value_freq(spark: SparkSession, sf: str) -> DataFrame:
    return thresholds.value_frequencies(I.explanation(spark, sf)).select("var", F.round("v", 6).alias("v"), "c")


@query("agg_sorted_values", sql_of("SELECT CAST(var AS INTEGER) AS var, CAST(i - 1 AS INTEGER) AS pos, round(v, 6) AS v, c FROM vals", "vals"))
def agg_sorted_values(spark: SparkSession, sf: str) -> DataFrame:
    """Sorted distinct values with counts and position, ranked without one list per variable."""
    freq = thresholds.value_frequencies(I.explanation(spark, sf))
    return thresholds.ranked_values(freq).select("var", "pos", F.round("v", 6).alias("v"), "c")


@query("agg_split_hist", sql_of("""SELECT CAST(var AS INTEGER) AS var, CAST(bin AS INTEGER) AS bin, max(n) AS n,
  string_agg(pos::BIGINT::VARCHAR, ',' ORDER BY seg) AS pos FROM hist GROUP BY 1, 2""", "hist"))
def agg_split_hist(spark: SparkSession, sf: str) -> DataFrame:
    hist = histogram(spark, sf)
    return hist.select("var", F.col("bin").cast("int").alias("bin"), "n", F.array_join("pos", ",").alias("pos"))


def histogram(spark: SparkSession, sf: str) -> DataFrame:
    rows = cut_lineage(I.explanation(spark, sf))  # joined once: thresholds and bins read what is stored
    width = len(I.SEGMENTS)
    binned = splits.with_bins(rows, I.thresholds_list(spark, rows))
    return splits.histogram(splits.utility_columns(binned, width).withColumn("n", F.lit(1)), width)


@query("agg_split_lists", sql_of("""SELECT CAST(var AS INTEGER) AS var, count(*) AS bins, sum(n)::BIGINT AS n FROM
  (SELECT var, bin, max(n) AS n FROM hist GROUP BY 1, 2) GROUP BY 1""", "hist"))
def agg_split_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Bins regrouped per variable; every variable sees all rows."""
    return histogram(spark, sf).groupBy("var").agg(F.count(F.lit(1)).alias("bins"), F.sum("n").alias("n"))


@query("agg_col_stats", """SELECT CAST(col AS INTEGER) AS col, max(v) AS max, round(sum(v), 2) AS sum, count(*) AS n, round(sum((v - m) * (v - m)), 2) AS sq_dev FROM
  (SELECT col, v, avg(v) OVER (PARTITION BY col) AS m FROM (
   SELECT 0 AS col, CAST(o_custkey % 7 AS DOUBLE) AS v FROM orders UNION ALL SELECT 1, o_totalprice / 1000.0 FROM orders)) GROUP BY 1""")
def agg_col_stats(spark: SparkSession, sf: str) -> DataFrame:
    points = table(spark, sf, "orders").select(F.array((F.col("o_custkey") % 7).cast("double"), F.col("o_totalprice") / 1000.0).alias("features"))
    return encode.column_stats(points, 2).select("col", "max", F.round("sum", 2).alias("sum"), "n", F.round("sq_dev", 2).alias("sq_dev"))


@query("agg_count_first_empty", """SELECT count(*) AS n, min(o_orderkey) AS first_key, count(*) = 0 AS no_rows,
  count(*) FILTER (WHERE o_totalprice < 0) = 0 AS no_negative FROM orders""")
def agg_count_first_empty(spark: SparkSession, sf: str) -> DataFrame:
    """Count, first row in key order and two emptiness tests in one aggregation."""
    n = F.count(F.lit(1))
    return table(spark, sf, "orders").agg(
        n.alias("n"), F.min("o_orderkey").alias("first_key"), (n == 0).alias("no_rows"),
        (F.count(F.when(F.col("o_totalprice") < 0, 1)) == 0).alias("no_negative"))


# -- ranking and sorting -----------------------------------------------------------------------------------------

@query("win_rank_items", sql_of("SELECT item_id, n, idx FROM id_map", "id_map"))
def win_rank_items(spark: SparkSession, sf: str) -> DataFrame:
    return I.id_map(spark, sf)


@query("win_midpoints", sql_of("SELECT CAST(a.var AS INTEGER) AS var, round((a.v + b.v) / 2, 6) AS mid FROM vals a JOIN vals b ON a.var = b.var AND b.i = a.i + 1", "vals"))
def win_midpoints(spark: SparkSession, sf: str) -> DataFrame:
    freq = thresholds.value_frequencies(I.explanation(spark, sf))
    return thresholds.ranked_values(freq).where(F.col("prev").isNotNull()).select(
        "var", F.round((F.col("prev") + F.col("v")) / 2, 6).alias("mid"))


@query("srt_items", sql_of("SELECT item_id, n FROM counts ORDER BY n DESC, item_id", "counts"))
def srt_items(spark: SparkSession, sf: str) -> DataFrame:
    return encode.item_counts(I.ratings(spark, sf)).orderBy(F.desc("n"), "item_id")


@query("srt_by_key", sql_of("SELECT cluster_id, size FROM sizes ORDER BY cluster_id", "sizes"))
def srt_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return I.segment_sizes(spark, sf).orderBy("cluster_id")

