"""Thresholds, split search and tree growth on the explanation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duoscope.functions import scalars as S
from duoscope.operators import grow, splits, thresholds, trees
from duoscope.queries import inputs as I
from duoscope.queries.registry import VIEWS, query, renamed_views, sql_of, view
from duoscope.queries.relational import histogram
from duoscope.session import cut_lineage

WIDTH = len(I.SEGMENTS)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def finite(col: str) -> Column:
    """Infinities as null, for comparison."""
    return F.when(F.abs(F.col(col)) < float("inf"), F.round(col, 6)).alias(col)


@query("tree_thresholds", sql_of("SELECT CAST(var AS INTEGER) AS var, CAST(pos AS INTEGER) AS pos, round(t, 6) AS t FROM thr", "thr"))
def tree_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    found = thresholds.thresholds(I.explanation(spark, sf))
    return rounded(found.select("var", F.posexplode("thr").alias("pos", "t")))


@query("tree_split_hist", sql_of("SELECT CAST(var AS INTEGER) AS var, CAST(bin AS INTEGER) AS bin, CAST(seg AS INTEGER) AS seg, n, pos::BIGINT AS pos FROM hist", "hist"))
def tree_split_hist(spark: SparkSession, sf: str) -> DataFrame:
    hist = histogram(spark, sf).select("var", F.col("bin").cast("int").alias("bin"), "n", F.posexplode("pos").alias("seg", "p"))
    return hist.select("var", "bin", "seg", "n", F.col("p").alias("pos"))


@query("win_prefix_split", sql_of("""SELECT CAST(var AS INTEGER) AS var, CAST(bin AS INTEGER) AS bin, max(ln)::BIGINT AS left_n, max(n)::BIGINT AS n,
  string_agg(lp::BIGINT::VARCHAR, ',' ORDER BY seg) AS left_pos, string_agg(p::BIGINT::VARCHAR, ',' ORDER BY seg) AS total_pos FROM prefix GROUP BY 1, 2""", "prefix"))
def win_prefix_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = splits.prefix_counts(histogram(spark, sf), WIDTH)
    return rows.select("var", F.col("bin").cast("int").alias("bin"), "left_n", "n",
                       F.array_join("left_pos", ",").alias("left_pos"), F.array_join("total_pos", ",").alias("total_pos"))


@query("fn_entropy", sql_of(f"""SELECT CAST(var AS INTEGER) AS var, CAST(bin AS INTEGER) AS bin, round(sum(({I.entropy_sql('pos', 'n')}) * size) / max(total), 6) AS entropy
  FROM hist JOIN sizes ON seg = cluster_id CROSS JOIN total_size GROUP BY 1, 2""", "hist", "sizes", "total_size"))
def fn_entropy(spark: SparkSession, sf: str) -> DataFrame:
    we = S.weighted_entropy(F.col("n"), F.col("pos"), I.size_array(spark, sf))
    return histogram(spark, sf).select("var", F.col("bin").cast("int").alias("bin"), F.round(we, 6).alias("entropy"))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_scores(splits.prefix_counts(histogram(spark, sf), WIDTH), I.size_array(spark, sf))


@query("top1_split", sql_of("SELECT CAST(var AS INTEGER) AS var, CAST(bin AS INTEGER) AS bin, round(we, 6) AS we FROM ranked WHERE rn = 1", "ranked"))
def top1_split(spark: SparkSession, sf: str) -> DataFrame:
    best = splits.best_per_variable(scores(spark, sf))
    return best.select("var", F.col("bin").cast("int").alias("bin"), F.round("we", 6).alias("we"))


@query("topk_candidates", sql_of("""SELECT CAST(var AS INTEGER) AS var, rank::INTEGER AS rank, round(we, 6) AS we FROM
  (SELECT *, row_number() OVER (ORDER BY we, var) AS rank FROM ranked WHERE rn = 1) WHERE rank <= 3""", "ranked"))
def topk_candidates(spark: SparkSession, sf: str) -> DataFrame:
    best = splits.best_per_variable(scores(spark, sf).withColumn("region", F.lit(0)), "region")
    return splits.top_candidates(best, 3, "region").select("var", "rank", F.round("we", 6).alias("we"))


@query("tree_best_split", sql_of("""SELECT CAST(var AS INTEGER) AS var, round(split_value, 6) AS split_value, round(left_ratio, 6) AS left_ratio,
  round(left_we, 6) AS left_we, round(right_we, 6) AS right_we, round(we, 6) AS we FROM best""", "best"))
def tree_best_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = cut_lineage(I.explanation(spark, sf))
    best = splits.best_splits(rows, I.size_array(spark, sf), WIDTH, I.thresholds_list(spark, rows))
    return rounded(best.select("var", "split_value", "left_ratio", "left_we", "right_we", "we"))


# -- two levels with lookahead, in SQL ------------------------------------------------------------------

def level_sql(hist: str, keys: str) -> dict[str, str]:
    """Prefix sums, scores and ranks of a histogram keyed by ``keys``, as above but per node."""
    return {
        "prefix": f"SELECT {keys}, var, bin, seg, sum(n) OVER w AS ln, sum(pos) OVER w AS lp, sum(n) OVER a AS n, sum(pos) OVER a AS p FROM {hist} "
                  f"WINDOW w AS (PARTITION BY {keys}, var, seg ORDER BY bin), a AS (PARTITION BY {keys}, var, seg)",
        "scores": f"""SELECT {keys}, var, bin, max(ln) / CAST(max(n) AS DOUBLE) AS lr, 1 - max(ln) / CAST(max(n) AS DOUBLE) AS rr,
          sum(({I.entropy_sql('lp', 'ln')}) * size / total) AS lwe, sum(({I.entropy_sql('p - lp', '(n - ln)')}) * size / total) AS rwe
          FROM {{prefix}} JOIN sizes ON seg = cluster_id CROSS JOIN total_size WHERE ln < n GROUP BY {keys}, var, bin""",
        "best": f"""SELECT *, round(lwe * lr + rwe * rr, 12) AS we, row_number() OVER (PARTITION BY {keys} ORDER BY round(lwe * lr + rwe * rr, 12), var, bin) AS rn
          FROM {{scores}}""",
    }


view("root_we", f"""SELECT round(sum(({I.entropy_sql('pos', 'n')}) * size / total), 12) AS we FROM
  (SELECT seg, count(*) AS n, sum(u) AS pos FROM u_long GROUP BY 1) JOIN sizes ON seg = cluster_id CROSS JOIN total_size""", "u_long", "sizes", "total_size")
for _c in (1, 3):
    view(f"cand{_c}", f"""SELECT var AS cvar, bin AS cbin, split_value, left_ratio, right_ratio, left_we, right_we, we, rank FROM
      (SELECT *, row_number() OVER (ORDER BY we, var) AS rank FROM best) WHERE rank <= {_c} AND we < (SELECT we FROM root_we)""", "best", "root_we")
    view(f"hist2_{_c}", f"""SELECT c.rank, CASE WHEN a.bin <= c.cbin THEN 0 ELSE 1 END AS side, b.var, b.bin, u.seg, count(*) AS n, sum(u.u) AS pos
      FROM cand{_c} c JOIN binned a ON a.var = c.cvar JOIN binned b ON b.id = a.id JOIN u_long u ON u.id = a.id GROUP BY 1, 2, 3, 4, 5""", f"cand{_c}", "binned", "u_long")
    _l = level_sql(f"hist2_{_c}", "rank, side")
    view(f"prefix2_{_c}", _l["prefix"], f"hist2_{_c}")
    view(f"scores2_{_c}", _l["scores"].format(prefix=f"prefix2_{_c}"), f"prefix2_{_c}", "sizes", "total_size")
    view(f"best2_{_c}", _l["best"].format(scores=f"scores2_{_c}"), f"scores2_{_c}")
    # each child of each candidate: its own entropy, and the split below it if one lowers the entropy
    view(f"child2_{_c}", f"""SELECT c.rank, s.side, CASE s.side WHEN 0 THEN left_we ELSE right_we END AS own, CASE s.side WHEN 0 THEN left_ratio ELSE right_ratio END AS ratio,
      b.var, b.bin, b.lr, b.rr, b.lwe, b.rwe, b.we FROM cand{_c} c CROSS JOIN (SELECT unnest([0, 1]) AS side) s
      LEFT JOIN best2_{_c} b ON b.rank = c.rank AND b.side = s.side AND b.rn = 1
        AND b.we < round(CASE s.side WHEN 0 THEN left_we ELSE right_we END, 12)
        AND CASE s.side WHEN 0 THEN left_we ELSE right_we END > 0""", f"cand{_c}", f"best2_{_c}")
    view(f"total2_{_c}", f"SELECT rank, round(sum(coalesce(we, own) * ratio), 12) AS total FROM child2_{_c} GROUP BY 1", f"child2_{_c}")
    view(f"chosen2_{_c}", f"SELECT rank FROM (SELECT rank, row_number() OVER (ORDER BY total, rank) AS rn FROM total2_{_c}) WHERE rn = 1", f"total2_{_c}")
    view(f"tree2_{_c}", f"""SELECT '' AS path, NULL::INTEGER AS var, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi, 1.0 AS rel_size, we AS data_entropy FROM root_we
      UNION ALL SELECT CASE side WHEN 0 THEN 'L' ELSE 'R' END, cvar, CASE side WHEN 1 THEN split_value END, CASE side WHEN 0 THEN split_value END, ratio, own
        FROM child2_{_c} JOIN chosen2_{_c} USING (rank) JOIN cand{_c} USING (rank)
      UNION ALL SELECT CASE c.side WHEN 0 THEN 'L' ELSE 'R' END || CASE g.side WHEN 0 THEN 'L' ELSE 'R' END, c.var, CASE g.side WHEN 1 THEN t END, CASE g.side WHEN 0 THEN t END,
        ratio * CASE g.side WHEN 0 THEN lr ELSE rr END, CASE g.side WHEN 0 THEN lwe ELSE rwe END
        FROM child2_{_c} c JOIN chosen2_{_c} USING (rank) JOIN thr ON thr.var = c.var AND thr.pos = c.bin CROSS JOIN (SELECT unnest([0, 1]) AS side) g
        WHERE c.var IS NOT NULL""", "root_we", f"child2_{_c}", f"chosen2_{_c}", f"cand{_c}", "thr")


def grown(spark: SparkSession, sf: str, level: int, c: int, **options) -> DataFrame:
    return grow.grow_tree(I.explanation(spark, sf), I.segment_sizes(spark, sf), 4, WIDTH, level, c, **options)


def shown(nodes: DataFrame) -> DataFrame:
    return nodes.select("path", F.col("var").cast("int").alias("var"), finite("lo"), finite("hi"),
                        F.round("rel_size", 6).alias("rel_size"), F.round("data_entropy", 6).alias("data_entropy"))


def _tree_sql(c: int) -> str:
    return sql_of(f"SELECT path, CAST(var AS INTEGER) AS var, round(lo, 6) AS lo, round(hi, 6) AS hi, round(rel_size, 6) AS rel_size, "
                  f"round(data_entropy, 6) AS data_entropy FROM tree2_{c}", f"tree2_{c}")


@query("tree_expand", _tree_sql(1))
def tree_expand(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy growth over two levels."""
    return shown(grown(spark, sf, 2, 1))


@query("top1_lookahead", _tree_sql(3))
def top1_lookahead(spark: SparkSession, sf: str) -> DataFrame:
    """Two levels, choosing among the three best splits by the entropy below them."""
    return shown(grown(spark, sf, 2, 3))


@query("tree_expand_deep")
def tree_expand_deep(spark: SparkSession, sf: str) -> DataFrame:
    return shown(grown(spark, sf, 4, 4))


# rows equal to the threshold are in neither child; the root has entropy 1
_STRICT = renamed_views("strict_", "tree2_3", {"ids", "x_long", "u_long", "sizes", "total_size", "thr", "binned", "best"}, {
    "root_we": "SELECT 1.0 AS we",
    "hist2_3": """SELECT c.rank, CASE WHEN a.v < c.split_value THEN 0 ELSE 1 END AS side, b.var, b.bin, u.seg, count(*) AS n, sum(u.u) AS pos
      FROM cand3 c JOIN binned a ON a.var = c.cvar AND a.v <> c.split_value JOIN binned b ON b.id = a.id JOIN u_long u ON u.id = a.id GROUP BY 1, 2, 3, 4, 5"""})
for _n in ("ids", "x_long", "u_long", "sizes", "total_size", "thr", "binned", "best"):
    view(f"strict_{_n}", f"SELECT * FROM {_n}", _n)


@query("tree_expand_strict", sql_of(f"SELECT path, CAST(var AS INTEGER) AS var, round(lo, 6) AS lo, round(hi, 6) AS hi, round(rel_size, 6) AS rel_size, "
                                    f"round(data_entropy, 6) AS data_entropy FROM {_STRICT}", _STRICT))
def tree_expand_strict(spark: SparkSession, sf: str) -> DataFrame:
    """Two levels of the three best splits where rows on a threshold drop out of both children."""
    return shown(grown(spark, sf, 2, 3, strict_bounds=True, root_entropy=1.0))


view("many_side", "SELECT c.rank, a.id, CASE WHEN a.bin <= c.cbin THEN 0 ELSE 1 END AS side FROM many_cand1 c JOIN many_binned a ON a.var = c.cvar",
     "many_cand1", "many_binned", kept=True)
_MANY = renamed_views("many_", "tree2_1", {"ids", "x_long", "u_long", "sizes"}, {
    "hist2_1": """SELECT rank, side, var, bin, seg, count(*) AS n, sum(u) AS pos FROM
      (SELECT s.rank, s.side, b.id, b.var, b.bin FROM many_side s JOIN binned b ON b.id = s.id) JOIN u_long USING (id) GROUP BY 1, 2, 3, 4, 5"""})
VIEWS["many_hist2_1"] = (("many_side", "many_binned", "many_u_long"), *VIEWS["many_hist2_1"][1:])


@query("tree_expand_wide", sql_of(f"SELECT path, CAST(var AS INTEGER) AS var, round(lo, 6) AS lo, round(hi, 6) AS hi, round(rel_size, 6) AS rel_size, "
                                  f"round(data_entropy, 6) AS data_entropy FROM {_MANY}", _MANY))
def tree_expand_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy growth over two levels with 30 variables and 400 clusters."""
    return shown(grow.grow_tree(I.wide_explanation(spark, sf), I.wide_sizes(spark, sf), I.WIDE_VARS, I.WIDE_GROUPS, 2, 1))


@query("tree_leaf_rows", sql_of("""SELECT CASE WHEN a.bin <= x.cbin THEN 'L' ELSE 'R' END || coalesce(CASE WHEN c.var IS NULL THEN '' WHEN b.bin <= c.bin THEN 'L' ELSE 'R' END, '') AS path,
  a.id FROM chosen2_1 JOIN cand1 x USING (rank) JOIN binned a ON a.var = x.cvar
  JOIN child2_1 c ON c.rank = x.rank AND c.side = CASE WHEN a.bin <= x.cbin THEN 0 ELSE 1 END LEFT JOIN binned b ON b.id = a.id AND b.var = c.var""",
                                "chosen2_1", "cand1", "child2_1", "binned"))
def tree_leaf_rows(spark: SparkSession, sf: str) -> DataFrame:
    nodes = grown(spark, sf, 2, 1).withColumn("tree_id", F.lit(0))
    return trees.member_rows(I.explanation(spark, sf), nodes).select("path", "id")
