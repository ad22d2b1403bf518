"""Operators on node tables: one tree per supplier, grown from its line items by fixed questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duoscope.functions import scalars as S
from duoscope.operators import trees
from duoscope.queries import inputs as I
from duoscope.queries.registry import query, sql_of, view
from duoscope.queries.splitting import finite
from duoscope.session import scratch_path, table
from duoscope.sources import tables

# Question per depth: column and threshold; below goes left.
QUESTIONS = [("l_quantity", 25.5), ("l_discount", 0.055), ("l_tax", 0.045), ("l_linenumber", 3.5)]
DEPTH = len(QUESTIONS)
LAMBDAS = [0.0, 0.0002, 0.0005, 0.001, 0.002, 0.004]


def supplier_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes with the entropy of "returned" among the rows reaching them; a question that leaves one
    side empty is not asked."""
    answers = [F.when(F.col(c) < t, "L").otherwise("R") for c, t in QUESTIONS]
    code = F.concat(*answers)
    li = table(spark, sf, "lineitem")
    coded = li.groupBy(F.col("l_suppkey").alias("tree_id"), code.alias("code")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("pos"))
    steps = F.sequence(F.lit(0), F.lit(DEPTH))
    prefixes = coded.select("tree_id", "n", "pos", F.explode(F.transform(steps, lambda k: F.col("code").substr(F.lit(1), k))).alias("path"))
    counts = prefixes.groupBy("tree_id", "path").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    # at most 31 rows per tree from here on
    siblings = W.partitionBy("tree_id", trees.parent_path())
    per_tree = W.partitionBy("tree_id")
    alone = F.when((F.length("path") > 0) & (F.col("sib") < 2), F.col("path"))
    rows = counts.withColumn("sib", F.count(F.lit(1)).over(siblings)).withColumn(
        "alone", F.collect_set(alone).over(per_tree)).withColumn("total", F.max("n").over(per_tree))
    asked = rows.where(~F.exists("alone", lambda a: F.col("path").startswith(a)))
    depth = F.length("path")
    cut = F.get(F.lit([t for _, t in QUESTIONS]), depth - 1)
    inf = F.lit(float("inf"))
    left = F.col("path").endswith("L")
    return asked.select(
        "tree_id", "path", F.when(depth > 0, depth - 1).alias("var"),
        F.when((depth > 0) & ~left, cut).otherwise(-inf).alias("lo"),
        F.when((depth > 0) & left, cut).otherwise(inf).alias("hi"),
        F.round(F.col("n") / F.col("total"), 9).alias("rel_size"),
        F.round(S.binary_entropy(F.col("pos") / F.col("n")), 6).alias("data_entropy"))


_CODE = " || ".join(f"CASE WHEN {c} < {t} THEN 'L' ELSE 'R' END" for c, t in QUESTIONS)
view("codes", f"SELECT l_suppkey AS tree_id, {_CODE} AS code, l_returnflag = 'R' AS r FROM lineitem")
view("node_n", f"""SELECT tree_id, left(code, k) AS path, count(*) AS n, sum(CASE WHEN r THEN 1 ELSE 0 END) AS pos
  FROM codes CROSS JOIN (SELECT unnest(range(0, {DEPTH + 1})) AS k) GROUP BY 1, 2""", "codes")
view("alone", "SELECT tree_id, path FROM (SELECT tree_id, path, count(*) OVER (PARTITION BY tree_id, left(path, length(path) - 1)) AS c FROM node_n "
     "WHERE path <> '') WHERE c < 2", "node_n")
view("nodes", f"""SELECT tree_id, path, CASE WHEN path <> '' THEN CAST(length(path) - 1 AS INTEGER) END AS var,
  CASE WHEN path LIKE '%R' THEN CAST({[t for _, t in QUESTIONS]} AS DOUBLE[])[length(path)] ELSE CAST('-inf' AS DOUBLE) END AS lo,
  CASE WHEN path LIKE '%L' THEN CAST({[t for _, t in QUESTIONS]} AS DOUBLE[])[length(path)] ELSE CAST('inf' AS DOUBLE) END AS hi,
  round(n / CAST(max(n) OVER (PARTITION BY tree_id) AS DOUBLE), 9) AS rel_size, round({I.entropy_sql('pos', 'n')}, 6) AS data_entropy
  FROM node_n x WHERE NOT EXISTS (SELECT 1 FROM alone a WHERE a.tree_id = x.tree_id AND starts_with(x.path, a.path))""", "node_n", "alone")
view("leaf", "SELECT * FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM nodes c WHERE c.tree_id = n.tree_id AND c.path = n.path || 'L')", "nodes")
view("re", """SELECT n.tree_id, n.path, n.rel_size, n.data_entropy, n.var, n.lo, n.hi,
  CASE WHEN count(*) = 1 THEN max(l.data_entropy) ELSE sum(l.data_entropy * l.rel_size) / n.rel_size END AS re
  FROM nodes n JOIN leaf l ON l.tree_id = n.tree_id AND starts_with(l.path, n.path) GROUP BY 1, 2, 3, 4, 5, 6, 7""", "nodes", "leaf")
view("summary", """SELECT l.tree_id, count(*) AS leaves, sum(length(path))::BIGINT AS path_sum, max(re) AS re FROM leaf l JOIN
  (SELECT tree_id, re FROM re WHERE path = '') r USING (tree_id) GROUP BY 1""", "leaf", "re")


def prune_views(tag: str, lambdas: list[float]) -> None:
    """Bottom-up pruning of all trees for a list of λ: one subquery per depth."""
    grid = f"(SELECT unnest(CAST({lambdas} AS DOUBLE[])) AS lam)"
    below = None
    for d in range(DEPTH, -1, -1):
        name = f"{tag}{d}"
        if below is None:
            view(name, f"SELECT tree_id, lam, path, rel_size, data_entropy AS own, data_entropy AS re, CAST({d} AS BIGINT) AS ps, CAST(1 AS BIGINT) AS lv, FALSE AS gone "
                 f"FROM nodes CROSS JOIN {grid} WHERE length(path) = {d}", "nodes")
        else:
            view(name, f"""SELECT tree_id, lam, path, rel_size, own, CASE WHEN keep THEN kre ELSE own END AS re, CASE WHEN keep THEN kps ELSE {d} END AS ps,
              CASE WHEN keep THEN klv ELSE 1 END AS lv, kre IS NOT NULL AND NOT keep AS gone FROM (
              SELECT *, kre IS NOT NULL AND -rel_size * (kre - own) - lam * (kps - {d}) > 0 AS keep FROM (
              SELECT n.tree_id, g.lam, n.path, n.rel_size, n.data_entropy AS own, k.ws / n.rel_size AS kre, k.ps AS kps, k.lv AS klv
              FROM nodes n CROSS JOIN {grid} g LEFT JOIN (SELECT tree_id, lam, left(path, {d}) AS path, sum(re * rel_size) AS ws, sum(ps)::BIGINT AS ps, sum(lv)::BIGINT AS lv
                FROM {below} GROUP BY 1, 2, 3) k ON k.tree_id = n.tree_id AND k.lam = g.lam AND k.path = n.path WHERE length(n.path) = {d}))""", "nodes", below)
        below = name
    view(f"{tag}_all", " UNION ALL ".join(f"SELECT * FROM {tag}{d}" for d in range(DEPTH + 1)), *[f"{tag}{d}" for d in range(DEPTH + 1)])
    view(f"{tag}_sweep", f"""SELECT p.tree_id, p.lam, -s.re - p.lam * s.path_sum AS quality, -p.re - p.lam * p.ps AS pruned_quality, p.lv AS leaves
      FROM {tag}0 p JOIN summary s USING (tree_id)""", f"{tag}0", "summary")


SWEEP = [trees.SWEEP_MAX * i / trees.SWEEP_POINTS for i in range(trees.SWEEP_POINTS)]
prune_views("pr", LAMBDAS)
prune_views("sw", SWEEP)
prune_views("fx", [0.001])


@query("tree_leaves", sql_of("SELECT tree_id, leaves FROM summary", "summary"))
def tree_leaves(spark: SparkSession, sf: str) -> DataFrame:
    return trees.leaf_counts(supplier_trees(spark, sf))


@query("tree_path_sum", sql_of("SELECT tree_id, path_sum FROM summary", "summary"))
def tree_path_sum(spark: SparkSession, sf: str) -> DataFrame:
    return trees.path_sums(supplier_trees(spark, sf))


@query("tree_resulting_entropy", sql_of("SELECT tree_id, path, round(re, 6) AS resulting_entropy FROM re", "re"))
def tree_resulting_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return trees.resulting_entropy(supplier_trees(spark, sf)).select("tree_id", "path", F.round("resulting_entropy", 6).alias("resulting_entropy"))


@query("tree_quality", sql_of("SELECT tree_id, round(-re - 0.001 * path_sum, 6) AS quality FROM summary", "summary"))
def tree_quality(spark: SparkSession, sf: str) -> DataFrame:
    s = trees.tree_summary(supplier_trees(spark, sf))
    q = trees.quality(F.col("resulting_entropy"), F.col("path_sum"), F.lit(0.001))
    return s.select("tree_id", F.round(q, 6).alias("quality"))


@query("tree_prune", sql_of("""SELECT tree_id, lam, path, rel_size, round(own, 6) AS data_entropy, round(re, 6) AS resulting_entropy FROM pr_all p WHERE NOT EXISTS
  (SELECT 1 FROM pr_all a WHERE a.gone AND a.tree_id = p.tree_id AND a.lam = p.lam AND a.path <> p.path AND starts_with(p.path, a.path))""", "pr_all"))
def tree_prune(spark: SparkSession, sf: str) -> DataFrame:
    kept = trees.prune(supplier_trees(spark, sf), LAMBDAS, DEPTH)
    return kept.select("tree_id", "lam", "path", "rel_size", F.round("data_entropy", 6).alias("data_entropy"),
                       F.round("resulting_entropy", 6).alias("resulting_entropy"))


_SWEEP_SQL = "SELECT tree_id, round(lam, 9) AS lam, round(quality, 6) AS quality, round(pruned_quality, 6) AS pruned_quality, leaves FROM sw_sweep"


def shown_sweep(rows: DataFrame) -> DataFrame:
    return rows.select("tree_id", F.round("lam", 9).alias("lam"), F.round("quality", 6).alias("quality"),
                       F.round("pruned_quality", 6).alias("pruned_quality"), "leaves")


@query("tree_sweep", sql_of(_SWEEP_SQL, "sw_sweep"))
def tree_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return shown_sweep(trees.sweep(supplier_trees(spark, sf), SWEEP, DEPTH))


@query("tree_sweep_changes", sql_of("""SELECT tree_id, round(min(lam) FILTER (WHERE round(quality, 12) <> q0), 9) AS first_quality_change,
  round(min(lam) FILTER (WHERE leaves <> l0), 9) AS first_leaf_change FROM sw_sweep JOIN
  (SELECT tree_id, round(quality, 12) AS q0, leaves AS l0 FROM sw_sweep WHERE lam = 0) USING (tree_id) GROUP BY 1""", "sw_sweep"))
def tree_sweep_changes(spark: SparkSession, sf: str) -> DataFrame:
    rows = trees.sweep(supplier_trees(spark, sf), SWEEP, DEPTH).withColumn("quality", F.round("quality", 12))
    found = trees.first_changes(rows)
    return found.select("tree_id", F.round("first_quality_change", 9).alias("first_quality_change"),
                        F.round("first_leaf_change", 9).alias("first_leaf_change"))


@query("top1_lambda", sql_of("""SELECT tree_id, round(lam, 9) AS lam FROM (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY quality DESC, lam DESC) AS rn
  FROM sw_sweep) WHERE rn = 1""", "sw_sweep"))
def top1_lambda(spark: SparkSession, sf: str) -> DataFrame:
    """λ by the quality of the unpruned tree, as in the original rule."""
    return trees.best_lambda(trees.sweep(supplier_trees(spark, sf), SWEEP, DEPTH), "quality").select("tree_id", F.round("lam", 9).alias("lam"))


@query("tree_pick", sql_of("""SELECT b.tree_id, round(b.lam, 9) AS lam, round(b.pruned_quality, 6) AS best_quality, round(f.pruned_quality, 6) AS fixed_quality, f.leaves AS fixed_leaves
  FROM (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY pruned_quality DESC, lam DESC) AS rn FROM sw_sweep) b JOIN fx_sweep f USING (tree_id) WHERE rn = 1""",
                           "sw_sweep", "fx_sweep"))
def tree_pick(spark: SparkSession, sf: str) -> DataFrame:
    p = trees.pick(supplier_trees(spark, sf), SWEEP, 0.001, DEPTH)
    return p.select("tree_id", F.round("lam", 9).alias("lam"), F.round("best_quality", 6).alias("best_quality"),
                    F.round("fixed_quality", 6).alias("fixed_quality"), "fixed_leaves")


@query("tree_edges", sql_of("""SELECT c.tree_id, p.id::INTEGER AS parent_id, c.id::INTEGER AS node_id, c.var, CASE WHEN c.path LIKE '%L' THEN '< ' || printf('%.4f', c.hi)
  ELSE '> ' || printf('%.4f', c.lo) END AS label FROM (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY path) - 1 AS id FROM nodes) c JOIN
  (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY path) - 1 AS id FROM nodes) p ON p.tree_id = c.tree_id AND p.path = left(c.path, length(c.path) - 1)
  WHERE c.path <> ''""", "nodes"))
def tree_edges(spark: SparkSession, sf: str) -> DataFrame:
    return trees.edges(supplier_trees(spark, sf))


def _bound(c: str) -> str:
    return f"CASE WHEN {c} = CAST('inf' AS DOUBLE) THEN 'Infinity' WHEN {c} = CAST('-inf' AS DOUBLE) THEN '-Infinity' ELSE printf('%.4f', round({c}, 4)) END"


view("report", f"""SELECT tree_id, path, row_number() OVER (PARTITION BY tree_id ORDER BY path) - 1 AS line_no,
  repeat(chr(9), length(path)) || printf('%.2f', round(rel_size * 100, 2)) || '% - ' || printf('%.2f', round(data_entropy, 2)) || ' - ' || printf('%.2f', round(re, 2)) ||
  CASE WHEN path <> '' THEN ' - Split at ' || {I.sql_list([c for c, _ in QUESTIONS])}[var + 1] || ' (' || {_bound('lo')} || ' - ' || {_bound('hi')} || ')' ELSE '' END AS line FROM re""", "re")


@query("snk_tree_text", sql_of("SELECT tree_id, string_agg(line, chr(10) ORDER BY line_no) AS value FROM report GROUP BY 1", "report"))
def snk_tree_text(spark: SparkSession, sf: str) -> DataFrame:
    """Reports with variable names, written as text and read back."""
    path = scratch_path(spark, "reports")
    names = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(QUESTIONS)], "var int, name string")
    trees.write_reports(trees.reports(trees.report_lines(supplier_trees(spark, sf), names)), path)
    return trees.read_reports(spark, path)


@query("src_tree_named", sql_of("""SELECT tree_id, path, var, CASE WHEN abs(lo) < CAST('inf' AS DOUBLE) THEN round(lo, 4) END AS lo, CASE WHEN abs(hi) < CAST('inf' AS DOUBLE) THEN round(hi, 4) END AS hi,
  round(round(rel_size * 100, 2) / 100, 6) AS rel_size, round(data_entropy, 2) AS data_entropy, round(re, 2) AS reported_entropy FROM re""", "re"))
def src_tree_named(spark: SparkSession, sf: str) -> DataFrame:
    """Reports with names, written, and read back through the dictionary of the names."""
    path = scratch_path(spark, "reports")
    names = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(QUESTIONS)], "var int, name string")
    trees.write_reports(trees.reports(trees.report_lines(supplier_trees(spark, sf), names)), path)
    back = trees.parse_reports(trees.read_reports(spark, path), names)
    return back.select("tree_id", "path", "var", finite("lo"), finite("hi"), F.round("rel_size", 6).alias("rel_size"),
                       "data_entropy", "reported_entropy")


@query("src_tree_text", sql_of("""SELECT tree_id, path, var, CASE WHEN abs(lo) < CAST('inf' AS DOUBLE) THEN round(lo, 4) END AS lo, CASE WHEN abs(hi) < CAST('inf' AS DOUBLE) THEN round(hi, 4) END AS hi,
  round(round(rel_size * 100, 2) / 100, 6) AS rel_size, round(data_entropy, 2) AS data_entropy FROM nodes""", "nodes"))
def src_tree_text(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "reports")
    trees.write_reports(trees.reports(trees.report_lines(supplier_trees(spark, sf))), path)
    back = trees.parse_reports(trees.read_reports(spark, path))
    return back.select("tree_id", "path", "var", finite("lo"), finite("hi"),
                       F.round("rel_size", 6).alias("rel_size"), "data_entropy")


@query("snk_sweep_csv", sql_of(_SWEEP_SQL, "sw_sweep"))
def snk_sweep_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "sweep")
    tables.write_sweep(trees.sweep(supplier_trees(spark, sf), SWEEP, DEPTH), path)
    schema = "tree_id bigint, lam double, quality double, pruned_quality double, leaves bigint"
    return shown_sweep(spark.read.csv(path, sep=";", header=True, schema=schema))
