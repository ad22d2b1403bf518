"""Operators on node tables of many trees.

Columns: ``tree_id, path, var, lo, hi, rel_size, data_entropy``. ``path`` is the way from the root as
a string of L and R, empty for the root. It gives depth (length), parent (all but the last letter),
ancestors (prefixes) and pre-order (string order), so entropy, counting and pruning are joins and
aggregates over all trees at once. A tree of depth d has at most ``2**(d+1) - 1`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duoscope.functions import scalars as S
from duoscope.session import collect_bounded, cut_lineage, spread

MAX_NODES = 10_000
SWEEP_POINTS = 100
SWEEP_MAX = 1.0 / (5 * 32)


def depth() -> Column:
    return F.length("path")


def parent_path() -> Column:
    return F.when(F.length("path") > 0, F.expr("left(path, length(path) - 1)"))


def side() -> Column:
    return F.right("path", F.lit(1))


def with_leaf_flag(nodes: DataFrame) -> DataFrame:
    """``leaf``: in pre-order the next node of the tree does not start with this path."""
    following = F.lead("path").over(W.partitionBy("tree_id").orderBy("path"))
    return nodes.withColumn("leaf", F.coalesce(~following.startswith(F.col("path")), F.lit(True)))


def leaves(nodes: DataFrame) -> DataFrame:
    return with_leaf_flag(nodes).where("leaf").drop("leaf")


def _up(nodes: DataFrame) -> DataFrame:
    """Each row once for itself and once for every ancestor (at most depth + 1 times)."""
    steps = F.sequence(F.lit(0), depth())
    return nodes.select("*", F.explode(F.transform(steps, lambda k: F.expr("path").substr(F.lit(1), k))).alias("over"))


def resulting_entropy(nodes: DataFrame) -> DataFrame:
    """Leaf: own entropy. Inner node: size-weighted mean over the leaves below, its own entropy where it has no size."""
    sums = _up(leaves(nodes)).groupBy("tree_id", F.col("over").alias("path")).agg(
        F.sum(F.col("data_entropy") * F.col("rel_size")).alias("_s"),
        F.count(F.lit(1)).alias("_k"), F.max("data_entropy").alias("_own"),
    )
    re = F.when(F.col("_k") == 1, F.col("_own")).otherwise(
        F.coalesce(F.try_divide("_s", "rel_size"), F.col("data_entropy")))
    return nodes.join(sums, ["tree_id", "path"]).withColumn("resulting_entropy", re).drop("_s", "_k", "_own")


def leaf_counts(nodes: DataFrame) -> DataFrame:
    return leaves(nodes).groupBy("tree_id").agg(F.count(F.lit(1)).alias("leaves"))


def path_sums(nodes: DataFrame) -> DataFrame:
    return leaves(nodes).groupBy("tree_id").agg(F.sum(depth()).cast("bigint").alias("path_sum"))


def tree_summary(nodes: DataFrame) -> DataFrame:
    """One row per tree: leaves, path sum and resulting entropy of the root, in one shuffle."""
    leaf = F.col("leaf")
    root_size = F.max(F.when(depth() == 0, F.col("rel_size")))
    return with_leaf_flag(nodes).groupBy("tree_id").agg(
        F.sum(F.when(leaf, 1)).alias("leaves"),
        F.sum(F.when(leaf, depth())).cast("bigint").alias("path_sum"),
        F.coalesce(F.try_divide(F.sum(F.when(leaf, F.col("data_entropy") * F.col("rel_size"))), root_size), F.lit(0.0)).alias(
            "resulting_entropy"),
    )


def quality(entropy: Column, path_sum: Column, lam: Column) -> Column:
    return -entropy - lam * path_sum


def _decide(nodes: DataFrame, lambdas: Sequence[float], max_depth: int | None) -> tuple[DataFrame, int]:
    """Bottom-up pruning state of every ``(tree, λ, node)``: re, paths, leaves, inner, collapsed.

    The data is shuffled once by (tree, number of the λ). Every depth is then a window over (tree, λ, ancestor at that
    depth), which the same partitioning serves, so depths cost local sorts only. The key is the number, since a window by a
    double is planned by its normalised value and would be shuffled anew. λ values are a literal array: no cross join.
    """
    if max_depth is None:
        nodes = cut_lineage(nodes)  # read twice, for the depth and for the state
        max_depth = nodes.agg(F.max(depth())).first()[0] or 0
    rows = nodes.select("*", F.posexplode(F.lit([float(v) for v in lambdas])).alias("lam_id", "lam"))
    # all partitions stay: what a window sorts is far more than the packed bytes by which they would be merged
    rows = spread(rows, "tree_id", "lam_id").select(
        "*", F.col("data_entropy").alias("re"), depth().cast("bigint").alias("paths"),
        F.lit(1).cast("bigint").alias("leaves"), F.lit(False).alias("inner"), F.lit(False).alias("collapsed"))
    for d in range(max_depth - 1, -1, -1):
        family = W.partitionBy("tree_id", "lam_id", F.col("path").substr(1, d))
        child, here = depth() == d + 1, depth() == d

        def below(value: Column) -> Column:
            return F.sum(F.when(child, value)).over(family)

        total = below(F.col("re") * F.col("rel_size"))
        re = F.when(total.isNotNull(), F.coalesce(F.try_divide(total, "rel_size"), F.col("data_entropy")))
        rows = rows.select("*", re.alias("_re"), below(F.col("paths")).alias("_ps"), below(F.col("leaves")).alias("_lv"))
        inner = here & F.col("_re").isNotNull()
        gain = -F.col("rel_size") * (F.col("_re") - F.col("data_entropy"))
        keep = inner & (gain - F.col("lam") * (F.col("_ps") - d) > 0)
        rows = rows.withColumns({
            "re": F.when(keep, F.col("_re")).otherwise(F.col("re")),
            "paths": F.when(keep, F.col("_ps")).otherwise(F.col("paths")),
            "leaves": F.when(keep, F.col("_lv")).otherwise(F.col("leaves")),
            "inner": F.col("inner") | inner,
            "collapsed": F.col("collapsed") | (inner & ~keep),
        }).drop("_re", "_ps", "_lv")
    return rows, max_depth


def prune(nodes: DataFrame, lambdas: Sequence[float], max_depth: int | None = None) -> DataFrame:
    """Pruned copies ``(tree_id, lam, node columns, resulting_entropy)`` for all trees and λ values.

    A subtree stays when its entropy gain, weighted by size, exceeds λ times the variables it adds.
    """
    state, top = _decide(nodes, lambdas, max_depth)
    for d in range(top):  # a node goes when a proper ancestor has collapsed
        family = W.partitionBy("tree_id", "lam_id", F.col("path").substr(1, d))
        cut_here = F.max(F.when(depth() == d, F.col("collapsed"))).over(family)
        state = state.withColumn("_cut", cut_here).where(
            (depth() <= d) | ~F.coalesce("_cut", F.lit(False))).drop("_cut")
    return state.select(
        "tree_id", "lam", "path", "var", "lo", "hi", "rel_size", "data_entropy",
        F.col("re").alias("resulting_entropy"))


def sweep(nodes: DataFrame, lambdas: Sequence[float] | None = None, max_depth: int | None = None) -> DataFrame:
    """Per tree and λ: quality of the full and of the pruned tree, and the pruned leaves."""
    state, _ = _decide(nodes, sweep_grid(lambdas), max_depth)

    def root(name: str) -> Column:
        return F.max(F.when(depth() == 0, F.col(name)))

    leaf = ~F.col("inner")
    full_re = F.coalesce(
        F.try_divide(F.sum(F.when(leaf, F.col("data_entropy") * F.col("rel_size"))), root("rel_size")), F.lit(0.0))
    full_paths = F.sum(F.when(leaf, depth()))
    one = F.max("lam")  # all rows of a number have the same λ
    return state.groupBy("tree_id", "lam_id").agg(
        one.alias("lam"), quality(full_re, full_paths, one).alias("quality"),
        quality(root("re"), root("paths"), one).alias("pruned_quality"),
        root("leaves").alias("leaves"),
    ).drop("lam_id")


def first_changes(sweep_rows: DataFrame) -> DataFrame:
    """First λ at which quality and leaf count leave their values at the smallest λ; null if never."""
    by_lam = W.partitionBy("tree_id").orderBy("lam")  # one row per λ of the grid
    start = sweep_rows.select(
        "tree_id", "lam", "quality", "leaves",
        F.first("quality").over(by_lam).alias("q0"), F.first("leaves").over(by_lam).alias("l0"))
    return start.groupBy("tree_id").agg(
        F.min(F.when(F.col("quality") != F.col("q0"), F.col("lam"))).alias("first_quality_change"),
        F.min(F.when(F.col("leaves") != F.col("l0"), F.col("lam"))).alias("first_leaf_change"),
    )


def best_lambda(sweep_rows: DataFrame, measure: str = "pruned_quality") -> DataFrame:
    """Per tree the λ of the best quality; the larger λ wins ties."""
    best = sweep_rows.groupBy("tree_id").agg(F.max(F.struct(measure, "lam")).alias("b"))
    return best.select("tree_id", F.col("b.lam").alias("lam"), F.col(f"b.{measure}").alias("best_quality"))


def pick(nodes: DataFrame, lambdas: Sequence[float] | None = None, fixed_lambda: float = 0.001,
         max_depth: int | None = None) -> DataFrame:
    """The best λ of the sweep next to the tree pruned at a fixed λ."""
    return pick_from(sweep(nodes, sweep_grid(lambdas, fixed_lambda), max_depth), sweep_grid(lambdas), fixed_lambda)


def sweep_grid(lambdas: Sequence[float] | None = None, *more: float) -> list[float]:
    """The λ values of a sweep, by default those of the report, and further ones."""
    grid = [SWEEP_MAX * i / SWEEP_POINTS for i in range(SWEEP_POINTS)] if lambdas is None else list(lambdas)
    return grid + [x for x in more if x not in grid]


def pick_from(sweep_rows: DataFrame, grid: Sequence[float], fixed_lambda: float) -> DataFrame:
    """The same from one sweep that has the grid and the fixed λ."""
    inside, here = F.col("lam").isin(list(grid)), F.col("lam") == fixed_lambda
    picked = sweep_rows.groupBy("tree_id").agg(
        F.max(F.when(inside, F.struct("pruned_quality", "lam"))).alias("b"),
        F.max(F.when(here, F.struct("pruned_quality", "leaves"))).alias("f"))
    return picked.select(
        "tree_id", F.col("b.lam").alias("lam"), F.col("b.pruned_quality").alias("best_quality"),
        F.col("f.pruned_quality").alias("fixed_quality"), F.col("f.leaves").alias("fixed_leaves"))


def with_ids(nodes: DataFrame, *keys: str) -> DataFrame:
    """0-based pre-order ``node_id`` and ``parent_id`` inside each tree."""
    per_tree = W.partitionBy("tree_id", *keys).orderBy("path")
    numbered = nodes.withColumn("node_id", F.row_number().over(per_tree) - 1)
    parents = numbered.select(
        "tree_id", *keys, F.col("path").alias("_over"), F.col("node_id").alias("parent_id"))
    return numbered.withColumn("_over", parent_path()).join(
        parents, ["tree_id", *keys, "_over"], "left").drop("_over")


def edges(nodes: DataFrame, variables: DataFrame | None = None) -> DataFrame:
    """Parent-child list with both ids, the variable and the text of the side.

    With a ``variable(var, name, kind)`` table the text follows the kind of the variable.
    """
    found = with_ids(nodes).where(F.col("parent_id").isNotNull())
    left = side() == "L"
    bound = F.when(left, F.col("hi")).otherwise(F.col("lo"))
    sign = F.when(left, F.lit("< ")).otherwise(F.lit("> "))
    plain = F.concat(sign, S.bound_text(bound))
    keep = ["tree_id", "parent_id", "node_id", "var"]
    if variables is None:
        return found.select(*keep, plain.alias("label"))
    low, high = S.split_names(F.col("kind"), bound)
    named = found.join(variables.select("var", "name", "kind"), "var", "left")
    return named.select(
        *keep, F.coalesce("name", F.lit("WRONG VARIABLE")).alias("name"),
        F.when(F.col("kind").isNull(), plain).when(left, low).otherwise(high).alias("label"))


def report_lines(nodes: DataFrame, variables: DataFrame | None = None) -> DataFrame:
    """Report lines ``(tree_id, line_no, line)``, one tab per depth; names at every node."""
    full = resulting_entropy(nodes)
    if variables is None:
        name = F.col("var").cast("string")
    else:
        full = full.join(variables.select("var", "name"), "var", "left")
        name = F.coalesce(F.col("name"), F.lit("WRONG VARIABLE"))
    split = F.when(
        F.col("var").isNotNull(),
        F.concat(F.lit(" - Split at "), name, F.lit(" ("), S.bound_text(F.col("lo")), F.lit(" - "),
                 S.bound_text(F.col("hi")), F.lit(")")),
    ).otherwise("")
    line = F.concat(
        F.repeat(F.lit("\t"), depth()), S.two_decimals(F.col("rel_size") * 100), F.lit("% - "),
        S.two_decimals(F.col("data_entropy")), F.lit(" - "), S.two_decimals(F.col("resulting_entropy")), split)
    order = W.partitionBy("tree_id").orderBy("path")
    return full.select("tree_id", "path", (F.row_number().over(order) - 1).alias("line_no"), line.alias("line"))


def reports(lines: DataFrame) -> DataFrame:
    """One text per tree; a tree has at most ``2**(depth+1) - 1`` lines."""
    texts = lines.groupBy("tree_id").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("rows"))
    return texts.select("tree_id", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("value"))


#: A line of a report: size, entropy, resulting entropy and, but for the root, the split that led here. Names may hold anything
#: but line ends; the interval is the last one in parentheses.
REPORT_LINE = r"^\t*([0-9.]+)% - ([-0-9.eE]+) - ([-0-9.eE]+)(?: - Split at (.*) \((\S+) - (\S+)\))?\s*$"


def parse_reports(texts: DataFrame, variables: DataFrame | None = None) -> DataFrame:
    """Reports ``(tree_id, value)`` back to node rows, one fold per report and no shuffle.

    The fold keeps the last path seen at each depth. A line at a depth that is still on the stack is
    a right child, otherwise a left one. Variables are read as numbers or, with a ``variable(var, name)`` table of distinct
    names, by that dictionary. A line that is none, an unknown name and a name without dictionary end the job.
    """
    lines = F.filter(F.split("value", r"\r?\n"), lambda line: F.trim(line) != "")
    empty = F.struct(
        F.array().cast("array<string>").alias("stack"), F.array().cast("array<string>").alias("paths"))

    def step(s: Column, line: Column) -> Column:
        d = F.length(F.regexp_extract(line, r"^(\t*)", 1))
        letter = F.when(F.size(s["stack"]) > d, F.lit("R")).otherwise(F.lit("L"))
        path = F.when(d == 0, F.lit("")).otherwise(F.concat(F.get(s["stack"], d - 1), letter))
        stack = F.concat(F.slice(s["stack"], F.lit(1), d), F.array(path))
        return F.struct(stack.alias("stack"), F.concat(s["paths"], F.array(path)).alias("paths"))

    paths = F.aggregate(lines, empty, step, lambda s: s["paths"])
    rows = texts.select("tree_id", F.explode(F.arrays_zip(paths.alias("path"), lines.alias("line"))).alias("r"))
    rows = rows.select("tree_id", "r.path", "r.line")
    line = F.col("line")

    def failing(ok: Column, what: str) -> Column:
        return F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(what), line)).cast("boolean"))

    def number(text: Column) -> Column:
        return F.when(text == "Infinity", F.lit(float("inf"))).when(
            text == "-Infinity", F.lit(float("-inf"))).otherwise(text.try_cast("double"))

    rows = rows.where(failing(line.rlike(REPORT_LINE), "not a line of a report: "))
    named = rows.withColumn("name", F.when(line.contains(" - Split at "), F.regexp_extract(line, REPORT_LINE, 4)))
    if variables is None:
        var = F.col("name").try_cast("int")
    else:
        known = collect_bounded(variables.select("var", "name"), MAX_NODES, "variables")
        names = {r["name"]: r["var"] for r in known}
        if len(names) < len(known):
            raise ValueError("variables with the same name cannot be told apart in a report")
        entries = F.array(*[F.struct(F.lit(n).alias("k"), F.lit(v).cast("int").alias("v")) for n, v in names.items()])
        var = F.try_element_at(F.map_from_entries(entries), F.col("name")) if names else F.lit(None).cast("int")
    found = named.withColumn("var", var).where(failing(F.col("name").isNull() | F.col("var").isNotNull(), "unknown variable: "))
    split = F.col("name").isNotNull()

    def bound(group: int, default: float) -> Column:
        return F.when(split, number(F.regexp_extract(line, REPORT_LINE, group))).otherwise(F.lit(default))

    return found.select(
        "tree_id", "path", "var", bound(5, float("-inf")).alias("lo"), bound(6, float("inf")).alias("hi"),
        (F.regexp_extract(line, REPORT_LINE, 1).cast("double") / 100).alias("rel_size"),
        F.regexp_extract(line, REPORT_LINE, 2).cast("double").alias("data_entropy"),
        F.regexp_extract(line, REPORT_LINE, 3).cast("double").alias("reported_entropy"),
    )


REPORT_END = "\f"


def write_reports(texts: DataFrame, path: str) -> None:
    """Reports of many trees as text: a line with the tree's id, the report, a form feed.

    One file per partition instead of one per tree.
    """
    body = F.concat_ws("\n", F.col("tree_id").cast("string"), "value")
    texts.select(body.alias("value")).write.option("lineSep", REPORT_END).text(path)


def read_reports(spark, path: str) -> DataFrame:
    texts = spark.read.text(path, lineSep=REPORT_END)
    head = r"^([0-9]+)\n"
    return texts.select(
        F.regexp_extract("value", head, 1).cast("bigint").alias("tree_id"),
        F.regexp_replace("value", head, "").alias("value"))


def member_rows(rows: DataFrame, nodes: DataFrame, strict: bool = False) -> DataFrame:
    """``(id, path)`` of the leaf each row falls into, for one tree.

    The tree is model-sized and becomes one nested CASE expression: a row is compared once per
    level. With ``strict`` bounds rows equal to a threshold belong to no leaf.
    """
    by_path = {r["path"]: r for r in collect_bounded(nodes.select("path", "var", "hi"), MAX_NODES, "nodes")}

    def leaf_of(path: str) -> Column:
        left = by_path.get(path + "L")
        if left is None:
            return F.lit(path)
        value = F.get("x", F.lit(left["var"]))
        right = leaf_of(path + "R")
        if strict:
            right = F.when(value > left["hi"], right)
        return F.when(value < left["hi"], leaf_of(path + "L")).otherwise(right)

    return rows.select("id", leaf_of("").alias("path")).where(F.col("path").isNotNull())
