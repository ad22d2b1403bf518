import math
import random

import pytest
from pyspark.sql import functions as F

from duoscope.operators import grow, splits, trees

INF = math.inf


# -- node tables ------------------------------------------------------------------------------------

def random_tree(rng, depth=5, path="", size=1.0):
    own = rng.random()
    node = {"path": path, "size": size, "own": own, "kids": []}
    if depth and rng.random() < 0.8:
        share = rng.uniform(0.1, 0.9)
        node["kids"] = [random_tree(rng, depth - 1, path + s, size * r) for s, r in (("L", share), ("R", 1 - share))]
    return node


def walk(n):
    yield n
    for k in n["kids"]:
        yield from walk(k)


def re(n):
    return sum(re(k) * k["size"] for k in n["kids"]) / n["size"] if n["kids"] else n["own"]


def path_sum(n, level=0):
    return sum(path_sum(k, level + 1) for k in n["kids"]) if n["kids"] else level


def pruned(n, lam, level=0):
    if not n["kids"]:
        return n
    new = dict(n, kids=[pruned(k, lam, level + 1) for k in n["kids"]])
    gain = -n["size"] * (re(new) - n["own"]) - lam * (path_sum(new, level) - level)
    return new if gain > 0 else dict(n, kids=[])


def table(spark, roots):
    rows = [(i, n["path"], None if not n["path"] else 3, -INF if n["path"][-1:] != "R" else 0.5,
             INF if n["path"][-1:] != "L" else 0.5, n["size"], n["own"]) for i, t in enumerate(roots) for n in walk(t)]
    return spark.createDataFrame(rows, "tree_id int, path string, var int, lo double, hi double, rel_size double, data_entropy double")


@pytest.fixture(scope="module")
def forest():
    rng = random.Random(4)
    return [random_tree(rng) for _ in range(30)]


def test_counts_and_entropy(spark, forest):
    nodes = table(spark, forest)
    found = {r.tree_id: r for r in trees.tree_summary(nodes).collect()}
    inner = {(r.tree_id, r.path): r.resulting_entropy for r in trees.resulting_entropy(nodes).collect()}
    for i, t in enumerate(forest):
        assert found[i].leaves == sum(not n["kids"] for n in walk(t))
        assert found[i].path_sum == path_sum(t)
        assert found[i].resulting_entropy == pytest.approx(re(t))
        for n in walk(t):
            assert inner[i, n["path"]] == pytest.approx(re(n))


def test_prune_equals_recursion(spark, forest):
    lams = [0.0, 0.001, 0.01, 0.05]
    kept = {}
    for r in trees.prune(table(spark, forest), lams).collect():
        kept.setdefault((r.tree_id, r.lam), {})[r.path] = r.resulting_entropy
    for i, t in enumerate(forest):
        for lam in lams:
            expected = {n["path"]: re(n) for n in walk(pruned(t, lam))}
            assert kept[i, lam] == pytest.approx(expected)


def test_sweep(spark, forest):
    lams = [0.0, 0.002, 0.02]
    for r in trees.sweep(table(spark, forest), lams).collect():
        t, p = forest[r.tree_id], pruned(forest[r.tree_id], r.lam)
        assert r.leaves == sum(not n["kids"] for n in walk(p))
        assert r.quality == pytest.approx(-re(t) - r.lam * path_sum(t))
        assert r.pruned_quality == pytest.approx(-re(p) - r.lam * path_sum(p))


def test_growing_lambda_never_adds_leaves(spark, forest):
    rows = sorted(trees.sweep(table(spark, forest)).collect(), key=lambda r: (r.tree_id, r.lam))
    for a, b in zip(rows, rows[1:]):
        assert a.tree_id != b.tree_id or a.leaves >= b.leaves


def test_report_round_trip(spark, forest):
    nodes = table(spark, forest)
    back = trees.parse_reports(trees.reports(trees.report_lines(nodes)))
    got = {(r.tree_id, r.path): r for r in back.collect()}
    assert len(got) == nodes.count()
    for r in nodes.collect():
        b = got[r.tree_id, r.path]
        assert (b.var, b.lo, b.hi) == (r.var, r.lo, r.hi)
        assert b.rel_size == pytest.approx(r.rel_size, abs=6e-5) and b.data_entropy == pytest.approx(r.data_entropy, abs=6e-3)


def test_report_names_reach_children(spark, forest):
    names = spark.createDataFrame([(3, "colour")], "var int, name string")
    lines = trees.report_lines(table(spark, forest), names).where("path <> ''")
    assert lines.where(~F.col("line").contains("Split at colour (")).count() == 0


def test_named_reports_come_back(spark, forest):
    """Write, read, write: the same lines; names may hold parentheses, dashes and the words of the grammar."""
    odd = "Split at (noon - dusk) (1995) - part 2"
    names = spark.createDataFrame([(3, odd), (4, "other"), (5, "12")], "var int, name string")
    lines = trees.report_lines(table(spark, forest), names)
    back = trees.parse_reports(trees.reports(lines), names)
    assert {r.var for r in back.where("path <> ''").collect()} == {3} and back.where("path = '' and var is not null").isEmpty()
    again = trees.report_lines(back.drop("reported_entropy"), names)
    told = {(r.tree_id, r.line_no): r.line for r in lines.collect()}
    for r in again.collect():
        assert r.line.split(" - Split at ", 1)[1:] == told[r.tree_id, r.line_no].split(" - Split at ", 1)[1:]
        assert r.line.split(" - ")[:2] == told[r.tree_id, r.line_no].split(" - ")[:2]


@pytest.mark.parametrize("line,names,message", [
    ("\t50.00% - 0.10 - 0.10 - Split at colour (-Infinity - 0.5000)", None, "unknown variable"),
    ("\t50.00% - 0.10 - 0.10 - Split at colour (-Infinity - 0.5000)", ["size"], "unknown variable"),
    ("\t50.00% - 0.10 - 0.10 - Split at WRONG VARIABLE (-Infinity - 0.5000)", ["size"], "unknown variable"),
    ("\tfifty - 0.10 - 0.10", None, "not a line of a report"), ("x", ["size", "size"], "same name")])
def test_reports_that_cannot_be_read_fail(spark, line, names, message):
    texts = spark.createDataFrame([(1, "100.00% - 0.50 - 0.26\n" + line)], "tree_id int, value string")
    known = names and spark.createDataFrame(list(enumerate(names)), "var int, name string")
    with pytest.raises(Exception, match=message):
        trees.parse_reports(texts, known).count()


def test_reads_text_with_float_words(spark):
    text = "100.00% - 0.8577234951448383 - 0.26\n\t59.93% - 0.33 - 0.17 - Split at 694 (-Infinity - -0.5000)\n\t40.07% - 0.75 - 0.40 - Split at 694 (-0.5000 - Infinity)"
    rows = trees.parse_reports(spark.createDataFrame([(1, text)], "tree_id int, value string")).orderBy("path").collect()
    assert [(r.path, r.var, r.lo, r.hi) for r in rows] == [("", None, -INF, INF), ("L", 694, -INF, -0.5), ("R", 694, -0.5, INF)]
    assert rows[0].data_entropy == 0.8577234951448383 and rows[1].reported_entropy == 0.17


# -- growth -------------------------------------------------------------------------------------------

def entropy(rows, sizes):
    if not rows:
        return 0.0
    total = 0.0
    for i, s in enumerate(sizes):
        p = sum(u[i] for _, u in rows) / len(rows)
        if 0 < p < 1:
            total += s * (-p * math.log2(p) - (1 - p) * math.log2(1 - p))
    return total / sum(sizes)


def brute(rows, thr, sizes, level, c, strict, own, size=1.0, spans=None):
    """Best tree as nested tuples by plain recursion: (resulting entropy, own, size, split, children)."""
    spans = spans or {}
    leaf = (own, own, size, None, ())
    if level == 0 or not rows:
        return leaf
    per_var = []
    for var, ts in enumerate(thr):
        best = None
        for t in ts:
            lo, hi = spans.get(var, (-INF, INF))
            if not lo < t < hi:
                continue
            left = [r for r in rows if r[0][var] < t]
            right = [r for r in rows if r[0][var] >= t]
            if left and right:
                ratio = len(left) / len(rows)
                le, re_ = entropy(left, sizes), entropy(right, sizes)
                we = round(le * ratio + re_ * (1 - ratio), 12)
                if best is None or we < best[0]:
                    best = (we, var, t, le, re_, ratio, left, right)
        if best:
            per_var.append(best)
    top, answer = INF, leaf
    for we, var, t, le, re_, ratio, left, right in sorted(per_var, key=lambda b: b[:2])[:c]:
        if not we < round(own, 12):
            continue
        lo, hi = spans.get(var, (-INF, INF))
        if strict:
            right = [r for r in right if r[0][var] > t]
        kids = (
            brute(left, thr, sizes, level - 1 if le > 0 else 0, c, strict, le, size * ratio, {**spans, var: (lo, min(hi, t))}),
            brute(right, thr, sizes, level - 1 if re_ > 0 else 0, c, strict, re_, size * (1 - ratio), {**spans, var: (max(lo, t), hi)}))
        total = round(sum(k[0] * k[2] for k in kids), 12)
        if total < top:
            top, answer = total, (sum(k[0] * k[2] for k in kids) / size, own, size, (var, t), kids)
    return answer


def listed(node, path=""):
    yield path, node[3], node[2], node[1]
    for s, k in zip("LR", node[4]):
        yield from listed(k, path + s)


def fixture(seed, n=160):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        x = [float(rng.randint(0, 1)), float(rng.randint(0, 25)), float(rng.randint(0, 3)), round(rng.random() * 4) / 2]
        u = [int(rng.random() < 0.2 + 0.6 * (x[1] > 11) * x[0]), int(x[2] + x[3] + rng.random() > 2.5), int(rng.random() < 0.3 + 0.1 * x[2])]
        rows.append((x, u))
    return rows


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("level,c", [(3, 1), (3, 3), (4, 2)])
def test_growth_equals_recursion(spark, monkeypatch, strict, level, c, wide):
    if wide:  # matrix histograms, several batches and early flushes
        monkeypatch.setattr(splits, "WIDE_FROM", 0)
        monkeypatch.setattr(grow, "COLLAPSE_LIMIT", 0)
    data = fixture(level * 10 + c)
    sizes = [5, 2, 3]
    df = spark.createDataFrame(data, "x array<double>, u array<int>")
    size_df = spark.createDataFrame(list(enumerate(sizes)), "cluster_id int, size bigint")
    from duoscope.operators.thresholds import thresholds

    thr = [r.thr for r in sorted(thresholds(df).collect())]
    nodes = grow.grow_tree(df, size_df, 4, 3, level, c, strict_bounds=strict).collect()
    got = {r.path: r for r in nodes}
    expected = list(listed(brute(data, thr, sizes, level, c, strict, entropy(data, sizes))))
    assert sorted(got) == sorted(p for p, *_ in expected)
    for path, split, size, own in expected:
        assert got[path].rel_size == pytest.approx(size) and got[path].data_entropy == pytest.approx(own, abs=1e-9)
        if split:
            assert (got[path + "L"].var, got[path + "L"].hi) == split == (got[path + "R"].var, got[path + "R"].lo)


def test_rows_fall_into_exactly_one_leaf(spark):
    data = fixture(3)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "id long, x array<double>, u array<int>")
    sizes = spark.createDataFrame([(0, 5), (2, 3)], "cluster_id int, size bigint")  # cluster 1 is empty
    nodes = grow.grow_tree(df, sizes, 4, 3, 4, 2).withColumn("tree_id", F.lit(0))
    members = trees.member_rows(df, nodes)
    assert members.count() == len(data) == members.select("id").distinct().count()
    share = {r.path: r["count"] / len(data) for r in members.groupBy("path").count().collect()}
    for r in trees.leaves(nodes).collect():
        assert share[r.path] == pytest.approx(r.rel_size)
    whole = trees.resulting_entropy(nodes).collect()
    assert all(r.resulting_entropy <= r.data_entropy + 1e-9 for r in whole)


def test_uncollapsed_rows_give_the_same_tree(spark, monkeypatch):
    df = spark.createDataFrame(fixture(9), "x array<double>, u array<int>")
    sizes = spark.createDataFrame([(0, 5), (1, 1), (2, 3)], "cluster_id int, size bigint")
    first = grow.grow_tree(df, sizes, 4, 3, 3, 2).collect()
    monkeypatch.setattr(grow, "COLLAPSE_LIMIT", 0)
    assert grow.grow_tree(df, sizes, 4, 3, 3, 2).collect() == first


def test_plans_do_not_grow_with_the_depth(spark, monkeypatch):
    """Each level reads the stored table of the one before."""
    plans, cut = [], grow.cut_lineage

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df)

    monkeypatch.setattr(grow, "cut_lineage", seen)
    df = spark.createDataFrame(fixture(9, 400), "x array<double>, u array<int>")
    sizes = spark.createDataFrame([(0, 5), (1, 1), (2, 3)], "cluster_id int, size bigint")
    grow.grow_tree(df, sizes, 4, 3, 5, 2)
    levels = [p.count("\n") for p in plans[1:]]
    assert len(levels) >= 3 and len(set(levels)) == 1


@pytest.mark.parametrize("pairs", [1, 50])
def test_rows_follow_in_small_parts(spark, monkeypatch, pairs):
    df = spark.createDataFrame(fixture(9), "x array<double>, u array<int>")
    sizes = spark.createDataFrame([(0, 5), (1, 1), (2, 3)], "cluster_id int, size bigint")
    monkeypatch.setattr(grow, "COLLAPSE_LIMIT", 0)
    first = grow.grow_tree(df, sizes, 4, 3, 4, 3).collect()
    monkeypatch.setattr(grow, "PAIRS", pairs)
    assert grow.grow_tree(df, sizes, 4, 3, 4, 3).collect() == first


@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_running_sums_of_vectors(spark, batch):
    rng = random.Random(batch)
    rows = [(r, v, b, rng.randint(1, 9), [rng.randint(0, 9) for _ in range(5)]) for r in range(3) for v in range(4)
            for b in sorted(rng.sample(range(12), rng.randint(1, 8)))]
    df = spark.createDataFrame(rows, "region int, var int, bin smallint, n bigint, pos array<bigint>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r.region, r.var, r.bin): r for r in splits.prefix_counts(df, 5, "region").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(rows)
    for r, v, b, _, _ in rows:
        own = [x for x in rows if x[:2] == (r, v)]
        left = [x for x in own if x[2] <= b]
        g = got[r, v, b]
        assert (g.left_n, g.n) == (sum(x[3] for x in left), sum(x[3] for x in own))
        assert g.left_pos == [sum(x[4][i] for x in left) for i in range(5)] and g.total_pos == [sum(x[4][i] for x in own) for i in range(5)]


def test_too_many_regions_is_an_error(spark):
    df = spark.createDataFrame(fixture(9), "x array<double>, u array<int>")
    sizes = spark.createDataFrame([(0, 5), (1, 1), (2, 3)], "cluster_id int, size bigint")
    with pytest.raises(ValueError, match="too many"):
        grow.grow_tree(df, sizes, 4, 3, 4, 4, max_regions=3)


def test_wide_histogram_equals_unpivoted_sums(spark):
    rng = random.Random(6)
    data = [([rng.randint(0, 3) for _ in range(6)], rng.randint(1, 4), rng.randint(0, 2), *[rng.randint(0, 4) for _ in range(3)]) for _ in range(900)]
    rows = spark.createDataFrame(data, "bins array<smallint>, n bigint, region int, u0 bigint, u1 bigint, u2 bigint")
    plain = splits.histogram(rows, 3, "region")
    wide = splits.wide_histogram(rows.repartition(5), 3, "region", 6, 4)

    def table(df):
        return {(r.region, r.var, r.bin): (r.n, [float(p) for p in r.pos]) for r in df.collect()}

    assert table(plain) == table(wide)


def test_wide_histogram_flushes_when_full(spark):
    rows = spark.createDataFrame([([k % 2, 1], 1, k % 7, k) for k in range(200)], "bins array<smallint>, n bigint, region int, u0 bigint")
    before = splits.WIDE_CELLS
    splits.WIDE_CELLS = 20
    try:
        wide = splits.wide_histogram(rows.coalesce(1), 1, "region", 2, 2).collect()
    finally:
        splits.WIDE_CELLS = before
    assert sum(r.n for r in wide) == 400 and sum(r.pos[0] for r in wide) == 2 * sum(range(200))


def test_nodes_without_size_have_values(spark):
    rows = [("t", "", 0, 0.0, 1.0, 0.0, 0.5), ("t", "0", 0, 0.0, 1.0, 0.0, 0.2), ("t", "1", 0, 1.0, 2.0, 0.0, 0.3)]
    nodes = spark.createDataFrame(
        rows, "tree_id string, path string, var int, lo double, hi double, rel_size double, data_entropy double")
    assert {r.path: r.resulting_entropy for r in trees.resulting_entropy(nodes).collect()}[""] == 0.5
    assert trees.prune(nodes, [0.0, 0.1]).count() == 2
    assert trees.sweep(nodes, [0.0]).first().leaves == 1


@pytest.mark.parametrize("levels", [2, 3, 4, 5])
def test_pruning_shuffles_once(spark, levels):
    rows = [("t", "", 1.0, 0.9)]
    for d in range(1, levels + 1):
        rows += [("t", format(k, f"0{d}b"), 1.0 / 2**d, 0.9 - d / 10) for k in range(2**d)]
    nodes = spark.createDataFrame(rows, "tree_id string, path string, rel_size double, data_entropy double").selectExpr(
        "tree_id", "path", "0 AS var", "0.0D AS lo", "1.0D AS hi", "rel_size", "data_entropy")
    plan = trees.prune(nodes, [0.0, 0.001, 0.01], max_depth=levels)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
