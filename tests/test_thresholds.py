import random

import pytest
from pyspark.sql import functions as F

from duoscope.operators import thresholds as T


def model(values, n, bins=10):
    """Plain statement of the rule, for comparison."""
    if len(values) <= bins:
        return [(a[0] + b[0]) / 2 for a, b in zip(values, values[1:])]
    want, room, out = n / bins, n / bins, []
    opened = closed = before = None
    for v, c in values:
        opened = v if opened is None else opened
        space, room = room, room - c
        if room <= 0:
            out.append(opened if closed is None else (closed + opened) / 2)
            closed, opened, room = v, None, want
            if c > 2 * space and c > want:
                out += [] if before is None else [(before + v) / 2]
            elif c > 2 * space:
                room, opened = want - c, v
        before = v
    return out + [closed if opened is None else (closed + opened) / 2]


def ones(k):
    return [(float(i), 1) for i in range(1, k + 1)]


CASES = [
    ([(0.0, 3), (1.0, 4)], [0.5]),
    ([(2.0, 9)], []),
    (ones(20), [1, 2.5, 4.5, 6.5, 8.5, 10.5, 12.5, 14.5, 16.5, 18.5, 20]),
    (ones(12), list(range(1, 13))),
    ([(v, 30 if v == 3 else c) for v, c in ones(14)], [1, 2.5, 3.5, 8, 12]),
    ([(0.0, 50)] + [(i / 10, 1) for i in range(1, 21)], [0, 0.05, 0.75, 1.45]),
]


def fold(spark, lists):
    rows = [(i, [(v, c) for v, c in vals], sum(c for _, c in vals)) for i, vals in enumerate(lists)]
    df = spark.createDataFrame(rows, "var int, vals array<struct<v:double,c:bigint>>, n bigint")
    few = F.size("vals") <= 10
    thr = F.when(few, T.midpoints(F.col("vals"))).otherwise(T.greedy_cuts(F.col("vals"), F.col("n")))
    return {r.var: r.thr for r in df.select("var", thr.alias("thr")).collect()}


def random_lists(count, seed=1):
    rng = random.Random(seed)
    lists = []
    for _ in range(count):
        vals = sorted(rng.sample(range(200), rng.randint(11, 60)))
        heavy = rng.random() < 0.5
        lists.append([(v / 4, rng.choice([1, 1, 2, 5, 60 if heavy else 3])) for v in vals])
    return lists


@pytest.mark.parametrize("i", range(len(CASES)))
def test_listed_cases(spark, i):
    vals, expected = CASES[i]
    assert model(vals, sum(c for _, c in vals)) == pytest.approx(expected)
    assert fold(spark, [vals])[0] == pytest.approx(expected)


def test_fold_equals_model(spark):
    lists = random_lists(300)
    got = fold(spark, lists)
    for i, vals in enumerate(lists):
        assert got[i] == model(vals, sum(c for _, c in vals))


def test_seek_equals_model(spark):
    lists = random_lists(25, seed=2) + [c for c, _ in CASES if len(c) > 10]
    freq = spark.createDataFrame([(i, v, c) for i, vals in enumerate(lists) for v, c in vals], "var int, v double, c bigint")
    totals = {i: sum(c for _, c in vals) for i, vals in enumerate(lists)}
    got = T.seek_cuts(freq, totals, 10)
    for i, vals in enumerate(lists):
        assert got[i] == model(vals, totals[i]), i


def test_thresholds_choose_the_way_by_width(spark):
    rows = spark.range(500).select(F.array(
        (F.col("id") % 97).cast("double"), (F.col("id") % 2).cast("double"), F.sqrt(F.col("id").cast("double"))).alias("x"))
    folded = {r.var: r.thr for r in T.thresholds(rows).collect()}
    sought = {r.var: r.thr for r in T.thresholds(rows, fold_limit=50).collect()}
    assert folded == sought and folded[1] == [0.5]


def test_ranked_values(spark):
    freq = spark.createDataFrame([(v, float((i * 37) % 101), i % 3 + 1) for v in (0, 1) for i in range(101)], "var int, v double, c bigint")
    rows = sorted(T.ranked_values(freq, 7).collect(), key=lambda r: (r.var, r.v))
    for var in (0, 1):
        mine, cum = [r for r in rows if r.var == var], 0
        for i, r in enumerate(mine):
            cum += r.c
            assert (r.pos, r.cum, r.prev) == (i, cum, mine[i - 1].v if i else None)
