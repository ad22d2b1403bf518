import numpy as np
import pytest
from pyspark.sql import functions as F

from duoscope.functions import scalars as S
from duoscope.functions import vectors as V
from duoscope.operators import encode, project
from duoscope.sources import tables

B, T, N = [True, False], [1, 0, -1, 1], [0.1, 0.2]
BLOCKS = [(B, T, N), (None, T, N), (None, None, N), (B, T, None), (B, None, N), (B, None, None), (None, T, None)]
SCHEMA = "bin array<boolean>, tri array<tinyint>, num array<double>"


@pytest.mark.parametrize("blocks", BLOCKS)
def test_dense_round_trip(spark, blocks):
    df = spark.createDataFrame([blocks], SCHEMA).withColumn("d", V.to_dense(F.col("bin"), F.col("tri"), F.col("num")))
    expected = [float(v) for b in blocks if b for v in b]
    parts = V.from_dense(F.col("d"), len(blocks[0] or []), len(blocks[1] or []))
    row = df.select("d", *[p.alias(n) for p, n in zip(parts, ("b", "t", "n"))]).first()
    assert row["d"] == expected
    assert (row["b"], row["t"], row["n"]) == blocks


def test_odd_tri_value_is_negative(spark):
    df = spark.createDataFrame([([0.5, 1.0, 0.0],)], "d array<double>")
    assert df.select(V.from_dense(F.col("d"), 0, 3)[1].alias("t")).first()["t"] == [-1, 1, 0]


M6, M9 = np.array([[.1, .2, .3, .4, .5, .6]]), np.arange(1, 10)[None, :] / 10


@pytest.mark.parametrize("dense,m,expected", [
    ([0, 1, 1, 0, .1, .2], M6, 0.67),          # one-hot of codes (1, 0) and binary bits agree
    ([0, 1, 1, 0, 1, 0, -1, .1, .2], M9, 0.56),
])
def test_projection(spark, dense, m, expected):
    df = spark.createDataFrame([([float(v) for v in dense],)], "vec array<double>")
    p = df.select(project.project(F.col("vec"), np.vstack([m, -m])).alias("p")).first()["p"]
    assert np.allclose(p, [expected, -expected], atol=1e-6)


def test_projection_checks_width(spark):
    df = spark.createDataFrame([([1.0],)], "vec array<double>")
    with pytest.raises(Exception, match="matrix 6 columns"):
        df.select(project.project(F.col("vec"), M6)).collect()


@pytest.mark.parametrize("dense,row", [
    ([0, 1, 1, 0, .1, .2], [0, 50, 50, 0, 5, 10]),
    ([0, 1, 1, 0, 1, 0, -1, .1, .2], [0, 50, 50, 0, 50, 0, -50, 5, 10]),
])
def test_outer_product(spark, dense, row):
    df = spark.createDataFrame([([float(v) for v in dense], [50.0, 100.0])], "x array<double>, v array<double>")
    got = df.select(project.outer(F.col("x"), F.col("v")).alias("o")).first()["o"]
    assert np.allclose(got, [row, [2 * v for v in row]], atol=1e-6)


def test_one_hot_of_codes(spark):
    df = spark.createDataFrame([([1, 0], [2, 2])], "c array<int>, s array<int>")
    assert df.select(V.one_hot(F.col("c"), F.col("s")).alias("h")).first()["h"] == [False, True, True, False]


def test_factor_round_trip(spark, tmp_path):
    w = np.array([[0, 50, 50, 0, 5, 10], [0, 100, 100, 0, 10, 20]], dtype=float)
    project.UtilityModel(w, w * 2, 1.0, True, False).save(spark, str(tmp_path / "f"))
    back = project.UtilityModel.load(spark, str(tmp_path / "f"))
    assert np.array_equal(back.w, w) and np.array_equal(back.v, w * 2)
    assert (back.biased_left, back.biased_right, back.lam) == (True, False, 1.0)


@pytest.mark.parametrize("n,pos,sizes,expected", [
    (4, [2, 4], [1, 3], 0.25), (4, [2, 2], [5, 1], 1.0), (4, [0, 4], [5, 1], 0.0), (0, [0, 0], [1, 1], 0.0)])
def test_weighted_entropy(spark, n, pos, sizes, expected):
    df = spark.createDataFrame([(n, pos, [float(s) for s in sizes])], "n int, p array<int>, s array<double>")
    got = df.select(S.weighted_entropy(F.col("n"), F.col("p"), F.col("s")).alias("e")).first()["e"]
    assert got == pytest.approx(expected)


def test_bins_count_thresholds_at_or_below(spark):
    df = spark.createDataFrame([(4.0, [-2.0, 1.0, 2.0, 3.0, 5.0, 20.0]), (0.0, [0.5]), (9.0, [0.5])], "v double, t array<double>")
    b = S.bin_of(F.col("v"), F.col("t"))
    rows = df.select(b.alias("b"), S.bin_upper(b, F.col("t")).alias("u")).collect()
    assert [(r.b, r.u) for r in rows] == [(4, 5.0), (0, 0.5), (1, float("inf"))]


def test_position_vectors_keep_the_largest_repeat(spark):
    tags = spark.createDataFrame([(1, 1, .2), (1, 1, .7), (1, 4, .5), (2, 2, .1)], "item_id long, tag_id int, relevance double")
    got = {r.item_id: r.vec for r in encode.tag_vectors(tags).collect()}
    assert got == {1: [.7, 0, 0, .5], 2: [0, .1, 0, 0]}


def test_normalised_points(spark):
    pts = spark.createDataFrame([(1, 1.0, [0.0, 2.0, 5.0]), (2, 2.0, [3.0, 4.0, 5.0])], "id long, label double, features array<double>")
    rows = {r.id: r for r in encode.categorical_points(pts, 1, 2, True).collect()}
    assert rows[1].num == pytest.approx([-1 / 2**.5, 0.0]) and rows[2].num == pytest.approx([1 / 2**.5, 0.0])
    assert (rows[1].label, rows[2].label, rows[1].maxima) == (True, False, [3])


def test_split_at(spark):
    df = spark.createDataFrame([([1.0, 2.0, 0.0, 3.0, -1.0],)], "f array<double>")
    x, u = tables.split_at(F.col("f"), 2)
    r = df.select(x.alias("x"), u.alias("u")).first()
    assert (r.x, r.u) == ([1.0, 2.0], [0, 1, 0])
