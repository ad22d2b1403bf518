"""Plans and partitions that must not change as the tables grow."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from duoscope.functions import vectors as V
from duoscope.operators import cluster, encode, joins, learn, sample, trees
from duoscope.queries import inputs as I
from duoscope.queries.files import write_lines
from duoscope.sources import tables


@pytest.fixture
def tables_of(spark, tmp_path):
    """The tables the dyads come from, small, with rows of their own."""
    spark.range(40).selectExpr("id AS c_custkey", "CAST(id % 5 AS INT) AS c_nationkey", "id * 1.5D AS c_acctbal",
                               "element_at(array('AUTOMOBILE','BUILDING'), CAST(id % 2 + 1 AS INT)) AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(30).selectExpr("id AS p_partkey", "concat('part ', id) AS p_name", "'PROMO' AS p_type", "CAST(id % 9 AS INT) AS p_size",
                               "id * 2.0D AS p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(80).selectExpr("id AS o_orderkey", "id % 40 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(200).selectExpr("id % 80 AS l_orderkey", "id % 30 AS l_partkey", "CAST(id % 50 AS DOUBLE) AS l_quantity",
                                "CAST(id % 7 + 1 AS INT) AS l_linenumber", "0.05D AS l_discount").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_growing_sides_are_not_broadcast(spark, tables_of):
    """The planner takes the entities for a few KB here, as it takes a million of them for a few MB."""
    dyads, users, items = I.labelled(spark, tables_of), I.users_vec(spark, tables_of), I.items_vec(spark, tables_of)
    plans = {
        "ratings": I.ratings(spark, tables_of),
        "sides": joins.join_sides(dyads, users, items),
        "gradient": learn.entity_gradients(dyads, users, items, {0: (I.matrix(3, 9), I.matrix(3, 9, 2))}),
        "hit rates": learn.hit_rates(dyads, users, items, {0: learn.UtilityModel(I.matrix(3, 9), I.matrix(3, 9, 2), 1.0, True, True)}),
        "explanation": I.explanation(spark, tables_of),
        "wide explanation": I.wide_explanation(spark, tables_of),
        "item vectors": encode.item_vectors(I.scaled(spark, tables_of), encode.tag_vectors(I.tags(spark, tables_of))),
    }
    for name, df in plans.items():
        assert "SortMergeJoin" in planned(df), name
        assert "BroadcastHashJoin" not in planned(df), name
    assert plans["sides"].count() == 200 and plans["wide explanation"].count() == 30


def part_sizes(df) -> list[int]:
    return [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]


def test_lines_go_to_more_than_three_files(spark, tmp_path):
    write_lines(spark.range(8000, numPartitions=1).select(F.col("id").cast("string").alias("value")), "id", f"{tmp_path}/lines")
    lines = spark.read.text(f"{tmp_path}/lines")
    assert lines.count() == 8001 and lines.where("value = 'id'").count() == 1
    files = lines.groupBy(F.input_file_name()).count().collect()
    assert len(files) > 4 and max(r["count"] for r in files) < 2000


def test_sweep_keeps_its_partitions(spark):
    """What the windows sort is not dealt to fewer tasks because it packs well."""
    nodes = spark.range(64).selectExpr("id AS tree_id", "'' AS path", "1.0D AS rel_size", "0.5D AS data_entropy")
    state, _ = trees._decide(nodes, [0.0, 0.1], None)
    assert len(part_sizes(state)) == int(spark.conf.get("spark.sql.shuffle.partitions")) * 2  # as many as there are cores


def test_cluster_input_is_dealt_out(spark, monkeypatch):
    """One large row group does not become one cached partition."""
    seen = []
    monkeypatch.setattr(cluster.KMeans, "fit", lambda self, df: seen.append(part_sizes(df)))
    rows = spark.range(800, numPartitions=1).select(F.array(F.col("id").cast("double")).alias("vec"))
    cluster.kmeans(rows, k=2, iterations=1)
    assert len(seen[0]) >= 4 and max(seen[0]) <= 400


def test_spelt_vectors(spark):
    rows = spark.createDataFrame([(1, []), (2, [0, 4]), (3, [2]), (4, [0, 2, 4])], "id int, liked array<int>")
    known = [0, 2, 4]  # 1 and 3 have no vector
    marks = ([f"{p + 1}:1.0" for p in known], [f"{p + 1}:-1.0" for p in known])
    got = {r["id"]: r["t"] for r in rows.select("id", cluster.spelt(F.col("liked"), known, 5, marks, " ").alias("t")).collect()}
    assert got == {1: "1:-1.0 3:-1.0 5:-1.0", 2: "1:1.0 3:-1.0 5:1.0", 3: "1:-1.0 3:1.0 5:-1.0", 4: "1:1.0 3:1.0 5:1.0"}
    none = rows.where("id = 1").select(cluster.spelt(F.col("liked"), [], 5, ([], []), ",").alias("t")).first().t
    assert none == ""


def test_ids_of_stored_vectors(spark, tmp_path, monkeypatch):
    """One 64-bit number per id; where two vectors share one, the next seed is taken."""
    rows = spark.createDataFrame([(True, [0, 3], [1.0, 0.5]), (False, [0, 3], [1.0, 0.25]), (True, [1, 3], [-1.0, 0.5])], "label boolean, indices array<int>, values array<double>")
    tables.write_sparse_dyads(rows, {"left_tri": 3, "right_num": 1}, f"{tmp_path}/dyads")
    plain = tables.vector_id
    monkeypatch.setattr(tables, "vector_id", lambda seed, c: plain(seed, c) if seed > 1 else F.lit(7).cast("bigint"))
    ids, users, items, widths = tables.read_dyad_sides(spark, f"{tmp_path}/dyads")
    assert widths == (3, 1) and {t for _, t in ids.dtypes} == {"bigint", "boolean"}
    assert users.count() == 2 and items.count() == 2
    assert ids.join(users, "user_id").join(items.toDF("item_id", "ypos", "yval"), "item_id").count() == 3


def test_dyads_are_made_once(spark, tmp_path):
    """Widths come with the rows that are written."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    one = ("array(true) AS {}_bin", "CAST(array(1) AS ARRAY<TINYINT>) AS {}_tri", "array(0.5D) AS {}_num")
    rows = spark.range(10).selectExpr("id", *[c.format(side) for side in ("left", "right") for c in one], "id > 3 AS label")
    tables.write_dyads(rows.mapInArrow(count, rows.schema).drop("id"), f"{tmp_path}/dyads")
    assert made.value == 10
    assert tables.read_widths(spark, f"{tmp_path}/dyads") == dict.fromkeys(tables.WIDTHS, 1)
    assert tables.read_dyads(spark, f"{tmp_path}/dyads").where("label").count() == 6


def test_half_by_sign(spark):
    m = learn.UtilityModel(I.matrix(2, 3), I.matrix(2, 3), 0.5)
    d = np.array([0.0, 1e-17, -1e-17, 1e-12, -1e-12, 1e-5, -1e-5, 800.0, -800.0, 1e-6, -1e-6])
    with np.errstate(over="ignore"):
        want = 1.0 / (1.0 + np.exp(-d / 0.5)) > 0.5
    assert m.over_half(np.stack([d, 0 * d], axis=1), np.array([[1.0, 0.0]]))[:, 0].tolist() == want.tolist()


def test_few_drawn_rows_meet_their_entities_only(spark, monkeypatch):
    """The vectors of all others are not shuffled for them; how many count as few changes no model."""
    dyads = spark.range(400).selectExpr("id % 200 AS user_id", "id % 90 AS item_id", "id % 3 = 0 AS label")
    users = spark.range(200).selectExpr("id AS user_id", "array(1.0D, id * 0.01D) AS vec")
    items = spark.range(90).selectExpr("id AS item_id", "array(id * 0.02D, -1.0D) AS vec")
    met, models, plain = [], [], learn.with_vectors

    def seen(drawn, left, right):
        met.append((drawn.count(), left.count(), right.count()))
        return plain(drawn, left, right)

    monkeypatch.setattr(learn, "with_vectors", seen)
    for few in (learn.FEW_DRAWN, 0):
        monkeypatch.setattr(learn, "FEW_DRAWN", few)
        models.append(learn.learn(dyads, users, items, learn.Settings(k=2), max_iterations=3, minibatch=5, seed=1))
    drawn, left, right = met[0]
    assert 0 < left <= drawn < 40 and 0 < right <= drawn and met[1] == (drawn, 200, 90)
    assert np.allclose(models[0].w, models[1].w) and np.allclose(models[0].v, models[1].v)


def test_both_hit_rates_in_one_pass(spark, monkeypatch):
    dyads = spark.range(300).selectExpr("id % 40 AS user_id", "id % 30 AS item_id", "id % 40 > id % 30 AS label")
    users = spark.range(40).selectExpr("id AS user_id", "array(1.0D, id * 0.01D) AS vec")
    items = spark.range(30).selectExpr("id AS item_id", "array(id * 0.02D, -1.0D) AS vec")
    passes, plain, points = [], learn.hit_rates, learn.grid((2, 3), (0.1,), (0.5,), (0.01,))
    monkeypatch.setattr(learn, "hit_rates", lambda *a: passes.append(a[3]) or plain(*a))
    for share in (1.0, 0.5):
        got = learn.learn_tuned(dyads, users, items, points, 1e9, 3, 2, train_share=share).table.orderBy("model").collect()
        train, test = sample.split(dyads, ["user_id", "item_id"], 0.7, 2)
        train = sample.split(train, ["user_id", "item_id"], share, 3)[0]
        for name, part in (("hit_rate", test), ("train_hit_rate", train)):
            want = plain(part, users, items, passes[-1]).orderBy("model").collect()
            assert [(r["model"], r[name]) for r in got] == [(r["model"], r["hit_rate"]) for r in want] and want[0]["n"] == part.count()
    assert len(passes) == 2


def test_short_products_are_spelt_out(spark):
    """Spark interprets functions over arrays; what is compiled has the same result to the last bit."""
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(rng.normal(size=40).tolist(), rng.normal(size=40).tolist()) for _ in range(20)], "a array<double>, b array<double>")
    for start, n in ((0, 0), (0, 3), (5, 16), (2, 17), (0, 40)):
        got = rows.select(V.dot_part("a", "b", start, n).alias("got"), V.dot(F.slice("a", start + 1, n), F.slice("b", start + 1, n)).alias("want"))
        assert got.where("got <> want").count() == 0
        assert ("zip_with" in planned(got.select("got"))) == (n > V.SPELT_PLACES)
