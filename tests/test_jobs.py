"""The jobs in a row, from text inputs to pruned reports."""

import random

import numpy as np
import pytest
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import functions as F

from duoscope import fixed
from duoscope.functions import scalars as S
from duoscope.operators import encode, learn, sample, trees
from duoscope.operators.project import UtilityModel, factors_of
from duoscope.plans import jobs
from duoscope.queries import learning as queries
from duoscope.queries.registry import VIEWS
from duoscope.sources import tables


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    rng = random.Random(8)
    folder = tmp_path_factory.mktemp("in")
    names = [g for g in fixed.GENRES if g.isalpha()]
    items = ["movieId,title,genres"] + [
        f'{i},"Item {i}, The ({1950 + i})",{"|".join(rng.sample(names, 2))}' for i in range(1, 41)] + ["41,No year,Drama"]
    ratings = ["userId,movieId,rating,timestamp"] + [
        f"{u},{i},{rng.choice([2.0, 3.5, 4.0, 5.0])},0" for u in range(1, 61) for i in rng.sample(range(1, 42), 12)]
    tags = ["movieId,tagId,relevance"] + [f"{i},{t},{rng.random():.3f}" for i in range(1, 39) for t in (1, 2, 4)]
    paths = {}
    for name, lines in (("items", items), ("ratings", ratings), ("tags", tags)):
        paths[name] = str(folder / name)
        (folder / name).write_text("\n".join(lines) + "\n")
    return paths


@pytest.fixture(scope="module")
def coded(spark, inputs, tmp_path_factory):
    work = str(tmp_path_factory.mktemp("work") / "codes")
    first = jobs.encode_inputs(spark, **inputs, min_ratings=10, work=work)
    again = jobs.encode_inputs(spark, **inputs, min_ratings=10, work=work)
    assert first["users"].count() == again["users"].count() == 60
    return first


def test_encoded_sides(coded):
    assert coded["items"].count() == 38  # rated, with a year, with tags
    row = coded["items"].first()
    assert len(row.bin) == 20 and len(row.num) == 5
    users, items, widths = jobs.sparse_sides(coded)
    assert widths == (coded["id_map"].count(), 25)
    assert users.where("not forall(val, v -> v in (-1.0, 1.0)) or size(pos) <> size(val)").isEmpty() and items.where("exists(val, v -> v = 0)").isEmpty()


def test_codes_keep_their_zeros_out(spark, coded, tmp_path):
    jobs.export_codes(coded, str(tmp_path))
    codes = tables.read_codes(spark, f"{tmp_path}/users")
    assert codes.count() == 60 and {r.width for r in codes.collect()} == {coded["id_map"].count()}


def test_stored_dyads_teach_the_same(spark, coded, tmp_path):
    """Learning from exported rows equals learning from the tables; each distinct vector is kept once."""
    path = str(tmp_path / "d")
    jobs.export_dyads(coded, path)
    ids, users, items, widths = tables.read_dyad_sides(spark, path)
    left, right, sizes = jobs.sparse_sides(coded)
    assert widths == sizes and ids.count() == coded["outcomes"].join(coded["items"], "item_id", "left_semi").count()
    assert users.count() == left.select("pos", "val").distinct().count() and items.count() == right.select("pos", "val").distinct().count()
    s = learn.Settings(k=3, reg=1e-4, l0=0.5)
    labelled = coded["outcomes"].withColumnRenamed("outcome", "label")
    stored = learn.learn(ids, users, items, s, max_iterations=4, minibatch=1e9, seed=1, widths=widths)
    direct = learn.learn(labelled, left, right, s, max_iterations=4, minibatch=1e9, seed=1, widths=widths)
    assert np.allclose(stored.w, direct.w) and np.allclose(stored.v, direct.v)
    result = jobs.learn_stored(spark, path, str(tmp_path / "f"), learn.grid((2,), (1e-4,), (0.5,), (0.1,)), 50, 5, 1)
    assert np.allclose(UtilityModel.load(spark, str(tmp_path / "f")).w, result.model.w)


def test_dense_rows_of_another_tool_and_wrong_widths(spark, tmp_path):
    from pyspark.ml.functions import array_to_vector

    rows = [(1.0, [1.0, 0.0, -1.0, 0.5]), (0.0, [1.0, 0.0, 0.0, 0.5]), (1.0, [1.0, 0.0, -1.0, 0.25]), (1.0, [1.0, 0.0, -1.0, 0.5])]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "label double, v array<double>").select("label", array_to_vector("v").alias("features")).write.parquet(path)
    ids, users, items, widths = tables.read_dyad_sides(spark, path, {"left_tri": 3, "right_num": 1})
    assert widths == (3, 1) and ids.count() == 4
    assert sorted((r.pos, r.val) for r in users.collect()) == [([0], [1.0]), ([0, 2], [1.0, -1.0])]
    assert sorted((r.pos, r.val) for r in items.collect()) == [([0], [0.25]), ([0], [0.5])]
    with pytest.raises(Exception, match="dyad width"):
        tables.read_dyad_sides(spark, path, {"left_tri": 3})


def test_dyads_export_and_copies(spark, coded, tmp_path):
    path = str(tmp_path / "d")
    jobs.export_dyads(coded, path)
    rows = tables.read_dyads(spark, path)
    kept = coded["outcomes"].join(coded["items"], "item_id", "left_semi").count()
    assert rows.count() == kept == spark.read.orc(jobs.to_object(spark, path)).count()
    one = rows.first()
    assert one.left_bin is None and len(one.left_tri) == coded["id_map"].count() and len(one.right_bin) == 20


def test_from_learning_to_pruned_report(spark, coded, tmp_path):
    out = str(tmp_path)
    result = jobs.learn_utility(coded, f"{out}/f", learn.grid((3,), (1e-4,), (0.5,), (0.1,)), 50, 10, 1)
    model = UtilityModel.load(spark, f"{out}/f")
    assert np.allclose(model.w, result.model.w) and model.biased_left and model.biased_right
    jobs.cluster_sides(coded, model, f"{out}/c", k=4, iterations=5, seed=1)
    users, items, widths = jobs.sparse_sides(coded)
    centers = np.array(KMeansModel.load(f"{out}/c/users_model").clusterCenters())
    split = jobs.export_labels(items, "right", model, centers, widths[1], f"{out}/labels")
    assert split == 25
    assert jobs.export_labels(users, "left", model, np.array(KMeansModel.load(f"{out}/c/items_model").clusterCenters()), widths[0],
                              f"{out}/user_labels") == widths[0]
    popular = coded["id_map"].join(items, "item_id", "left").select("idx", "pos", "val")
    assert jobs.export_predicted_users(users, popular, model, centers, f"{out}/predicted") == widths[0]
    lines = tables.read_libsvm(spark, f"{out}/predicted", widths[0] + 4)
    assert lines.count() == 60 and {v for r in lines.collect() for v in r.features[:widths[0]]} <= {-1.0, 0.0, 1.0}
    names = encode.item_variables(spark.createDataFrame([(0, "slow"), (1, "fast"), (7, "unused")], "pos int, name string"), 4)
    assert names.count() == 23
    nodes = jobs.explain(spark, f"{out}/labels", 29, split, f"{out}/c/users_sizes", f"{out}/tree", names, max_level=3, num_candidates=2)
    text = "\n".join(r.value for r in spark.read.text(f"{out}/tree/report").collect())
    assert text.count("%") == nodes.count()
    picked = jobs.prune_sweep(spark.read.parquet(f"{out}/tree/nodes"), f"{out}/sweep").first()
    assert picked.fixed_leaves <= trees.leaf_counts(nodes).first().leaves
    assert spark.read.csv(f"{out}/sweep/sweep", sep=";", header=True).count() == 100
    model_path = f"{out}/attributes"
    jobs.cluster_attributes(spark, f"{out}/labels", 29, split, model_path, k=3, iterations=5, seed=1)
    entropy = jobs.clustering_entropy(spark, f"{out}/labels", 29, split, model_path, f"{out}/c/users_sizes").first().entropy
    assert 0 <= entropy <= 1
    parquet = jobs.to_parquet(spark, f"{out}/labels", 29)
    assert spark.read.parquet(parquet).count() == 38


def test_every_step_of_learn_utility_takes_all_training_dyads(coded, tmp_path, monkeypatch):
    """Nothing is drawn, and the model is that of full steps; the query and its SQL draw nothing either."""
    keys, s = ["user_id", "item_id"], learn.Settings(k=2, reg=1e-4, l0=0.5)
    users, items, widths = jobs.sparse_sides(coded)
    train, _ = sample.split(coded["outcomes"].withColumnRenamed("outcome", "label"), keys, 0.7, 1)
    whole = learn.learn(train, users, items, s, max_iterations=4, minibatch=1e15, seed=1, widths=widths)
    monkeypatch.setattr(sample, "minibatches", lambda *_: pytest.fail("a part of the dyads was drawn"))
    result = jobs.learn_utility(coded, str(tmp_path / "f"), [s], max_iterations=4, seed=1)
    assert np.allclose(result.model.w, whole.w) and np.allclose(result.model.v, whole.v)
    assert all("WHERE" not in VIEWS[f"job_b{t}"][1] for t in range(1, 6))
    asked = []
    monkeypatch.setattr(queries, "coded", lambda *_: coded)
    monkeypatch.setattr(jobs.learn, "learn_tuned", lambda *given, **_: asked.append(given) or result)
    queries.job_learn_utility(coded["users"].sparkSession, "")
    assert asked[0][4] is None


def test_factor_csv_pair(spark, tmp_path):
    w = np.array([[0, 50, 50, 0, 5, 10], [0, 100, 100, 0, 10, 20]], dtype=float)
    full = tables.write_factor_csv(factors_of(spark, w, -w), str(tmp_path / "u"), True, False)
    assert full.endswith("_true_false")
    back = UtilityModel.load(spark, full)
    assert np.array_equal(back.w, w) and np.array_equal(back.v, -w) and (back.biased_left, back.biased_right) == (True, False)


def test_plain_csv_pair_of_another_tool(spark, tmp_path):
    for n in "WV":
        (tmp_path / f"m_false_true_{n}.csv").write_text("1.0,2.5\n-3.0,1e-3\n")
    back = UtilityModel.load(spark, str(tmp_path / "m_false_true"))
    assert back.w.tolist() == [[1.0, 2.5], [-3.0, 0.001]] and (back.biased_left, back.biased_right) == (False, True)


@pytest.mark.parametrize("kind,expected", [("genre", ("👎", "👍")), ("item", ("👎", "👍")), ("tag", ("< 0.2500", "> 0.2500")), ("year", ("< 1922.0", "> 1922.0"))])
def test_names_of_split_sides(spark, kind, expected):
    low, high = S.split_names(F.lit(kind), F.lit(0.25))
    assert tuple(spark.range(1).select(low.alias("l"), high.alias("h")).first()) == expected


def test_edges_with_names(spark):
    nodes = spark.createDataFrame([(0, "", None, float("-inf"), float("inf"), 1.0, 0.9), (0, "L", 5, float("-inf"), 0.5, 0.4, 0.1), (0, "R", 5, 0.5, float("inf"), 0.6, 0.2)],
                                  "tree_id int, path string, var int, lo double, hi double, rel_size double, data_entropy double")
    names = spark.createDataFrame([(5, "Comedy", "genre")], "var int, name string, kind string")
    assert sorted(tuple(r) for r in trees.edges(nodes, names).collect()) == [(0, 0, 1, 5, "Comedy", "👎"), (0, 0, 2, 5, "Comedy", "👍")]
    assert sorted(r.label for r in trees.edges(nodes).collect()) == ["< 0.5000", "> 0.5000"]
