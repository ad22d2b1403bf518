import numpy as np
import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from duoscope.operators import cluster, csr, halfspace, learn, sample
from duoscope.operators.project import UtilityModel
from duoscope.session import collect_bounded


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(5)
    xs, ys = rng.integers(-1, 2, (30, 5)).astype(float), rng.random((20, 4))
    truth = rng.normal(size=(2, 5)), rng.normal(size=(2, 4))
    pairs = [(int(u), int(i)) for u, i in rng.integers(0, (30, 20), (600, 2))]
    labels = [bool((truth[0] @ xs[u]) @ (truth[1] @ ys[i]) > 0) for u, i in pairs]
    users = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(xs)], "user_id long, vec array<double>")
    items = spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(ys)], "item_id long, vec array<double>")
    dyads = spark.createDataFrame([(u, i, l) for (u, i), l in zip(pairs, labels)], "user_id long, item_id long, label boolean")
    return xs, ys, pairs, labels, dyads, users, items


def biased(v):
    return np.append(v, 1.0)


def loss(w, v, xs, ys, pairs, labels):
    z = [1.0 if lab else -1.0 for lab in labels]
    dots = [(w @ biased(xs[u])) @ (v @ biased(ys[i])) for u, i in pairs]
    return np.mean([np.log1p(np.exp(-s * d)) for s, d in zip(z, dots)])


def gradient_of(rows, w, v):
    g = {"W": np.zeros_like(w), "V": np.zeros_like(v)}
    for r in rows:
        g[r["side"]][r["row"]] = np.array(r["total"]) / r["n"]
    return g["W"], g["V"]


def numeric(w, v, *data, eps=1e-6):
    out = []
    for m in (w, v):
        g = np.zeros_like(m)
        for i in np.ndindex(m.shape):
            old = m[i]
            m[i] = old + eps
            up = loss(w, v, *data)
            m[i] = old - eps
            g[i] = (up - loss(w, v, *data)) / (2 * eps)
            m[i] = old
        out.append(g)
    return out


def test_gradients_agree_with_finite_differences(world):
    xs, ys, pairs, labels, dyads, users, items = world
    rng = np.random.default_rng(1)
    w, v = rng.random((2, 6)) - 0.5, rng.random((2, 5)) - 0.5
    expected = numeric(w, v, xs, ys, pairs, labels)
    rows = learn.batch_gradients(learn.with_vectors(dyads, users, items), {0: (w, v)}).collect()
    for got, want in zip(gradient_of(rows, w, v), expected):
        assert np.allclose(got, want, atol=1e-6)
    rows = learn.entity_gradients(dyads, users, items, {0: (w, v), 5: (w * 2, v / 2)}).collect()
    for got, want in zip(gradient_of([r for r in rows if r.model == 0], w, v), expected):
        assert np.allclose(got, want, atol=1e-6)
    for got, want in zip(gradient_of([r for r in rows if r.model == 5], w, v), numeric(w * 2, v / 2, xs, ys, pairs, labels)):
        assert np.allclose(got, want, atol=1e-6)
    cells = learn.entity_gradient(dyads, users, items, UtilityModel(w, v, 1.0, True, True)).collect()
    both = {(r.side, r.row, r.col): r.value for r in cells}
    for side, want in zip("WV", expected):
        assert all(both[side, i, j] == pytest.approx(want[i, j], abs=1e-6) for i, j in np.ndindex(want.shape))


def test_full_batch_training_equals_numpy(world):
    xs, ys, pairs, labels, dyads, users, items = world
    s = learn.Settings(k=2, reg=0.05, l0=0.8, speed=0.1)
    fitted = learn.learn(dyads, users, items, s, max_iterations=5, minibatch=1e9, seed=2)
    rng = np.random.default_rng([2, 0])
    w, v = rng.random((2, 6)) - 0.5, rng.random((2, 5)) - 0.5
    again = learn.learn(dyads, users, items, s, max_iterations=5, minibatch=1e9, start=[(w, v)])
    assert np.allclose(again.w, fitted.w)
    for t in range(1, 5):  # one step less than max_iterations
        gw, gv = numeric(w, v, xs, ys, pairs, labels)
        rate = 0.8 / (1 + 0.1 * (t - 1))
        w, v = (m - rate * (g + 2 * 0.05 / np.sqrt(m.size) * m) for m, g in ((w, gw), (v, gv)))
    assert np.allclose(fitted.w, w, atol=1e-5) and np.allclose(fitted.v, v, atol=1e-5)


def test_learning_beats_guessing_and_grid_takes_the_first_best(world):
    *_, dyads, users, items = world
    points = learn.grid((2, 3), (1e-4,), (0.5, 2.0), (0.01,))
    result = learn.learn_tuned(dyads, users, items, points, minibatch=200, max_iterations=40, seed=1)
    rates = [r.hit_rate for r in result.table.orderBy("model").collect()]
    assert len(rates) == 4 and result.hit_rate == max(rates) > 0.7
    assert result.settings == points[rates.index(max(rates))]


def test_sampled_training_reads_each_step_and_is_repeatable(world):
    *_, dyads, users, items = world
    run = [learn.learn(dyads, users, items, learn.Settings(k=2), max_iterations=4, minibatch=20, seed=9) for _ in range(2)]
    assert np.allclose(run[0].w, run[1].w)


def test_only_encoded_dyads_are_drawn(world):
    """Dyads of unknown entities use up no draw: the model is that of the others alone."""
    *_, dyads, users, items = world
    none = dyads.withColumn("user_id", F.col("user_id") + 1_000_000)
    s = learn.Settings(k=2)
    one, both = (learn.learn(d, users, items, s, max_iterations=4, minibatch=20, seed=9) for d in (dyads, dyads.unionByName(none)))
    assert np.allclose(one.w, both.w) and np.allclose(one.v, both.v)
    assert learn.learn(none, users, items, s, max_iterations=4, minibatch=20, seed=9) is not None


def test_steps_in_several_scans_and_one(world):
    """How many steps are drawn together changes nothing, nor does the partitioning."""
    *_, dyads, users, items = world
    s = learn.Settings(k=2)
    models = [learn.learn(d, users, items, s, max_iterations=5, minibatch=400, seed=4) for d in (dyads, dyads.repartition(7))]
    assert np.allclose(models[0].w, models[1].w)
    ids = sample.numbered(dyads)
    whole = sample.minibatches(ids, 0.6, [1, 2, 3, 4], 4)
    parts = [sample.minibatches(ids, 0.6, [t], 4) for t in (1, 2, 3, 4)]
    for t, part in enumerate(parts, 1):
        assert sorted(map(tuple, part.collect())) == sorted(map(tuple, whole.where(F.col("step") == t).collect()))


def test_empty_draws_go_on_to_a_later_number(world):
    *_, dyads, users, items = world
    few = dyads.limit(5)
    assert learn.learn(few, users, items, learn.Settings(k=2), max_iterations=6, minibatch=0.2, seed=3) is not None


def test_one_scan_of_the_dyads(world, spark, tmp_path):
    """The two-sided gradient reads the interactions once."""
    *_, dyads, users, items = world
    dyads.write.parquet(str(tmp_path / "interactions"))
    stored = spark.read.parquet(str(tmp_path / "interactions"))
    rng = np.random.default_rng(1)
    rows = learn.entity_gradients(stored, users, items, {0: (rng.random((2, 6)), rng.random((2, 5)))})
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") - plan.count("LogicalRDD") == 1 or plan.count("parquet") == 1


@pytest.mark.parametrize("bias", [True, False])
def test_sparse_products(bias, monkeypatch):
    rng = np.random.default_rng(7)
    dense = rng.integers(-1, 2, (50, 9)) * (rng.random((50, 9)) < 0.3)
    dense[3] = dense[17] = 0
    m, g = rng.random((4, 9 + bias)), rng.random((50, 4))
    pos = pa.array([np.flatnonzero(r).astype(np.int32) for r in dense], pa.list_(pa.int32()))
    val = pa.array([r[r != 0].astype(float) for r in dense], pa.list_(pa.float64()))
    full = np.hstack([dense, np.ones((50, 1))]) if bias else dense
    for cells in (4, 100, 10**6):
        monkeypatch.setattr(csr, "CELLS", cells)
        for a, b in ((0, 50), (3, 4), (5, 31), (0, 0)):
            batch = csr.Batch(pos.slice(a, b - a), val.slice(a, b - a), 9 + bias, bias)
            assert np.allclose(batch.times(m), full[a:b] @ m.T) and np.allclose(batch.outer_sum(g[a:b]), g[a:b].T @ full[a:b])
    with pytest.raises(ValueError, match="outside"):
        csr.Batch(pos, val, 5, bias)


def test_numeric_trouble_gives_no_model(world):
    *_, dyads, users, items = world
    wild = learn.Settings(k=2, reg=1e200, l0=1e200)
    with np.errstate(all="ignore"):
        assert learn.learn(dyads, users, items, wild, max_iterations=6, minibatch=1e9) is None


def test_stops_after_ten_idle_steps():
    run = learn._Run(learn.Settings(k=1), np.zeros((1, 2)), np.zeros((1, 2)))
    table = {(0, side, 0): (1.0, [0.0, 0.0]) for side in "WV"}
    for t in range(1, 11):
        assert run.open
        learn._update(run, 0, table, t)
    assert not run.open and not run.failed


def test_minibatches_are_independent_draws(spark):
    rows = spark.range(20_000)
    drawn = sample.minibatches(sample.numbered(rows), 0.02, [1, 2, 3], 4)
    sizes = {r.step: r["count"] for r in drawn.groupBy("step").count().collect()}
    assert all(300 < sizes[t] < 500 for t in (1, 2, 3))
    assert drawn.groupBy("id", "step").count().where("count > 1").count() == 0


def test_split_is_disjoint_and_complete(spark):
    rows = spark.range(5000)
    train, test = sample.split(rows, ["id"], 0.7, 1)
    assert train.count() + test.count() == 5000 and train.join(test, "id").count() == 0
    assert 0.66 < train.count() / 5000 < 0.74
    again, _ = sample.split(rows.repartition(7), ["id"], 0.7, 1)
    assert again.exceptAll(train).count() == 0


def test_empty_sample_moves_on(spark):
    assert sample.bernoulli(spark.range(50), 0.01, 0).count() >= 1


def test_kmeans_counts_and_assignment(spark):
    rows = spark.range(300).select("id", F.array((F.col("id") % 3 * 10).cast("double"), F.rand(1)).alias("vec"))
    fitted, sizes = cluster.cluster_side(rows, "left", None, 3, 10, 1)
    assert sorted(r["size"] for r in sizes.collect()) == [100, 100, 100]
    centers = np.array(fitted.clusterCenters())
    mine = rows.withColumn("c", cluster.assign(F.col("vec"), np.arange(3), centers))
    from pyspark.ml.functions import array_to_vector

    theirs = fitted.transform(mine.withColumn("features", array_to_vector("vec")))
    assert theirs.where("c <> prediction").count() == 0


def test_labels_and_predicted_users(spark):
    m = UtilityModel(np.array([[1.0, 0.0], [0.0, 1.0]]), np.eye(2), 1.0)
    users = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, -1.0])], "user_id long, vec array<double>")
    labelled = cluster.label_entities(users, "left", m, np.array([[1.0, 5.0], [-1.0, 0.0], [0.0, -2.0]]))
    assert {r.user_id: r.u for r in labelled.collect()} == {1: [1, 0, 0], 2: [0, 0, 1]}
    popular = spark.createDataFrame([(0, [1.0, 1.0]), (1, None), (2, [-1.0, -1.0])], "idx int, vec array<double>")
    coded, known, width = cluster.predicted_users(users, popular, m)
    assert {r.user_id: r.liked for r in coded.collect()} == {1: [0], 2: [2]} and (known, width) == ([0, 2], 3)


@pytest.mark.parametrize("bias", [True, False])
def test_labels_of_predicted_users_are_those_of_their_vectors(spark, bias):
    rng = np.random.default_rng(2)
    m = UtilityModel(rng.normal(size=(3, 6 + bias)), np.eye(3), 1.0, bias, False)
    users = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(20)], "user_id long, vec array<double>")
    popular = spark.createDataFrame([(i, None if i == 4 else rng.normal(size=3).tolist()) for i in range(6)], "idx int, vec array<double>")
    centers = rng.normal(size=(5, 3))
    coded, known, width = cluster.predicted_users(users, popular, m)
    got = {r.user_id: (r.liked, r.u) for r in cluster.label_predicted(coded, known, m, centers).collect()}
    assert len(got) == 20 and known == [0, 1, 2, 3, 5]
    for liked, u in got.values():
        vec = np.array([0.0 if i not in known else 1.0 if i in liked else -1.0 for i in range(width)])
        proj = m.w @ (biased(vec) if bias else vec)
        assert u == [int(c @ proj > 0) for c in centers]


def some_predictions(spark, n_users=40, n_items=300, k=3):
    rng = np.random.default_rng(6)
    m = UtilityModel(rng.normal(size=(k, n_items + 1)), np.eye(k), 1.0, True, False)
    users = spark.createDataFrame([(i, rng.normal(size=n_items).tolist()) for i in range(n_users)], "user_id long, vec array<double>")
    popular = spark.createDataFrame([(i, None if i % 7 == 4 else rng.normal(size=k).tolist()) for i in range(n_items)], "idx int, vec array<double>")
    return cluster.Predictions(users, popular, m), m, rng.normal(size=(5, k))


def test_texts_and_labels_are_made_where_the_products_are(spark):
    """They equal those made of the lists of positions, but these, as large as both sides' product, go to no other function."""
    predicted, m, centers = some_predictions(spark)
    known = predicted.known
    marks = tuple([f"{p}:{v}" for p in known] for v in ("1", "-1"))
    rows = predicted.spelt(marks, " ", centers)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan.split("MapInArrow")[0] and plan.count("ArrowEvalPython") == 1
    again = cluster.label_predicted(predicted.liked(), known, m, centers).withColumn("text", cluster.spelt(F.col("liked"), known, predicted.width, marks, " "))
    want = {r.user_id: (r.text, r.u) for r in again.collect()}
    assert {r.user_id: (r.text, r.u) for r in rows.collect()} == want and len(want) == 40


def test_blocks_of_texts_stay_small(spark, monkeypatch):
    """What a task sends at once is bounded by cells, not by users."""
    monkeypatch.setattr(cluster, "BLOCK_CELLS", 1000)
    predicted, *_ = some_predictions(spark)
    sizes = []
    monkeypatch.setattr(cluster, "_joined", lambda batches: batches)
    monkeypatch.setattr(type(predicted.mapped), "mapInArrow", lambda self, code, schema: sizes.append(code))
    predicted.spelt((["1"] * len(predicted.known), ["-1"] * len(predicted.known)), ",")
    batch = pa.RecordBatch.from_pydict({"user_id": list(range(50)), "proj": [[1.0, -1.0, 0.5]] * 50})
    assert {b.num_rows for b in sizes[0](iter([batch]))} <= {1, 2, 3}


@pytest.mark.parametrize("lam", [1.0, -0.5, 1e-9])
@pytest.mark.parametrize("k", [1, 2, 3, 6])
def test_counts_by_boxes_are_those_of_all_products(k, lam):
    rng = np.random.default_rng(k)
    q, p = rng.normal(size=(2000, k)), rng.normal(size=(200, k))
    whole = rng.integers(-2, 3, (2000, k)).astype(float), rng.integers(-2, 3, (200, k)).astype(float)  # many products are 0
    odd = q.copy(), p.copy()
    odd[0][::7], odd[0][3::50], odd[0][5::11], odd[1][::9], odd[1][4] = np.nan, np.inf, 0.0, np.nan, 0.0
    far = q * 10.0 ** rng.integers(-200, 200, (2000, 1)), p
    m = UtilityModel(np.zeros((0, 0)), np.zeros((0, 0)), lam)
    with np.errstate(all="ignore"):
        for fixed, rows in ((q, p), whole, odd, far, (q[:0], p), (q[:1], p)):
            assert halfspace.counts(halfspace.boxes(fixed, 16), rows, m).tolist() == m.over_half(rows, fixed).sum(axis=1).tolist()


def test_counts_leave_most_products_out(monkeypatch):
    rng = np.random.default_rng(1)
    q, p = rng.normal(size=(50_000, 3)), rng.normal(size=(100, 3))
    m, cells, plain = UtilityModel(np.zeros((0, 0)), np.zeros((0, 0)), 1.0), [], UtilityModel.over_half
    monkeypatch.setattr(UtilityModel, "over_half", lambda self, a, b: cells.append(len(a) * len(b)) or plain(self, a, b))
    assert halfspace.counts(halfspace.boxes(q), p, m).tolist() == (p @ q.T > 0).sum(axis=1).tolist()
    assert sum(cells) < 50_000 * 100 / 5


def test_more_than_a_million_popular_items(spark):
    """No fixed number of items ends the job."""
    n = 1_000_001
    popular = spark.range(n).select(F.col("id").cast("int").alias("idx"), F.array(F.when(F.col("id") % 3 == 0, 1.0).otherwise(-1.0)).alias("vec"))
    users = spark.createDataFrame([(1, [1.0]), (2, [-1.0]), (3, [0.0])], "user_id long, vec array<double>")
    predicted = cluster.Predictions(users, popular, UtilityModel(np.eye(1), np.eye(1), 1.0))
    third = (n + 2) // 3
    assert predicted.width == len(predicted.at) == n
    assert {r.user_id: r.n for r in predicted.counts().collect()} == {1: third, 2: n - third, 3: 0}


def test_collecting_too_much_is_refused(spark):
    with pytest.raises(ValueError, match="more than 5"):
        collect_bounded(spark.range(6), 5, "rows")
