import math

import numpy as np
import pyarrow as pa
import pandas as pd
import pytest
from pyspark.sql import functions as F

from blocklens import config as C
from blocklens.operators import attribution, autoencoder, calibration, features, iforest
from blocklens.sources import sinks
from checks import fixtures as X

WIDTH = 64


@pytest.fixture(scope="module")
def vectors(spark, data):
    """Embedding vectors and, ten times as long, planted outliers."""
    rows = X.vectors(spark, data)
    columns = [c for c in rows.columns if c.startswith("f")]
    far = rows.filter("block_id IN ('vec_1', 'vec_2', 'vec_3')").select(
        F.concat(F.lit("far_"), "block_id").alias("block_id"), F.lit(C.ANOMALY).alias("label"),
        *[(F.col(c) * 10).alias(c) for c in columns])
    return rows.unionByName(far), columns


@pytest.fixture(scope="module")
def forest(vectors):
    rows, columns = vectors
    return iforest.fit_forest(rows.filter(F.col("label") == C.NORMAL), columns, n_trees=50, max_samples=128)


def scores(rows, model, **options):
    return {r.block_id: r.s for r in iforest.score_forest(rows, model, "s", **options).select("block_id", "s").collect()}


def test_planted_outliers_are_most_isolated(vectors, forest):
    found = scores(vectors[0], forest)
    assert all(-0.5 < s < 0.5 for s in found.values())
    top = sorted(found, key=found.get)[-3:]
    assert set(top) == {"far_vec_1", "far_vec_2", "far_vec_3"}
    rows = iforest.score_forest(vectors[0], forest).select(iforest.forest_label().alias("p"), "block_id")
    assert {r.p for r in rows.filter("block_id LIKE 'far_%'").collect()} == {C.ANOMALY}


def test_forest_does_not_depend_on_partitions(vectors, forest):
    rows, columns = vectors
    normal = rows.filter(F.col("label") == C.NORMAL).repartition(3, "f00")
    again = iforest.fit_forest(normal, columns, n_trees=50, max_samples=128)
    assert again.nodes.exceptAll(forest.nodes).isEmpty() and forest.nodes.exceptAll(again.nodes).isEmpty()


def test_samples_have_about_the_wanted_size_and_depth_is_limited(forest):
    roots = [r.n for r in forest.nodes.filter("node = 1").collect()]
    assert len(roots) == 50 and 100 < np.mean(roots) < 156
    assert forest.nodes.agg(F.max("node")).first()[0] < 2 ** 8
    inner = forest.nodes.filter("feature >= 0").alias("p")
    children = forest.nodes.groupBy("tree", F.floor(F.col("node") / 2).alias("parent")).agg(F.sum("n").alias("m"))
    joined = inner.join(children, (F.col("p.tree") == children.tree) & (F.col("p.node") == F.col("parent")), "left")
    assert joined.filter("m IS NULL OR m <> n").count() == 0


def test_chunked_scoring_equals_broadcast_scoring(vectors, forest):
    a, b, c = scores(vectors[0], forest), scores(vectors[0], forest, limit=4000), scores(vectors[0], forest, limit=1)
    assert all(abs(a[k] - c[k]) < 1e-12 for k in a)
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-12


def test_levels_split_by_aggregation_form_valid_trees(vectors):
    rows, columns = vectors
    model = iforest.fit_forest(rows, columns, n_trees=8, max_samples=1.0, local_rows=60)
    n = rows.count()
    assert {r.n for r in model.nodes.filter("node = 1").collect()} == {n}
    leaves = model.nodes.filter("feature < 0").groupBy("tree").agg(F.sum("n").alias("n")).collect()
    assert {r.n for r in leaves} == {n}
    assert model.nodes.groupBy("tree", "node").count().filter("count > 1").isEmpty()
    found = scores(rows, model)
    assert set(sorted(found, key=found.get)[-3:]) == {"far_vec_1", "far_vec_2", "far_vec_3"}


def test_node_table_does_not_depend_on_local_rows(vectors):
    rows, columns = vectors
    tables = []
    for local in (5, 60, 50_000):
        nodes = iforest.fit_forest(rows, columns, n_trees=8, max_samples=1.0, local_rows=local).nodes
        tables.append(sorted((r.tree, r.node, r.feature, None if r.feature < 0 else r.threshold, r.n) for r in nodes.collect()))
    assert tables[0] == tables[1] == tables[2]


def test_identical_rows_make_single_leaves(spark):
    rows = spark.range(300).select(F.col("id").cast("string").alias("block_id"), F.lit(1.0).alias("a"))
    for local in (1000, 50):
        model = iforest.fit_forest(rows, ["a"], n_trees=3, max_samples=1.0, local_rows=local)
        assert [(r.feature, r.n) for r in model.nodes.collect()] == [(-1, 300)] * 3


def test_average_path_values():
    # c(256) of the published formula
    assert np.allclose(iforest.average_path([1, 2, 256]), [0.0, 1.0, 10.244770920116851])


def scaled(vectors):
    rows, columns = vectors
    normal = rows.filter(F.col("label") == C.NORMAL)
    return features.scale_min_max(rows, features.fit_min_max(normal, columns), columns), columns


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    shapes = autoencoder.layer_shapes(5, (4, 3, 2))
    flat, x = rng.normal(size=len(autoencoder.initial_weights(shapes, 1))), rng.random((7, 5))
    _, grad = autoencoder._gradient(x, flat, shapes)
    loss = lambda w: autoencoder.squared_error(x, w, shapes).mean()
    for i in range(0, len(flat), 7):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        assert abs((loss(flat + step) - loss(flat - step)) / 2e-6 - grad[i]) < 1e-6


@pytest.fixture(scope="module")
def network(vectors):
    rows, columns = scaled(vectors)
    return autoencoder.fit_autoencoder(rows.filter(F.col("label") == C.NORMAL), columns, epochs=6, batch=16)


def test_training_reduces_loss_and_flags_outliers(vectors, network):
    losses = [loss for _, loss, _ in network.history]
    assert losses[-1] < losses[0] and all(v is not None for _, _, v in network.history)
    rows, _ = scaled(vectors)
    found = {r.block_id: r for r in autoencoder.score_autoencoder(rows, network).collect()}
    assert all(found[f"far_vec_{i}"].ae_prediction == C.ANOMALY for i in (1, 2, 3))
    assert min(r.ae_score for r in found.values()) == 0.0 and max(r.ae_score for r in found.values()) == 1.0


def test_any_way_of_training_gives_the_same_network(vectors):
    """Whole epochs in one task, or every step a job over rows in 1 or 5 partitions."""
    rows, columns = scaled(vectors)
    normal = rows.filter(F.col("label") == C.NORMAL)
    fit = lambda r, **way: autoencoder.fit_autoencoder(r, columns, epochs=2, batch=64, **way)
    one, few, many = fit(normal.coalesce(1)), fit(normal.coalesce(1), task_bytes=0), fit(normal.repartition(5, "f01"), task_bytes=0)
    assert one.history[-1][1] < one.history[0][1]
    for other in (few, many):
        assert np.allclose(one.weights, other.weights, rtol=0, atol=1e-6) and abs(one.threshold - other.threshold) < 1e-6
        assert np.allclose(one.history, other.history, atol=1e-6)


def test_one_step_is_adam_on_the_mean_gradient(vectors):
    rows, columns = scaled(vectors)
    normal = rows.filter(F.col("label") == C.NORMAL)
    x = np.array([[r[c] or 0.0 for c in columns] for r in normal.select(*columns).collect()])
    shapes = autoencoder.layer_shapes(len(columns))
    start = autoencoder.initial_weights(shapes, 3)
    _, g = autoencoder._gradient(x, start, shapes)
    expected = start - 0.01 * g / (np.abs(g) + 1e-7)
    model = autoencoder.fit_autoencoder(normal, columns, epochs=1, batch=10**9, held_out=0.0, rate=0.01, task_bytes=0, start=start)
    assert np.allclose(model.weights, expected, atol=1e-5)


def test_early_stopping_keeps_best_weights(vectors):
    rows, columns = scaled(vectors)
    model = autoencoder.fit_autoencoder(
        rows.filter(F.col("label") == C.NORMAL), columns, epochs=12, patience=1, rate=0.5)
    assert len(model.history) < 12
    best = min(v for _, _, v in model.history)
    assert model.history[-1][2] >= best


def test_saved_models_score_the_same(spark, vectors, forest, network, tmp_path):
    rows, _ = scaled(vectors)
    sinks.save_model({**forest.tables(), **network.tables(spark)}, str(tmp_path))
    tables = sinks.load_tables(spark, str(tmp_path), [*forest.tables(), *network.tables(spark)])
    assert scores(vectors[0], iforest.Forest.from_tables(tables)) == scores(vectors[0], forest)
    loaded = autoencoder.Autoencoder.from_tables(tables)
    assert loaded.threshold == network.threshold and loaded.history == [tuple(h) for h in network.history]
    assert np.array_equal(loaded.weights, network.weights)


def test_contributions_add_up_exactly(vectors, forest, network):
    rows, _ = vectors
    normal_rows, _ = scaled(vectors)
    for alerts, explain, model in ((rows, attribution.attribute_forest, forest), (normal_rows, attribution.attribute_autoencoder, network)):
        some = alerts.filter("block_id LIKE 'far_%' OR block_id = 'vec_9'")
        table = explain(some, attribution.background(alerts), model).toPandas()
        assert len(table) == 4 * WIDTH
        sums = table.groupby("block_id").agg(phi=("phi", "sum"), base=("base", "first"), f=("f_x", "first"))
        assert (sums["base"] + sums["phi"] - sums["f"]).abs().max() < 1e-9
        assert (sums.loc[["far_vec_1", "far_vec_2", "far_vec_3"], "phi"] > 0).all()


def test_attribution_finds_the_feature_that_matters(spark):
    rows = spark.range(50).select(
        F.concat(F.lit("b"), "id").alias("block_id"), (F.col("id") % 7 / 7).alias("a"), (F.col("id") % 5 / 5).alias("b"))
    table = attribution.attribute(rows, attribution.background(rows, 20), ["a", "b"], _only_first, "m").toPandas()
    assert (table.loc[table["feature"] == "b", "phi"].abs() < 1e-12).all()
    assert np.allclose(table.loc[table["feature"] == "a", "phi"] + table["base"].iloc[0], 3 * table.loc[table["feature"] == "a", "value"])


def exact_values(score, base_rows, x):
    """Shapley values by their definition, over all subsets."""
    d = len(x)
    value = {}
    for mask in range(2**d):
        chosen = np.array([mask >> k & 1 for k in range(d)], bool)
        value[mask] = score(np.where(chosen, x, base_rows)).mean()
    weight = [math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d) for s in range(d)]
    return np.array([sum(weight[m.bit_count()] * (value[m | 1 << k] - value[m]) for m in range(2**d) if not m >> k & 1) for k in range(d)])


def test_kernel_attribution_against_all_subsets(spark):
    """Eight features, a network and a forest: exact with all coalitions, within 1 % of the largest value with 120 of 254."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.random((150, 8)), rng.random((4, 8)) + 2])
    names = [f"f{k}" for k in range(8)]
    rows = spark.createDataFrame([(f"b{i}", *map(float, r)) for i, r in enumerate(x)], "block_id string, " + ", ".join(f"{n} double" for n in names))
    network = autoencoder.fit_autoencoder(rows, names, dims=(5, 3), epochs=2, batch=32)
    forest = iforest.fit_forest(rows, names, n_trees=20, max_samples=64)
    base = attribution.background(rows, 20)
    base_rows = np.array([[r[n] for n in names] for r in base.collect()])
    some = rows.filter("block_id IN ('b3', 'b150', 'b152')")
    for model, explain, score in (
        (network, attribution.attribute_autoencoder, lambda v: autoencoder.squared_error(v, network.weights, network.shapes)),
        (forest, attribution.attribute_forest, iforest.forest_scorer(forest)),
    ):
        for n, limit in ((254, 1e-9), (120, 0.01)):
            found = explain(some, base, model, n_coalitions=n).toPandas()
            for block, own in found.groupby("block_id"):
                own = own.set_index("feature").loc[names]
                expected = exact_values(score, base_rows, own["value"].to_numpy())
                # b3 lies inside: its values are small, so errors are held against the spread of the score.
                size = max(np.abs(expected).max(), np.abs(score(base_rows)).max())
                assert np.abs(own["phi"].to_numpy() - expected).max() < limit * size, (n, block)


def test_coalitions_are_weighted_as_the_kernel_says():
    z, w = attribution.coalitions(6, 62)
    assert len(z) == 62 and len({r.tobytes() for r in z}) == 62
    for row, weight in zip(z, w):
        s = int(row.sum())
        assert abs(weight - 5 / (s * (6 - s)) / math.comb(6, s)) < 1e-12
    z, w = attribution.coalitions(40, 300)
    assert len(z) <= 300 and abs(w[:80].sum() - 2 * 39 / 39) < 1e-12
    assert attribution.coalitions(1, 10)[0].shape == (0, 1) and attribution.coalitions(2, 10)[0].tolist() == [[1, 0], [0, 1]]


def test_a_large_background_is_refused(spark):
    rows = spark.range(30).select(F.col("id").cast("string").alias("block_id"), F.col("id").cast("double").alias("a"))
    with pytest.raises(ValueError, match="background"):
        attribution.attribute(rows, rows, ["a"], _only_first, "m", max_reference=20)
    assert attribution.attribute(rows, rows, ["a"], _only_first, "m", max_reference=30).count() == 30


def _only_first(x):
    return 3 * x[:, 0]


def test_isotonic_is_monotone_and_keeps_the_mean(spark, data):
    rows = X.pairs(spark, data)
    for score in ("if_score", "ae_score"):
        model = calibration.fit_isotonic(rows, score)
        fitted = calibration.calibrate(rows, model, score, "c").toPandas().sort_values([score, "c"])
        assert fitted["c"].is_monotonic_increasing and fitted["c"].between(0, 1).all()
        assert abs(fitted["c"].mean() - (fitted["label"] == "Anomaly").mean()) < 1e-9


def test_calibrator_round_trip_and_clipping(spark, data, tmp_path):
    model = calibration.fit_isotonic(X.pairs(spark, data), "if_score")
    sinks.save_model({}, str(tmp_path), {"cal": model})
    outside = spark.createDataFrame([(-5.0,), (0.5,), (7.0,)], "s double")
    a = [r.c for r in calibration.calibrate(outside, model, "s", "c").collect()]
    b = [r.c for r in calibration.calibrate(outside, sinks.load_calibrator(str(tmp_path), "cal"), "s", "c").collect()]
    assert a == b and a[0] == min(model.predictions) and a[2] == max(model.predictions)


def test_coalitions_by_leaves_equal_walking(spark):
    """Mean scores of coalitions summed over leaves are those of walking every mixed row, odd values included."""
    rng = np.random.default_rng(8)
    rows = pd.DataFrame(rng.integers(0, 9, (300, 5)).astype(float), columns=list("abcde")).assign(block_id=[f"b{i}" for i in range(300)])
    model = iforest.fit_forest(spark.createDataFrame(rows), list("abcde"), n_trees=20)
    scorer = iforest.forest_scorer(model)
    x, z = rows[list("abcde")].to_numpy(), attribution.coalitions(5, 30)[0]
    some, base = np.vstack([x[:40], [np.nan, -np.inf, np.inf, 4, 4]]), x[100:130]
    want = [[scorer(np.where(c > 0, one, base)).mean() for c in z] for one in some]
    assert scorer.sums_leaves(5) and np.abs(scorer.coalition_means(base, some, z) - want).max() < 1e-12


def test_alerts_are_dealt_to_all_tasks(spark):
    """Alerts of one partition are explained by as many tasks as there are cores, with the same values."""
    rng = np.random.default_rng(9)
    rows = pd.DataFrame(rng.random((64, 3)), columns=list("abc")).assign(block_id=[f"b{i:02d}" for i in range(64)])
    table = spark.createDataFrame(rows).coalesce(1)
    model = iforest.fit_forest(table, list("abc"), n_trees=10)
    found = attribution.attribute_forest(table, attribution.background(table, 20), model)
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    sums = found.groupBy("block_id").agg(F.abs(F.first("base") + F.sum("phi") - F.first("f_x")).alias("gap"))
    assert sums.count() == 64 and sums.filter("gap > 1e-9").isEmpty()


def test_an_epoch_in_one_task_holds_each_row_once():
    """Memory of a task is that of its rows and a batch, not two or three copies of them; unannounced rows are taken too."""
    import tracemalloc

    n, width, rng = 60_000, 32, np.random.default_rng(3)
    values, number = rng.random((n, width)), rng.integers(0, 240, n)

    def batches():
        for k in range(0, n, 2000):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 2000 * width + 1, width), pa.int32()), pa.array(values[k : k + 2000].ravel()))
            yield pa.RecordBatch.from_arrays([lists, pa.array(number[k : k + 2000])], names=["x", "batch"])

    shapes = autoencoder.layer_shapes(width)
    flat = autoencoder.initial_weights(shapes, 1)
    state = np.concatenate([flat, np.zeros(2 * len(flat)), [0.0]])
    order, expected = rng.permutation(240), state
    for k in order:
        _, g = autoencoder._gradient(values[number == k], expected[: len(flat)], shapes)
        expected = autoencoder._update(expected, g, 0.01)
    for most in (n, 0):
        tracemalloc.start()
        told = list(autoencoder._whole_epoch(state, shapes, 0.01, order, most)(batches()))[0]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert told.column("n")[0].as_py() == n
        assert np.allclose(told.column("numbers")[0].as_py(), expected, rtol=1e-9, atol=1e-12)
        assert not most or peak < 1.5 * values.nbytes


def test_large_trees_are_summed_over_leaves_too(spark):
    """Trees of more than a thousand leaves, more than 64 rows on either side, trees worked on in several parts."""
    rng = np.random.default_rng(3)
    x = rng.random((9_000, 4))
    rows = pd.DataFrame(x, columns=list("abcd")).assign(block_id=[f"b{i}" for i in range(len(x))])
    model = iforest.fit_forest(spark.createDataFrame(rows), list("abcd"), n_trees=6, local_rows=2_000)
    scorer, z = iforest.forest_scorer(model), attribution.coalitions(4, 14)[0]
    assert (scorer.walker.child < 0).sum() > 6 * 1_024 and scorer.sums_leaves(4)
    some, base = x[:70], x[500:600]
    want = [[scorer(np.where(c > 0, one, base)).mean() for c in z] for one in some]
    assert np.abs(scorer.coalition_means(base, some, z) - want).max() < 1e-12
    parts = iforest.NODES_AT_ONCE
    try:
        iforest.NODES_AT_ONCE = 1_000
        assert len(scorer._parts()) == 6 and np.abs(scorer.coalition_means(base, some, z) - want).max() < 1e-12
    finally:
        iforest.NODES_AT_ONCE = parts


def test_alerts_are_explained_in_the_order_of_likeness_and_returned_in_their_own(spark):
    rng = np.random.default_rng(12)
    x = np.repeat(rng.random((150, 3)), 2, axis=0)[rng.permutation(300)]
    order = iforest.alike(x)
    assert sorted(order) == list(range(300)) and len(iforest.alike(x[:0])) == 0
    near = np.abs(np.diff(x[order], axis=0)).sum(axis=1).mean()
    assert near < 0.8 * np.abs(np.diff(x, axis=0)).sum(axis=1).mean()
    rows = pd.DataFrame(x, columns=list("abc")).assign(block_id=[f"b{i:03d}" for i in range(300)])
    table = spark.createDataFrame(rows).coalesce(1)
    model = iforest.fit_forest(table, list("abc"), n_trees=10)
    score = iforest.forest_scorer(model)
    found = attribution.attribute_forest(table, attribution.background(table, 20), model).groupBy("block_id").agg(F.first("f_x").alias("f_x"), F.collect_list("value").alias("x")).toPandas()
    assert np.abs(score(np.stack(found["x"].to_list())) - found["f_x"]).max() < 1e-12
    assert np.array_equal(np.stack(found.sort_values("block_id")["x"].to_list()), x)
