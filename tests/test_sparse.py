import numpy as np
import pytest
from pyspark.sql import functions as F

from blocklens import config as C
from blocklens.operators import autoencoder, selection, sparse
from checks import fixtures as X


def table(spark, values):
    """A matrix of numbers as blocks with columns f0, f1, ..."""
    rows = [(f"b{i}", *map(float, r)) for i, r in enumerate(values)]
    return spark.createDataFrame(rows, "block_id string, " + ", ".join(f"f{k} double" for k in range(len(values[0]))))


def index_of(spark, n):
    return spark.createDataFrame([(f"f{k}", k) for k in range(n)], "feature string, i long")


def test_strong_pairs_are_all_strong_pairs(spark):
    """Together, never together (complements), constant, and frequent against rare features."""
    rng = np.random.default_rng(4)
    x = (rng.random((300, 14)) < 0.3) * rng.integers(1, 5, (300, 14))
    x[:, 1] = 2 * x[:, 0] + (rng.random(300) < 0.02)
    x[:, 3] = x[:, 2] == 0  # r is near -1 without a common cell
    x[:, 2] = x[:, 2] > 0
    x[:, 4], x[:, 5] = 0, 7
    x[:, 6] = np.arange(300) < 3
    x[:, 7] = 1 - x[:, 6]
    vectors, index = sparse.from_matrix(table(spark, x), [f"f{k}" for k in range(14)]), index_of(spark, 14)
    got = {(r.i, r.j): r.r for r in sparse.correlations(vectors, index).collect()}
    with np.errstate(invalid="ignore"):
        expected = np.corrcoef(x.T)
    assert len(got) == 14 * 13 // 2
    for (i, j), r in got.items():
        assert (r is None) == bool(np.isnan(expected[i, j])) and (r is None or abs(r - expected[i, j]) < 1e-9)
    for limit in (0.95, 0.6, 0.3):
        strong = {(r.i, r.j) for r in sparse.strong_pairs(vectors, index, limit).collect()}
        assert strong == {k for k, r in got.items() if r is not None and abs(r) > limit}
    assert {(0, 1), (2, 3), (6, 7)} <= {(r.i, r.j) for r in sparse.strong_pairs(vectors, index).collect()}


def test_selection_is_that_of_the_wide_table(spark, data):
    matrix = X.matrix(spark, data)
    vectors = sparse.from_matrix(matrix, X.FEATURES)
    index = spark.createDataFrame([(f, i) for i, f in enumerate(X.FEATURES)], "feature string, i long")
    wide = {r.feature: (r.n_correlated, r.selected) for r in selection.selection(matrix, X.FEATURES).collect()}
    found = sparse.selection(vectors, index).join(index, "i")
    assert {r.feature: (r.n_correlated, r.selected) for r in found.collect()} == wide
    rows, kept = sparse.kept_only(vectors, found.filter("selected"), index)
    names = [r.feature for r in kept.orderBy("i").collect()]
    assert names == selection.selected_features(matrix, X.FEATURES) and [r.i for r in kept.orderBy("i").collect()] == list(range(len(names)))
    dense = {r.block_id: [float(r[n]) for n in names] for r in matrix.collect()}
    for r in rows.collect():
        own = [0.0] * len(names)
        for c in r.cells:
            own[c.i] = c.v
        assert own == dense[r.block_id]


def test_scaling_and_empty_vectors(spark):
    vectors = sparse.from_matrix(table(spark, [[0, 5, 2], [4, 5, 0], [2, 5, 0]]), ["f0", "f1", "f2"])
    scaled = sparse.scale_min_max(vectors, sparse.moments(vectors, index_of(spark, 3)))
    assert {r.block_id: [(c.i, c.v) for c in r.cells] for r in scaled.collect()} == {"b0": [(2, 1.0)], "b1": [(0, 1.0)], "b2": [(0, 0.5)]}
    negative = sparse.from_matrix(table(spark, [[-1.0], [2.0]]), ["f0"])
    with pytest.raises(Exception, match="0 and more"):
        sparse.scale_min_max(negative, sparse.moments(negative, index_of(spark, 1))).collect()
    empty = vectors.limit(0)
    assert sparse.scale_min_max(empty, sparse.moments(empty, index_of(spark, 3))).count() == 0
    assert sparse.strong_pairs(empty, index_of(spark, 3)).count() == 0


def test_autoencoder_reads_sparse_vectors(spark):
    rng = np.random.default_rng(1)
    x = (rng.random((200, 12)) < 0.4) * rng.random((200, 12))
    dense, names = table(spark, x), [f"f{k}" for k in range(12)]
    vectors = sparse.from_matrix(dense, names)
    options = dict(dims=(6, 3), epochs=3, batch=32)
    one = autoencoder.fit_autoencoder(dense, names, **options)
    for more in ({}, {"task_bytes": 0}):
        two = autoencoder.fit_autoencoder(vectors, 12, **options, **more)
        assert np.allclose(one.weights, two.weights, atol=1e-9) and abs(one.threshold - two.threshold) < 1e-9
    a = {r.block_id: r.reconstruction_error for r in autoencoder.score_autoencoder(dense, one).collect()}
    b = {r.block_id: r.reconstruction_error for r in autoencoder.score_autoencoder(vectors, two).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_thousands_of_templates_need_no_columns(spark):
    """8,000 templates: vectors, scaling, strong pairs and a network over them."""
    lines = spark.range(24_000).select(
        F.concat(F.lit("b"), F.col("id") % 400).alias("block_id"), F.concat(F.lit("E"), F.floor(F.col("id") / 3)).alias("event_id"),
        F.lit("c").alias("component"), F.lit("INFO").alias("level"), F.lit("240101000000").alias("ts_raw"))
    index = sparse.feature_index(lines.select("event_id").distinct())
    assert index.count() == 8_000 + len(C.BASE_FEATURES) and index.agg(F.max("i")).first()[0] == 8_000 + len(C.BASE_FEATURES) - 1
    vectors = sparse.block_vectors(lines, index)
    scaled = sparse.scale_min_max(vectors, sparse.moments(vectors, index))
    assert scaled.count() == 400 and sparse.strong_pairs(vectors, index).count() > 0
    model = autoencoder.fit_autoencoder(scaled, 8_000 + len(C.BASE_FEATURES), dims=(4,), epochs=1, task_bytes=0)
    assert autoencoder.score_autoencoder(scaled, model).count() == 400
