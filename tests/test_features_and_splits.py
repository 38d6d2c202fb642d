import pytest
from pyspark.sql import functions as F

from blocklens.operators import features, selection, splits
from blocklens.sources.logs import InputError
from checks import fixtures as X

EVENTS = "line_id long, ts_raw string, level string, component string, block_id string, event_id string"


def events(spark):
    rows = [
        (1, "240101000000", "INFO", "a", "blk_1", "E1"),
        (2, "240101000010", "warn", "b", "blk_1", "E2"),
        (3, "999999999999", "DEBUG", "b", "blk_1", "E2"),
        (4, "999999999999", None, "a", "blk_2", "E1"),
        (5, "240101000000", "ERROR", "a", None, "E1"),
        (6, "240101000000", "ERROR", "a", "", None),
    ]
    return spark.createDataFrame(rows, EVENTS)


def test_feature_matrix(spark):
    got = {r.block_id: r for r in features.feature_matrix(events(spark), ["E1", "E2", "E10"]).collect()}
    one, two = got["blk_1"], got["blk_2"]
    assert (one.total_log_events, one.unique_template_count, one.unique_component_count) == (3, 2, 2)
    assert one.time_duration_seconds == 10.0 and one.event_density == 3 / (10 + 1e-6)
    assert (one.info_count, one.warn_count, one.error_count, one.other_count) == (1, 1, 0, 1)
    assert two.time_duration_seconds == 0.0 and two.other_count == 1
    assert (one.tmpl_E1_count, one.tmpl_E2_count, one.tmpl_E10_count) == (1, 2, 0)
    assert list(features.feature_matrix(events(spark), ["E2", "E10", "E1"]).columns[-3:]) == [
        "tmpl_E1_count", "tmpl_E10_count", "tmpl_E2_count"]
    dropped = features.dropped_rows(events(spark)).first()
    assert (dropped.rows_read, dropped.rows_kept, dropped.rows_dropped) == (6, 4, 2)


def test_features_do_not_depend_on_partitions(spark, data):
    from checks import fixtures as X

    rows, ids = X.events(spark, data), X.event_ids(spark, data)
    one = features.feature_matrix(rows.repartition(1), ids)
    many = features.feature_matrix(rows.repartition(11, "line_id"), ids)
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_constant_column_scales_to_zero_and_back(spark):
    rows = spark.createDataFrame([("a", 5.0, 1.0), ("b", 5.0, 3.0)], "block_id string, k double, v double")
    scaler = features.fit_min_max(rows)
    scaled = features.scale_min_max(rows, scaler, ["k", "v"])
    assert [(r.k, r.v) for r in scaled.orderBy("block_id").collect()] == [(0.0, 0.0), (0.0, 1.0)]
    back = features.unscale_min_max(scaled, scaler, ["k", "v"])
    assert [(r.k, r.v) for r in back.orderBy("block_id").collect()] == [(5.0, 1.0), (5.0, 3.0)]


def test_out_of_range_values_may_leave_unit_interval_unless_clipped(spark):
    train = spark.createDataFrame([("a", 0.0), ("b", 2.0)], "block_id string, v double")
    other = spark.createDataFrame([("c", 3.0)], "block_id string, v double")
    scaler = features.fit_min_max(train)
    assert features.scale_min_max(other, scaler, ["v"]).first().v == 1.5
    assert features.scale_min_max(other, scaler, ["v"], clip=True).first().v == 1.0


def blocks(spark, n_normal, n_anomaly):
    rows = [(f"n{i}", "Normal") for i in range(n_normal)] + [(f"a{i}", "Anomaly") for i in range(n_anomaly)]
    return spark.createDataFrame(rows, "block_id string, label string")


def test_split_sizes_and_repeatability(spark):
    parts = splits.assign_splits(blocks(spark, 103, 21))
    sizes = {(r.split, r.label): r.n_blocks for r in splits.population(parts).collect()}
    assert sizes == {("train", "Normal"): 82, ("validation", "Normal"): 10, ("test", "Normal"): 11,
                     ("validation", "Anomaly"): 10, ("test", "Anomaly"): 11}
    again = splits.assign_splits(blocks(spark, 103, 21).orderBy(F.desc("block_id")).repartition(3))
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, again.collect()))
    splits.require_no_leakage(parts)


def test_small_and_empty_splits(spark):
    assert splits.training_ids(blocks(spark, 1, 3)).count() == 1
    with pytest.raises(InputError):
        splits.training_ids(blocks(spark, 0, 3))
    assert {r.split for r in splits.validation_test(blocks(spark, 1, 2)).collect()} == {"test"}


def test_leaks_are_errors(spark):
    rows = [("a", "train"), ("a", "test"), ("b", "test"), ("b", "test")]
    leaky = spark.createDataFrame(rows, "block_id string, split string")
    with pytest.raises(splits.LeakageError, match="train_test_overlap.*test_duplicates"):
        splits.require_no_leakage(leaky)


def test_selection_drops_later_members_even_of_dropped_ones(spark):
    rows = [(f"b{i}", float(i), 2.0 * i, 3.0 * i + (i % 2) * 1e-3, float((i * 7) % 5), 1.0) for i in range(40)]
    train = spark.createDataFrame(rows, "block_id string, a double, b double, c double, d double, e double")
    table = {r.feature: r for r in selection.selection(train, list("abcde")).collect()}
    assert [f for f in "abcde" if table[f].selected] == ["a", "d"]
    assert table["c"].n_correlated == 2  # with a and with b, although b itself is dropped
    assert selection.correlations(train, list("abcde")).filter("feature_b = 'e' AND r IS NOT NULL").count() == 0


def test_pivoted_matrix_equals_single_pass(spark, monkeypatch):
    one = features.feature_matrix(events(spark), ["E1", "E2"])
    monkeypatch.setattr(features, "SINGLE_PASS_TEMPLATES", 0)
    two = features.feature_matrix(events(spark), ["E1", "E2"])
    assert one.columns == two.columns
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_block_features_evaluate_nothing_over_raw_lines(spark, data):
    """Lines are parsed once and stored: counting by block neither parses nor masks them again."""
    counts = features.template_counts_long(features.partial_counts(X.events(spark, data)))
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "RLIKE" not in plan and "split" not in plan
