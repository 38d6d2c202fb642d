import pytest
from pyspark.sql import functions as F

from blocklens.operators import fusion, metrics, triage
from blocklens.sources.logs import InputError

SCORED = "block_id string, label string, score double, prediction string"


def matrix(spark, tn, fp, fn, tp):
    return metrics.rates(spark.createDataFrame([(tn, fp, fn, tp)], "tn long, fp long, fn long, tp long")).first()


def test_published_confusion_matrices(spark):
    """Rates of published confusion matrices."""
    r = matrix(spark, 55735, 88, 3, 8416)
    assert (r.accuracy, r.precision, r.recall, r.f1_score) == (0.998583, 0.989652, 0.999644, 0.994623)
    r = matrix(spark, 85436, 26209, 3561, 13277)
    assert (r.accuracy, r.precision, r.recall, r.f1_score) == (0.768296, 0.336246, 0.788514, 0.471451)
    r = matrix(spark, 103289, 8356, 6502, 10336)
    assert (r.accuracy, r.precision, r.recall, r.f1_score) == (0.884358, 0.552964, 0.61385, 0.581818)


def test_zero_division_gives_zero(spark):
    r = matrix(spark, 5, 0, 0, 0)
    assert (r.precision, r.recall, r.f1_score, r.false_positive_rate) == (0.0, 0.0, 0.0, 0.0)


def scored(spark, *rows):
    return spark.createDataFrame([(f"b{i}", *r, "Normal") for i, r in enumerate(rows)], SCORED)


def test_average_precision_is_the_step_sum(spark):
    rows = scored(spark, ("Anomaly", 0.9), ("Normal", 0.8), ("Anomaly", 0.7), ("Normal", 0.1))
    got = metrics.areas(metrics.score_curve(rows)).first()
    assert (got.roc_auc, got.pr_auc) == (0.75, 0.833333)


def test_ties_share_a_threshold(spark):
    rows = scored(spark, ("Anomaly", 0.5), ("Normal", 0.5), ("Normal", 0.5), ("Anomaly", 0.5))
    got = metrics.areas(metrics.score_curve(rows)).first()
    assert (got.roc_auc, got.pr_auc) == (0.5, 0.5)
    assert metrics.pr_curve(metrics.score_curve(rows)).count() == 1


def test_one_class_has_no_auc(spark):
    row = metrics.evaluate(scored(spark, ("Normal", 0.5), ("Normal", 0.2))).first()
    assert row.roc_auc is None and "one class" in row.warning and row.slice == "test"


def test_best_threshold_prefers_the_lowest_and_falls_back(spark):
    rows = scored(spark, ("Anomaly", 0.9), ("Anomaly", 0.8), ("Normal", 0.1))
    assert metrics.best_threshold(metrics.score_curve(rows)).first().threshold == 0.8
    flat = scored(spark, ("Normal", 0.3), ("Normal", 0.2))
    assert metrics.best_threshold(metrics.score_curve(flat)).first().threshold == 0.2
    empty = scored(spark, ("Normal", 0.3)).filter("false")
    assert metrics.best_threshold(metrics.score_curve(empty)).first().threshold == 0.5


def test_precision_at_k_is_capped(spark):
    rows = scored(spark, ("Anomaly", 0.9), ("Normal", 0.8), ("Anomaly", 0.7))
    got = {r.k: (r.k_used, r.precision_at_k, r.recall_at_k) for r in metrics.precision_at(rows, ks=(1, 2, 50)).collect()}
    assert got == {1: (1, 1.0, 0.5), 2: (2, 0.5, 0.5), 50: (3, 0.666667, 1.0)}


def test_label_join_errors(spark):
    rows = scored(spark, ("x", 0.1)).drop("label")
    label = lambda v, b="b0": spark.createDataFrame([(b, v)], "block_id string, label string")
    with pytest.raises(InputError, match="Odd"):
        metrics.join_labels(rows, label("Odd"))
    with pytest.raises(InputError, match="both"):
        metrics.join_labels(rows, label("Normal", "zz"))


def test_fusion_checks(spark):
    with pytest.raises(ValueError, match="sum to 1"):
        fusion.weighted(F.lit(1.0), F.lit(1.0), 0.2, 0.9)
    a = spark.createDataFrame([("x", 1.0)], "block_id string, if_score double")
    b = spark.createDataFrame([("y", 1.0)], "block_id string, ae_score double")
    with pytest.raises(InputError):
        fusion.join_scores(a, b)


def alerts(spark):
    rows = [("blk_1", 0.8, "Anomaly"), ("blk_2", 0.323459, "Anomaly"), ("blk_3", 0.15, "Normal"), ("blk_4", 0.1, "Normal"), ("blk_5", None, "Normal")]
    return triage.with_severity(spark.createDataFrame(rows, "block_id string, fusion_score double, fusion_prediction string"))


def test_severity_edges_and_queue(spark):
    got = [(r.block_id, r.severity, r.priority) for r in triage.alert_queue(alerts(spark), 4).collect()]
    assert got == [("blk_1", "CRITICAL", 1), ("blk_2", "HIGH", 2), ("blk_3", "MEDIUM", 3), ("blk_4", "LOW", 4)]


def test_search_is_literal_unless_asked(spark):
    assert triage.filter_alerts(alerts(spark), search="blk_[12]").count() == 0
    assert triage.filter_alerts(alerts(spark), search="blk_[12]", regex=True).count() == 2


def test_queue_needs_no_full_sort(spark):
    plan = triage.alert_queue(alerts(spark))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_histogram_puts_the_maximum_in_the_last_bin(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,), (0.5,)], "s double")
    assert {r.bin: r.n_blocks for r in triage.histogram(rows, "s").collect()} == {1: 1, 31: 1, 60: 1}
    flat = spark.createDataFrame([(2.0,), (2.0,)], "s double")
    assert {r.bin: r.n_blocks for r in triage.histogram(flat, "s").collect()} == {1: 2}


def test_master_table_without_optional_inputs(spark):
    assert triage.master_table(alerts(spark)).count() == 5


def test_analyst_view_hides_labels(spark):
    rows = triage.with_priority(alerts(spark)).withColumn("label", F.lit("Anomaly"))
    assert "label" not in triage.analyst_view(rows).columns
