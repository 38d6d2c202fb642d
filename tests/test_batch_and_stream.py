import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from blocklens.operators import features, templates
from blocklens.plans import batch, score
from blocklens.sources import lookup
from blocklens.streaming import live
from checks import fixtures as X


@pytest.fixture(scope="module")
def corpus(spark, data, tmp_path_factory):
    """The log lines as text files and the labels as CSV."""
    root = tmp_path_factory.mktemp("corpus")
    rows = X.log_lines(spark, data).orderBy("line_id").select("raw_line")
    rows.repartitionByRange(3, "raw_line").write.text(str(root / "logs"))
    labels = X.block_labels(spark, data).select(F.col("block_id").alias("BlockId"), F.col("label").alias("Label"))
    labels.coalesce(1).write.option("header", "true").csv(str(root / "labels"))
    return root


@pytest.fixture(scope="module")
def result(spark, corpus):
    settings = {"forest": {"n_trees": 20, "max_samples": 0.5}, "network": {"epochs": 3}, "baseline": {"n_trees": 10, "max_samples": 8}}
    return batch.run(spark, str(corpus / "logs"), str(corpus / "labels"), str(corpus / "out"), **settings)


def test_batch_run_end_to_end(spark, data, corpus, result):
    assert result["events"].count() == X.events(spark, data).count()
    assert {r.template for r in result["dictionary"].collect()} == {r.template for r in X.mined(spark, data).dictionary.collect()}
    assert result["matrix"].count() == result["fused"].count() == result["alerts"].count() == 15
    assert {r.model for r in result["evaluation"].collect()} == {"autoencoder", "isolation_forest", "fusion"}
    assert {"severity", "label", "total_log_events"} <= set(result["alerts"].columns)
    report = spark.read.json(str(corpus / "out/reports/parsing")).first()
    assert report.total_lines_parsed == result["events"].count() and report.unique_template_count == 8
    totals = spark.read.json(str(corpus / "out/reports/collection")).first()
    assert totals.total_lines == X.log_lines(spark, data).count()
    block = lookup.block_logs(spark, str(corpus / "out/block_lookup"), "blk_0")
    assert block.count() == X.events(spark, data).filter("block_id = 'blk_0'").count()


def test_run_reports_detectors_and_explains_alerts(spark, corpus, result):
    report = spark.read.json(str(corpus / "out/reports/parsing")).first()
    top = [(t.event_id, t.occurrence_count) for t in report.most_frequent_templates]
    assert len(top) == 8 and [n for _, n in top] == sorted((n for _, n in top), reverse=True)
    assert bool(report.warnings) == (report.total_lines_failed > 0)
    table = result["reports"].collect()
    assert {(r.model, r.slice) for r in table} == {(m, s) for m in ("isolation_forest", "autoencoder", "fusion", "baseline_forest") for s in ("validation", "test", "holdout")}
    for r in table:
        assert r.tn + r.fp == r.n_normal and r.fn + r.tp == r.n_anomaly and r.run == "run"
        assert r.n_normal + r.n_anomaly + (r.n_training if r.slice == "holdout" else 0) <= 15
    test = {r.model: r for r in table if r.slice == "test"}
    for r in result["evaluation"].collect():
        assert (test[r.model].f1_score, test[r.model].roc_auc) == (r.f1_score, r.roc_auc)
    assert spark.read.json(str(corpus / "out/reports/evaluation_baseline_forest")).count() == 3
    wanted = {r.block_id for r in result["alerts"].filter("fusion_prediction = 'Anomaly'").collect()}
    explained = result["attributions"]
    assert {r.block_id for r in explained.select("block_id").distinct().collect()} == wanted
    gaps = explained.groupBy("block_id", "model").agg(F.abs(F.first("base") + F.sum("phi") - F.first("f_x")).alias("gap"))
    assert gaps.filter("gap > 1e-9").isEmpty() and gaps.count() == 2 * len(wanted)
    if wanted:
        alert = spark.read.json(str(corpus / "out/reports/alerts"))
        assert alert.count() == 2 * len(wanted) and alert.first().waterfall[0].step == "Baseline"


def test_saved_models_score_again_without_fitting(spark, corpus, result):
    models = score.load_models(spark, str(corpus / "out/models"))
    again = score.score_blocks(result["matrix"], models)
    columns = ["block_id", "if_score", "ae_score", "if_calibrated", "ae_calibrated", "fusion_score", "fusion_prediction"]
    fresh = {r[0]: r[1:] for r in result["fused"].select(*columns).collect()}
    for r in again.select(*columns).collect():
        assert r[1:-1] == pytest.approx(fresh[r[0]][:-1], abs=1e-12) and r[-1] == fresh[r[0]][-1]
    assert again.count() == len(fresh)
    severities = {r.block_id: r.severity for r in result["alerts"].collect()}
    assert {r.block_id: r.severity for r in again.collect()} == severities
    few = score.score_blocks(result["matrix"].limit(2).drop("tmpl_E1_count"), models)
    assert few.count() == 2


def test_stream_equals_batch(spark, corpus, result):
    lines = live.stream_lines(spark, str(corpus / "logs"), max_files=1)
    events = live.stream_events(lines, result["dictionary"])
    query = (
        events.select("ts_raw", "level", "component", "block_id", "event_id", "content")
        .writeStream.format("memory").queryName("live_events").trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    streamed = spark.table("live_events")
    wanted = result["events"].select("ts_raw", "level", "component", "block_id", "event_id", "content")
    assert streamed.exceptAll(wanted).isEmpty() and wanted.exceptAll(streamed).isEmpty()


def test_windowed_stream_counts(spark, corpus, result):
    lines = live.stream_lines(spark, str(corpus / "logs"))
    windows = live.windowed_features(live.stream_events(lines, result["dictionary"]), "3650 days")
    query = windows.writeStream.outputMode("complete").format("memory").queryName("live_blocks").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("live_blocks").groupBy("block_id").agg(F.sum("total_log_events").alias("n"))
    timed = result["events"].withColumn("ts", F.try_to_timestamp("ts_raw", F.lit("yyMMddHHmmss"))).filter("ts IS NOT NULL")
    wanted = features.block_rows(timed).groupBy("block_id").agg(F.count(F.lit(1)).alias("n"))
    assert got.exceptAll(wanted).isEmpty() and wanted.exceptAll(got).isEmpty()


@pytest.mark.parametrize("files", [None, 1])
def test_scored_stream_equals_batch(spark, corpus, result, tmp_path, files):
    """Features, scores and severities after all micro-batches are those of the batch run; lines of a block come in any order."""
    models = score.load_models(spark, str(corpus / "out/models"))
    lines = live.stream_lines(spark, str(corpus / "logs"), max_files=files)
    query = live.score_stream(live.stream_events(lines, result["dictionary"]), models, str(tmp_path / "scores"), str(tmp_path / "state"))
    query.awaitTermination(300)
    assert query.exception() is None
    assert len(list((tmp_path / "scores").iterdir())) >= (3 if files else 1)
    got = {r.block_id: r for r in live.latest_scores(spark, str(tmp_path / "scores")).collect()}
    alerts = {r.block_id: r for r in result["alerts"].collect()}
    assert got.keys() == alerts.keys()
    for block, r in got.items():
        a = alerts[block]
        assert (r.severity, r.fusion_prediction, r.total_log_events, r.time_duration_seconds) == (a.severity, a.fusion_prediction, a.total_log_events, a.time_duration_seconds)
        assert r.fusion_score == pytest.approx(a.fusion_score, abs=1e-9)


def test_stream_features_are_exact(spark, corpus, result, tmp_path):
    lines = live.stream_lines(spark, str(corpus / "logs"), max_files=1)
    updates = live.block_features(live.stream_events(lines, result["dictionary"]))
    query = updates.writeStream.outputMode("update").format("memory").queryName("live_features").trigger(availableNow=True).start()
    query.awaitTermination(300)
    ranked = Window.partitionBy("block_id").orderBy(F.desc("total_log_events"))  # counts only grow
    last = spark.table("live_features").withColumn("_r", F.row_number().over(ranked)).filter("_r = 1").drop("_r")
    columns = features.feature_columns(result["matrix"])
    got = {r.block_id: r.asDict() for r in live.as_matrix(last, columns).collect()}
    for r in result["matrix"].collect():
        assert {c: got[r.block_id][c] for c in columns} == pytest.approx({c: r[c] for c in columns})


def test_dictionary_of_a_run_can_be_resumed(spark, corpus, result):
    parsed = result["events"].select("line_id", "content")
    again = templates.mine_templates(parsed, result["dictionary"])
    before = {(r.event_id, r.template) for r in result["dictionary"].collect()}
    assert {(r.event_id, r.template) for r in again.dictionary.collect()} == before
