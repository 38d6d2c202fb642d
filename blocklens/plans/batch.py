"""The whole analysis as one batch: lines to templates, features, scores, fusion, evaluation.

Stages are tables in ``out``; each reads what earlier ones wrote, so a lost executor or a
restart never repeats more than one stage.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blocklens import config as C
from blocklens.functions.scoring import decide, normalise_with, score_bounds
from blocklens.operators import (
    attribution,
    autoencoder,
    calibration,
    features,
    fusion,
    iforest,
    lines,
    metrics,
    reports,
    selection,
    splits,
    templates,
    triage,
)
from blocklens.session import ship_package
from blocklens.sources import labels as label_source
from blocklens.sources import logs, lookup, sinks


def _stored(df: DataFrame, path: str) -> DataFrame:
    sinks.write_table(df, path)
    return df.sparkSession.read.parquet(path)


def collect_quality(raw: DataFrame, out: str) -> None:
    """Per-file statistics, samples and warnings, and the totals."""
    stats = logs.file_stats(raw).cache()
    order = F.struct("path", "split_start", F.monotonically_increasing_id())
    samples = logs.sample_lines(raw.withColumn("_at", order), "_at")
    sinks.write_table(logs.file_report(stats, samples), f"{out}/reports/files", "json")
    sinks.write_report(logs.collection_totals(stats), f"{out}/reports/collection")
    stats.unpersist()


def parse(raw: DataFrame, out: str, dictionary: DataFrame | None = None):
    """Parsed, template-labelled lines, the dictionary and the block lookup."""
    spark = raw.sparkSession
    numbered = _stored(logs.number_file_lines(raw).select("line_id", "file_name", "raw_line"), f"{out}/lines")
    # Headers, masks and signatures are worked out once; mining, assignment and report read them.
    parsed = _stored(templates.with_signature(lines.parse_headers(numbered)), f"{out}/lines_parsed")
    mined = templates.mine_templates(parsed, dictionary)
    events = templates.assign_events(parsed, mined)
    sinks.write_parsed(events, f"{out}/parsed_logs")
    found = _stored(mined.dictionary, f"{out}/models/dictionary")
    events = spark.read.parquet(f"{out}/parsed_logs")
    report = lines.parse_report(numbered, found, parsed)
    sinks.write_report(lines.full_parse_report(report, templates.top_templates(events, found)), f"{out}/reports/parsing")
    lookup.write_lookup(events, f"{out}/block_lookup")
    return events, found


def extract(events: DataFrame, dictionary: DataFrame, out: str) -> DataFrame:
    """Raw feature matrix with missing values filled, its global scaler and the report."""
    ids = [r.event_id for r in dictionary.select("event_id").collect()]
    source = events.select(*sinks.FEATURE_INPUT)
    raw = _stored(features.feature_matrix(source, ids), f"{out}/features_raw")
    sinks.write_report(features.feature_report(source, raw), f"{out}/reports/features")
    matrix = _stored(features.fill_missing(raw), f"{out}/features")
    sinks.write_table(features.fit_min_max(matrix), f"{out}/models/scaler")
    return matrix


def score_isolation(matrix: DataFrame, parts: DataFrame, out: str, **settings) -> DataFrame:
    """Isolation scores 0-1, calibrated scores and decisions; everything fitted on training
    or validation blocks only."""
    labelled = matrix.join(parts, "block_id")
    train = labelled.filter(F.col("split") == "train")
    columns = selection.selected_features(train, features.feature_columns(matrix))
    scaler = features.fit_min_max(train, columns)
    scaled = features.scale_min_max(matrix, scaler, columns).select("block_id", *columns)
    in_train = parts.filter(F.col("split") == "train").select("block_id")
    model = iforest.fit_forest(scaled.join(in_train, "block_id", "left_semi"), columns, **settings)
    raw = _stored(iforest.score_forest(scaled, model).select("block_id", "raw_score"), f"{out}/if_raw")
    bounds = score_bounds(raw.join(in_train, "block_id", "left_semi"), "raw_score")
    scored = normalise_with(raw, bounds, "raw_score", "if_score")
    validation = scored.join(parts.filter(F.col("split") == "validation"), "block_id")
    calibrator = calibration.fit_isotonic(validation, "if_score")
    best = metrics.best_threshold(metrics.score_curve(validation, "if_score"))
    threshold = best.first().threshold
    scored = calibration.calibrate(scored, calibrator, "if_score", "if_calibrated")
    sinks.save_model({**model.tables(), "forest_scaler": scaler, "forest_threshold": best, "forest_bounds": bounds},
                     f"{out}/models", {"forest_calibrator": calibrator})
    return _stored(scored.withColumn("if_prediction", decide(F.col("if_score"), threshold)), f"{out}/if_predictions")


def score_reconstruction(matrix: DataFrame, parts: DataFrame, out: str, fit_on: str = "train", **settings) -> DataFrame:
    """Autoencoder errors, 0-1 scores and decisions.

    ``fit_on="all"`` scales inputs and scores over all blocks as published; the default uses
    training blocks only.
    """
    columns = features.feature_columns(matrix)
    in_train = parts.filter(F.col("split") == "train").select("block_id")
    basis = matrix if fit_on == "all" else matrix.join(in_train, "block_id", "left_semi")
    scaler = features.fit_min_max(basis, columns)
    scaled = _stored(features.scale_min_max(matrix, scaler, columns), f"{out}/features_scaled")
    train = scaled.join(in_train, "block_id", "left_semi")
    model = autoencoder.fit_autoencoder(train, columns, **settings)
    reference = autoencoder.reconstruction_error(scaled if fit_on == "all" else train, model)
    bounds = score_bounds(reference, "reconstruction_error")
    sinks.save_model({**model.tables(matrix.sparkSession), "ae_scaler": scaler, "ae_bounds": bounds}, f"{out}/models")
    bounds = matrix.sparkSession.read.parquet(f"{out}/models/ae_bounds")
    return _stored(autoencoder.score_autoencoder(scaled, model, bounds), f"{out}/ae_predictions")


def score_baseline(matrix: DataFrame, parts: DataFrame, out: str, **settings) -> DataFrame:
    """The plain forest: all features as scaled for the autoencoder, its own cut-off."""
    columns = features.feature_columns(matrix)
    scaled = matrix.sparkSession.read.parquet(f"{out}/features_scaled")
    in_train = parts.filter(F.col("split") == "train").select("block_id")
    model = iforest.fit_forest(scaled.join(in_train, "block_id", "left_semi"), columns, **settings)
    sinks.save_model({f"baseline_{k}": t for k, t in model.tables().items()}, f"{out}/models")
    scored = iforest.score_forest(scaled, model).select("block_id", "raw_score")
    return _stored(scored.withColumn("baseline_prediction", iforest.forest_label()), f"{out}/baseline_predictions")


def report_detectors(isolation, reconstruction, fused, baseline, parts: DataFrame, out: str, history: str, run: str) -> DataFrame:
    """Evaluation reports of all detectors on the untouched slices: JSON of this run, and a place in the history."""
    tables = [("isolation_forest", isolation, "if_score", "if_prediction"), ("autoencoder", reconstruction, "ae_score", "ae_prediction"),
              ("fusion", fused, "fusion_score", "fusion_prediction"), ("baseline_forest", baseline, "raw_score", "baseline_prediction")]
    for name, table, score, prediction in tables:
        rows = table.select("block_id", score, prediction).join(parts.select("block_id", "label", "split"), "block_id")
        report = _stored(reports.evaluation_report(rows, name, score, prediction), f"{out}/reports/tables/{name}")
        sinks.write_table(report, f"{out}/reports/evaluation_{name}", "json")
        reports.add_to_history(report, history, run)
    return reports.read_history(parts.sparkSession, history)


def explain(alerts: DataFrame, matrix: DataFrame, dictionary: DataFrame, out: str) -> DataFrame:
    """Why every block that is predicted anomalous is one: contributions to both scores and a row of findings per block."""
    spark = matrix.sparkSession
    tables = sinks.load_tables(spark, f"{out}/models", ["forest_nodes", "forest_meta", "forest_scaler", "ae_layers", "ae_meta", "ae_history"])
    forest, network = iforest.Forest.from_tables(tables), autoencoder.Autoencoder.from_tables(tables)
    chosen = alerts.filter(F.col("fusion_prediction") == C.ANOMALY).select("block_id")
    local = features.scale_min_max(matrix, tables["forest_scaler"], forest.columns)
    scaled = spark.read.parquet(f"{out}/features_scaled")
    pick = lambda rows: rows.join(chosen, "block_id", "left_semi")
    found = attribution.attribute_autoencoder(pick(scaled), attribution.background(scaled), network)
    found = found.unionByName(attribution.attribute_forest(pick(local), attribution.background(local), forest, n_coalitions=C.AE_COALITIONS))
    found = _stored(found, f"{out}/attributions")
    steps = F.array_sort(F.collect_list(F.struct("position", "step", F.round("amount", 6).alias("amount")))).alias("waterfall")
    story = attribution.waterfall(found).groupBy("block_id", "model").agg(steps)
    top = attribution.top_positive(attribution.labelled(found, dictionary)).select("block_id", "model", F.col("feature").alias("strongest"), F.round("phi", 6).alias("strongest_phi"))
    sinks.write_table(story.join(top, ["block_id", "model"]), f"{out}/reports/alerts", "json")
    return found


def combine(isolation: DataFrame, reconstruction: DataFrame, parts: DataFrame, out: str) -> DataFrame:
    """Calibrated, fused scores and decisions for every block."""
    joined = fusion.join_scores(
        isolation.select("block_id", "if_score"), reconstruction.select("block_id", "ae_score")
    )
    model = fusion.fit_fusion(joined, parts)
    sinks.save_model(model.tables(joined.sparkSession), f"{out}/models", {"fusion_if": model.if_calibrator, "fusion_ae": model.ae_calibrator})
    fused = _stored(fusion.apply_fusion(joined, model), f"{out}/fused")
    sinks.write_report(fusion.run_summary(fused, parts), f"{out}/reports/fusion")
    return fused


def evaluate(fused: DataFrame, isolation: DataFrame, reconstruction: DataFrame, parts: DataFrame, out: str) -> DataFrame:
    """All three detectors on the untouched test slice."""
    test = parts.filter(F.col("split") == "test").select("block_id", "label")
    scored = (
        fused.select("block_id", "fusion_score", "fusion_prediction")
        .join(isolation.select("block_id", "if_score", "if_prediction"), "block_id")
        .join(reconstruction.select("block_id", "ae_score", "ae_prediction"), "block_id")
    )
    table = metrics.ablation(
        metrics.join_labels(scored, test),
        {
            "autoencoder": ("ae_score", "ae_prediction"),
            "isolation_forest": ("if_score", "if_prediction"),
            "fusion": ("fusion_score", "fusion_prediction"),
        },
    )
    return _stored(table, f"{out}/evaluation")


def run(spark: SparkSession, log_path: str, label_path: str, out: str, forest=None, network=None, baseline=None,
        history: str | None = None, name: str = "run") -> dict:
    """Run everything; returns the main tables. ``forest``, ``network`` and ``baseline`` override model settings.

    Evaluation reports go to ``out``/reports and, as run ``name``, to the table ``history``
    (by default below ``out``), in which runs can be compared.
    """
    ship_package(spark)
    raw = logs.read_lines(spark, log_path)
    collect_quality(raw, out)
    events, dictionary = parse(raw, out)
    matrix = extract(events, dictionary, out)
    labels = label_source.require_known_labels(label_source.read_labels(spark, label_path))
    parts = splits.assign_splits(matrix.select("block_id").join(labels, "block_id"))
    parts = _stored(splits.require_no_leakage(parts), f"{out}/splits")
    isolation = score_isolation(matrix, parts, out, **(forest or C.FOREST))
    reconstruction = score_reconstruction(matrix, parts, out, **(network or {}))
    plain = score_baseline(matrix, parts, out, **(baseline or C.BASELINE_FOREST))
    fused = combine(isolation, reconstruction, parts, out)
    evaluation = evaluate(fused, isolation, reconstruction, parts, out)
    reported = report_detectors(isolation, reconstruction, fused, plain, parts, out, history or f"{out}/reports/history", name)
    alerts = triage.with_severity(triage.master_table(fused, labels, matrix))
    alerts = _stored(alerts, f"{out}/alerts")
    attributions = explain(alerts, matrix, dictionary, out)
    return {"events": events, "dictionary": dictionary, "matrix": matrix, "splits": parts, "fused": fused, "evaluation": evaluation,
            "reports": reported, "alerts": alerts, "attributions": attributions}
