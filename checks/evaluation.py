"""Checks of evaluation metrics and curves."""

from pyspark.sql import functions as F

from blocklens import config as C
from blocklens.functions.scoring import decide, encode_label
from blocklens.functions.scale import checkpointed
from blocklens.operators import calibration, fusion, metrics, reports, splits
from blocklens.sources import labels
from checks import detectors as E
from checks import fixtures as X
from checks.registry import check, cte, shared
from checks.sources_and_lines import folder


@check("f1_unmatched", """
SELECT count(*) AS unmatched FROM order_scores ANTI JOIN score_pairs USING (block_id)""")
def f1(spark, sf_dir):
    return metrics.unmatched(E.order_scores(spark, sf_dir), X.pairs(spark, sf_dir))


@check("f1_joined", "SELECT block_id, ae_raw, label FROM order_scores JOIN score_pairs USING (block_id)")
def f1_joined(spark, sf_dir):
    return metrics.join_labels(E.order_scores(spark, sf_dir), X.pairs(spark, sf_dir))


@check("f2_unknown_labels", "SELECT label, count(*) AS n FROM dirty_labels WHERE label NOT IN ('Normal', 'Anomaly') GROUP BY label")
def f2(spark, sf_dir):
    return labels.unexpected_labels(labels.clean_labels(X.dirty_labels(spark, sf_dir)))


_COUNTS = """
SELECT {by} count(*) FILTER (WHERE label = 'Normal' AND fusion_prediction = 'Normal') AS tn,
       count(*) FILTER (WHERE label = 'Normal' AND fusion_prediction = 'Anomaly') AS fp,
       count(*) FILTER (WHERE label = 'Anomaly' AND fusion_prediction = 'Normal') AS fn,
       count(*) FILTER (WHERE label = 'Anomaly' AND fusion_prediction = 'Anomaly') AS tp FROM {source} {group}"""
_RATES = """
SELECT *, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1_score,
       round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS false_positive_rate FROM ({counts})"""
_ALL = _COUNTS.format(by="", source="fused_pairs", group="")


def counts(spark, sf_dir):
    return metrics.confusion(X.fused_pairs(spark, sf_dir), prediction="fusion_prediction")


@check("f3_confusion", _ALL)
def f3(spark, sf_dir):
    return counts(spark, sf_dir)


@check("f4_metrics", "SELECT tn, fp, fn, tp, accuracy, precision, recall, f1_score FROM (" + _RATES.format(counts=_ALL) + ")")
def f4(spark, sf_dir):
    return metrics.rates(counts(spark, sf_dir)).drop("false_positive_rate")


@check("f5_roc_auc", """
SELECT model, round(sum(pos * (total_neg - fp + 0.5 * neg)) / any_value(total_pos * total_neg), 6) AS roc_auc FROM score_curve GROUP BY model""")
def f5(spark, sf_dir):
    return metrics.areas(E.curve(spark, sf_dir), ["model"]).select("model", "roc_auc")


@check("f6_average_precision", "SELECT model, round(sum((pos / total_pos) * (tp / (tp + fp))), 6) AS pr_auc FROM score_curve GROUP BY model")
def f6(spark, sf_dir):
    return metrics.areas(E.curve(spark, sf_dir), ["model"]).select("model", "pr_auc")


@check("f7_pr_curve", "SELECT model, round(score, 9) AS threshold, round(precision, 9) AS precision, round(recall, 9) AS recall FROM rated_curve")
def f7(spark, sf_dir):
    rows = metrics.pr_curve(E.curve(spark, sf_dir), ["model"])
    return rows.select("model", *[F.round(c, 9).alias(c) for c in ("threshold", "precision", "recall")])


_K = "SELECT unnest([50, 100, 500, 1000, 2000, 5000]) AS k"


@check("f8_precision_at_k", f"""
SELECT CAST(k AS BIGINT) AS k, CAST(least(k, n) AS BIGINT) AS k_used, hits, round(hits / least(k, n), 6) AS precision_at_k,
       round(hits / greatest(n_pos, 1), 6) AS recall_at_k
FROM (SELECT k, count(*) FILTER (WHERE label = 'Anomaly') AS hits FROM ({_K}),
        (SELECT label, row_number() OVER (ORDER BY fusion_score DESC, block_id) AS r FROM fused_pairs) WHERE r <= k GROUP BY k),
     (SELECT count(*) AS n, count(*) FILTER (WHERE label = 'Anomaly') AS n_pos FROM fused_pairs)""")
def f8(spark, sf_dir):
    return metrics.precision_at(X.fused_pairs(spark, sf_dir), "fusion_score")


cte("slices", "SELECT f.*, split FROM fused_pairs f JOIN (SELECT block_id, split FROM pair_splits) USING (block_id)")
cte("validation_best", """
SELECT score AS threshold FROM (
  SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS total_pos
  FROM (SELECT fusion_score AS score, count(*) FILTER (WHERE label = 'Anomaly') AS pos, count(*) FILTER (WHERE label = 'Normal') AS neg
        FROM slices WHERE split = 'validation' GROUP BY fusion_score) WINDOW w AS (ORDER BY score DESC))
ORDER BY CAST(2 * tp AS DOUBLE) / (2 * tp + (total_pos - tp) + fp) DESC, score LIMIT 1""")
_RECALIBRATED = """(SELECT label, threshold, CASE WHEN fusion_score >= threshold THEN 'Anomaly' ELSE 'Normal' END AS fusion_prediction
                    FROM slices, validation_best WHERE split = 'test')"""


def sliced(spark, sf_dir):
    return X.fused_pairs(spark, sf_dir).join(X.pair_splits(spark, sf_dir).select("block_id", "split"), "block_id")


@check("f9_calibrated_metrics", _RATES.format(
    counts=_COUNTS.format(by="round(threshold, 9) AS threshold,", source=_RECALIBRATED, group="GROUP BY threshold")))
def f9(spark, sf_dir):
    rows = sliced(spark, sf_dir)
    table = metrics.calibrated_metrics(rows.filter("split = 'test'"), rows.filter("split = 'validation'"), "fusion_score")
    return table.withColumn("threshold", F.round("threshold", 9))


@check("f10_population", "SELECT split, label, count(*) AS n_blocks FROM pair_splits GROUP BY split, label")
def f10(spark, sf_dir):
    return splits.population(X.pair_splits(spark, sf_dir))


@check("f10_population_report", """
SELECT count(*) AS total_blocks, count(*) FILTER (WHERE split = 'train') AS training_excluded,
       count(*) FILTER (WHERE split = 'validation') AS validation_excluded, count(*) FILTER (WHERE split = 'test') AS evaluated_blocks,
       count(*) FILTER (WHERE split = 'test' AND label = 'Normal') AS evaluated_normal,
       count(*) FILTER (WHERE split = 'test' AND label = 'Anomaly') AS evaluated_anomaly FROM slices""")
def f10_report(spark, sf_dir):
    return splits.population_report(X.fused_pairs(spark, sf_dir), X.pair_splits(spark, sf_dir))


@check("f11_fpr", "SELECT false_positive_rate FROM (" + _RATES.format(counts=_ALL) + ")")
def f11(spark, sf_dir):
    return metrics.rates(counts(spark, sf_dir)).select("false_positive_rate")


_BY_MODEL = _COUNTS.format(by="model,", source="(SELECT s.*, fusion_prediction FROM stacked s JOIN (SELECT block_id, fusion_prediction FROM fused_pairs) USING (block_id))", group="GROUP BY model")


@check("f12_ablation", f"""
SELECT r.*, round(m.roc_auc, 6) AS roc_auc, round(m.pr_auc, 6) AS pr_auc, 'all' AS slice
FROM ({_RATES.format(counts=_BY_MODEL)}) r JOIN model_metrics m ON r.model = m.model""")
def f12(spark, sf_dir):
    return metrics.ablation(X.fused_pairs(spark, sf_dir), E.MODELS, part="all").drop("warning")


cte("calibrated_test", f"""
SELECT s.label, c.calibrated AS score, CASE WHEN c.calibrated >= 0.5 THEN 'Anomaly' ELSE 'Normal' END AS fusion_prediction
FROM slices s JOIN ({E.CALIBRATED}) c USING (block_id) WHERE split = 'test'""")
cte("calibrated_curve", """
SELECT pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS total_pos, sum(neg) OVER () AS total_neg
FROM (SELECT score, count(*) FILTER (WHERE label = 'Anomaly') AS pos, count(*) FILTER (WHERE label = 'Normal') AS neg
      FROM calibrated_test GROUP BY score) WINDOW w AS (ORDER BY score DESC)""")


@check("f13_calibrated_view", f"""
SELECT *, 'test' AS slice FROM ({_RATES.format(counts=_COUNTS.format(by="", source="calibrated_test", group=""))}),
  (SELECT round(sum(pos * (total_neg - fp + 0.5 * neg)) / any_value(total_pos * total_neg), 6) AS roc_auc,
          round(sum((pos / total_pos) * (tp / (tp + fp))), 6) AS pr_auc FROM calibrated_curve)""")
def f13(spark, sf_dir):
    """Decision at a calibrated score of one half, on the test slice."""
    test = sliced(spark, sf_dir).filter("split = 'test'")
    scored = calibration.calibrate(test, E.isotonic(spark, sf_dir), "if_score", "score")
    scored = scored.withColumn("score", F.round("score", 6))
    return metrics.evaluate(scored.withColumn("prediction", decide(F.col("score"), C.CALIBRATED_CUTOFF))).drop("warning")


@check("f14_roc_curve", "SELECT model, round(score, 9) AS threshold, round(fp / total_neg, 9) AS fpr, round(tp / total_pos, 9) AS tpr FROM score_curve")
def f14(spark, sf_dir):
    rows = metrics.roc_curve(E.curve(spark, sf_dir), ["model"])
    return rows.select("model", *[F.round(c, 9).alias(c) for c in ("threshold", "fpr", "tpr")])


@check("f14_weight_curve", """
SELECT if_weight, round(tp / total_pos, 6) AS recall, round(2 * tp / (2 * tp + (total_pos - tp) + fp), 6) AS f_beta FROM grid_curve
QUALIFY row_number() OVER (PARTITION BY if_weight ORDER BY 2 * tp / (2 * tp + (total_pos - tp) + fp) DESC, score) = 1""")
def f14_weights(spark, sf_dir):
    return fusion.grid_search(X.pairs(spark, sf_dir)).select("if_weight", "recall", "f_beta")


@check("f15_label_encoding", "SELECT block_id, CASE label WHEN 'Anomaly' THEN 1 ELSE 0 END AS y FROM score_pairs")
def f15(spark, sf_dir):
    return X.pairs(spark, sf_dir).select("block_id", encode_label(F.col("label")).alias("y"))


_SCALE = " UNION ALL ".join(f"""
SELECT '{c}' AS model, count({c}) AS n, min({c}) AS lo, max({c}) AS hi, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
       round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.9), 6) AS p90, round(quantile_cont({c}, 0.99), 6) AS p99,
       round(avg(power({c} - m, 3)) / power(avg(power({c} - m, 2)), 1.5), 6) AS skewness
FROM score_pairs, (SELECT avg({c}) AS m FROM score_pairs)""" for c in ("if_score", "ae_score"))


@check("f16_score_scale", _SCALE)
def f16(spark, sf_dir):
    rows = metrics.score_scale(X.pairs(spark, sf_dir), ["if_score", "ae_score"])
    return rows.select("model", "n", "lo", "hi", *[F.round(c, 6).alias(c) for c in ("mean", "std", "skewness", "p50", "p90", "p99")])


# Evaluation reports: two detectors on three slices.
cte("report_rows", """
SELECT block_id, label, 'isolation_forest' AS model, if_score AS score, CASE WHEN if_score >= 0.5 THEN 'Anomaly' ELSE 'Normal' END AS prediction, split
FROM score_pairs JOIN (SELECT block_id, split FROM pair_splits) USING (block_id)
UNION ALL SELECT block_id, label, 'autoencoder', ae_score, CASE WHEN ae_score > 0.7 THEN 'Anomaly' ELSE 'Normal' END, split
FROM score_pairs JOIN (SELECT block_id, split FROM pair_splits) USING (block_id)""")
cte("report_slices", """
SELECT *, split AS slice FROM report_rows WHERE split <> 'train' UNION ALL SELECT *, 'holdout' FROM report_rows WHERE split <> 'train'""")
cte("report_curve", """
SELECT model, slice, score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model, slice) AS total_pos, sum(neg) OVER (PARTITION BY model, slice) AS total_neg
FROM (SELECT model, slice, score, count(*) FILTER (WHERE label = 'Anomaly') AS pos, count(*) FILTER (WHERE label = 'Normal') AS neg FROM report_slices GROUP BY ALL)
WINDOW w AS (PARTITION BY model, slice ORDER BY score DESC)""")
cte("report_areas", """
SELECT model, slice, round(sum(pos * (total_neg - fp + 0.5 * neg)) / any_value(total_pos * total_neg), 6) AS roc_auc,
       round(sum(pos / total_pos * (tp / (tp + fp))), 6) AS pr_auc FROM report_curve GROUP BY model, slice""")
cte("report_best", """
SELECT model, score AS threshold FROM report_curve WHERE slice = 'validation'
QUALIFY row_number() OVER (PARTITION BY model ORDER BY CAST(2 * tp AS DOUBLE) / (2 * tp + (total_pos - tp) + fp) DESC, score) = 1""")


def _report_counts(prefix: str, predicted: str) -> str:
    hit = f"({predicted})"
    tn, fp, fn, tp = (f"count(*) FILTER (WHERE {'NOT ' * (p == 0)}{hit} AND label = '{y}')" for y, p in (("Normal", 0), ("Normal", 1), ("Anomaly", 0), ("Anomaly", 1)))
    ratio = lambda a, b: f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0)"
    values = {"tn": tn, "fp": fp, "fn": fn, "tp": tp, "accuracy": f"round({ratio(f'({tp} + {tn})', 'count(*)')}, 6)", "precision": f"round({ratio(tp, f'({tp} + {fp})')}, 6)",
              "recall": f"round({ratio(tp, f'({tp} + {fn})')}, 6)", "f1_score": f"round({ratio(f'2 * {tp}', f'(2 * {tp} + {fp} + {fn})')}, 6)", "false_positive_rate": f"round({ratio(fp, f'({fp} + {tn})')}, 6)"}
    return ", ".join(f"{v} AS {prefix}{k}" for k, v in values.items())


cte("report_table", f"""
SELECT model, slice, (SELECT count(*) FROM report_rows r WHERE split = 'train' AND r.model = s.model) AS n_training,
  count(*) FILTER (WHERE label = 'Normal') AS n_normal, count(*) FILTER (WHERE label = 'Anomaly') AS n_anomaly,
  {_report_counts("", "prediction = 'Anomaly'")}, any_value(threshold) AS threshold, {_report_counts("calibrated_", "score >= threshold")}
FROM report_slices s JOIN report_best USING (model) GROUP BY model, slice""")


@shared
def report(spark, sf_dir):
    rows = X.pairs(spark, sf_dir).join(X.pair_splits(spark, sf_dir).select("block_id", "split"), "block_id")
    rows = checkpointed(rows.withColumns({"if_p": decide(F.col("if_score"), 0.5), "ae_p": decide(F.col("ae_score"), 0.7, strict=True)}))
    tables = [reports.evaluation_report(rows, name, s, p, ks=(50, 1000)) for name, s, p in (("isolation_forest", "if_score", "if_p"), ("autoencoder", "ae_score", "ae_p"))]
    return checkpointed(tables[0].unionByName(tables[1]))


@check("a13_evaluation_report", """
SELECT t.*, a.roc_auc, a.pr_auc, k.hits AS hits_at_50, k.p AS precision_at_50 FROM report_table t JOIN report_areas a USING (model, slice) JOIN (
  SELECT model, slice, count(*) FILTER (WHERE label = 'Anomaly') AS hits, round(count(*) FILTER (WHERE label = 'Anomaly') / CAST(count(*) AS DOUBLE), 6) AS p FROM (
    SELECT *, row_number() OVER (PARTITION BY model, slice ORDER BY score DESC, block_id) AS r FROM report_slices) WHERE r <= 50 GROUP BY model, slice) k USING (model, slice)""")
def a13_evaluation(spark, sf_dir):
    """The evaluation reports of two detectors, stored as a history of runs and read again."""
    path = folder(spark, "report-history")
    reports.add_to_history(report(spark, sf_dir), path, "one")
    at = F.col("precision_at")[0]
    found = reports.read_history(spark, path).withColumns({"hits_at_50": at["hits"], "precision_at_50": at["precision"]})
    return found.drop("run", "precision_at", "warnings")


@check("a13_run_comparison", """
SELECT 'detector' AS model, slice, round(b.f1_score - a.f1_score, 6) AS f1_score_delta, round(y.roc_auc - x.roc_auc, 6) AS roc_auc_delta,
       round(y.pr_auc - x.pr_auc, 6) AS pr_auc_delta, round(b.calibrated_f1_score - a.calibrated_f1_score, 6) AS calibrated_f1_score_delta
FROM report_table a JOIN report_areas x USING (model, slice) JOIN report_table b USING (slice) JOIN report_areas y ON y.model = b.model AND y.slice = b.slice
WHERE a.model = 'isolation_forest' AND b.model = 'autoencoder'""")
def a13_comparison(spark, sf_dir):
    """The detector of one run against that of the next, by slice."""
    path, table = folder(spark, "report-runs"), report(spark, sf_dir)
    for run, model in (("2024-01", "isolation_forest"), ("2024-02", "autoencoder")):
        reports.add_to_history(table.filter(F.col("model") == model).withColumn("model", F.lit("detector")), path, run)
    found = reports.compare_runs(reports.read_history(spark, path), "2024-01", "2024-02")
    return found.select("model", "slice", "f1_score_delta", "roc_auc_delta", "pr_auc_delta", "calibrated_f1_score_delta")
