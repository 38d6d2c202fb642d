"""Checks of detectors, calibration and fusion."""

import numpy as np
from pyspark.sql import functions as F

from blocklens import config as C
from blocklens.functions.scale import percentiles
from blocklens.functions.scoring import decide, normalise_all, normalise_by, normalise_with, score_bounds
from blocklens.operators import autoencoder, calibration, features, fusion, iforest, metrics, selection
from blocklens.plans import score
from blocklens.sources import sinks
from checks import features_and_splits as D
from checks import fixtures as X
from checks.registry import check, cte, shared
from checks.sources_and_lines import folder

TREES = C.FOREST["n_trees"]


@shared
def selected(spark, sf_dir):
    return selection.selected_features(D.training_matrix(spark, sf_dir), X.FEATURES)


@shared
def local_scaled(spark, sf_dir):
    """Selected features scaled by the training rows."""
    columns = selected(spark, sf_dir)
    scaler = features.fit_min_max(D.training_matrix(spark, sf_dir), columns)
    return features.scale_min_max(X.matrix(spark, sf_dir), scaler, columns).select("block_id", *columns)


@shared
def global_scaled(spark, sf_dir):
    rows = X.matrix(spark, sf_dir)
    return features.scale_min_max(rows, features.fit_min_max(rows), X.FEATURES)


def training(rows, spark, sf_dir):
    return rows.join(X.log_splits(spark, sf_dir).filter("split = 'train'").select("block_id"), "block_id", "left_semi")


@shared
def forest(spark, sf_dir):
    rows = training(local_scaled(spark, sf_dir), spark, sf_dir)
    return iforest.fit_forest(rows, selected(spark, sf_dir), n_trees=TREES)


@shared
def baseline_forest(spark, sf_dir):
    rows = training(global_scaled(spark, sf_dir), spark, sf_dir)
    return iforest.fit_forest(rows, X.FEATURES, n_trees=TREES, max_samples=C.BASELINE_FOREST["max_samples"])


@shared
def autoencoder_model(spark, sf_dir):
    return autoencoder.fit_autoencoder(training(global_scaled(spark, sf_dir), spark, sf_dir), X.FEATURES)


@check("e1_iforest_nodes")
def e1(spark, sf_dir):
    return forest(spark, sf_dir).nodes


@check("e2_iforest_baseline")
def e2(spark, sf_dir):
    return baseline_forest(spark, sf_dir).nodes


# Rows of a tree's sample: the first 52 bits of md5(block|tree|seed) below psi / rows.
_SAMPLES = """
SELECT tree, count(*) AS n, true AS leaves_add_up FROM train_matrix, (SELECT unnest(range({trees})) AS tree), (SELECT count(*) AS total FROM train_matrix)
WHERE '0' || md5(block_id || '|' || tree || '|42')[1:13] < format('{{:014x}}', floor({psi} / total * 4503599627370496)::BIGINT) GROUP BY tree"""


def sample_sizes(model):
    """Per tree the rows at its root, and whether its leaves hold as many."""
    at_root = F.max(F.when(F.col("node") == 1, F.col("n")))
    in_leaves = F.sum(F.when(F.col("feature") < 0, F.col("n")))
    rows = model.nodes.groupBy(F.col("tree").cast("long").alias("tree")).agg(at_root.alias("n"), (at_root == in_leaves).alias("leaves_add_up"))
    return rows


@check("e1_iforest_samples", _SAMPLES.format(trees=TREES, psi="greatest(1, floor(0.5 * total))"))
def e1_samples(spark, sf_dir):
    return sample_sizes(forest(spark, sf_dir))


@check("e2_baseline_samples", _SAMPLES.format(trees=TREES, psi="least(total, 256)" if C.BASELINE_FOREST["max_samples"] == 256 else "greatest(1, floor(0.5 * total))"))
def e2_samples(spark, sf_dir):
    return sample_sizes(baseline_forest(spark, sf_dir))


GIVEN_NODES = [(0, 1, 0, 600.0, 8), (0, 2, -1, None, 6), (0, 3, 1, 60.0, 2), (0, 6, -1, None, 1), (0, 7, -1, None, 1),
               (1, 1, 1, 55.0, 8), (1, 2, -1, None, 3), (1, 3, -1, None, 5)]
_PATH = lambda n: f"(2 * (ln({n} - 1) + 0.5772156649015329) - 2 * ({n} - 1) / {n})"
_GIVEN = f"""
SELECT block_id, 2 ** (-((CASE WHEN total_log_events <= 600 THEN 1 + {_PATH("6.0")} ELSE 2 END)
  + (CASE WHEN error_count <= 55 THEN 1 + {_PATH("3.0")} ELSE 1 + {_PATH("5.0")} END)) / 2 / {_PATH("8.0")}) - 0.5 AS raw FROM block_matrix"""


def given_scores(spark, sf_dir):
    """Two trees given by hand, walked over every block."""
    columns = ["total_log_events", "error_count"]
    model = iforest.Forest(spark.createDataFrame(GIVEN_NODES, iforest.NODE_SCHEMA), 8, columns)
    return iforest.score_forest(X.matrix(spark, sf_dir).select("block_id", *columns), model)


@check("e3_given_forest", f"SELECT block_id, round(raw, 9) AS raw_score FROM ({_GIVEN})")
def e3_given(spark, sf_dir):
    return given_scores(spark, sf_dir).select("block_id", F.round("raw_score", 9).alias("raw_score"))


@check("e4_given_label", f"SELECT block_id, CASE WHEN raw > 0 THEN 'Anomaly' ELSE 'Normal' END AS prediction FROM ({_GIVEN})")
def e4_given(spark, sf_dir):
    return given_scores(spark, sf_dir).select("block_id", iforest.forest_label().alias("prediction"))


@check("a14_scored_again", "SELECT count(*) AS n_blocks, 0::BIGINT AS n_differ FROM block_matrix")
def a14(spark, sf_dir):
    """Models, bounds, calibrators, weights and threshold stored, loaded and applied: the fresh scores again."""
    path = folder(spark, "models")
    trees, network = forest(spark, sf_dir), autoencoder_model(spark, sf_dir)
    raw = iforest.score_forest(local_scaled(spark, sf_dir), trees).select("block_id", "raw_score")
    errors = autoencoder.reconstruction_error(global_scaled(spark, sf_dir), network)
    bounds = {
        "forest_bounds": score_bounds(training(raw, spark, sf_dir), "raw_score"),
        "ae_bounds": score_bounds(training(errors, spark, sf_dir), "reconstruction_error"),
    }
    isolation = normalise_with(raw, bounds["forest_bounds"], "raw_score", "if_score")
    rebuilt = autoencoder.score_autoencoder(global_scaled(spark, sf_dir), network, bounds["ae_bounds"])
    joined = fusion.join_scores(isolation.select("block_id", "if_score"), rebuilt.select("block_id", "ae_score"))
    model = fusion.fit_fusion(joined, X.log_splits(spark, sf_dir))
    scalers = {
        "forest_scaler": features.fit_min_max(D.training_matrix(spark, sf_dir), selected(spark, sf_dir)),
        "ae_scaler": features.fit_min_max(X.matrix(spark, sf_dir)),
        "forest_threshold": spark.createDataFrame([(0.5,)], "threshold double"),
    }
    tables = {**trees.tables(), **network.tables(spark), **bounds, **scalers, **model.tables(spark)}
    sinks.save_model(tables, path, {"fusion_if": model.if_calibrator, "fusion_ae": model.ae_calibrator})
    again = score.score_blocks(X.matrix(spark, sf_dir), score.load_models(spark, path))
    both = fusion.apply_fusion(joined, model).join(again.select("block_id", F.col("fusion_score").alias("again")), "block_id")
    return both.agg(F.count(F.lit(1)).alias("n_blocks"), F.count_if(F.abs(F.col("fusion_score") - F.col("again")) > 1e-9).alias("n_differ"))


@check("e3_iforest_score")
def e3(spark, sf_dir):
    return iforest.score_forest(local_scaled(spark, sf_dir), forest(spark, sf_dir)).select("block_id", "raw_score")


@check("e3_iforest_vector_score")
def e3_vectors(spark, sf_dir):
    """Forest over all embedding vectors, fitted on the Normal ones."""
    rows = X.vectors(spark, sf_dir)
    columns = [c for c in rows.columns if c.startswith("f")]
    model = iforest.fit_forest(rows.filter(F.col("label") == C.NORMAL), columns, n_trees=TREES, max_samples=256)
    return iforest.score_forest(rows, model).select("block_id", "label", "raw_score")


@check("e4_iforest_label")
def e4(spark, sf_dir):
    scored = iforest.score_forest(global_scaled(spark, sf_dir), baseline_forest(spark, sf_dir))
    return scored.select("block_id", "raw_score", iforest.forest_label().alias("prediction"))


@check("e5_normalize_ref", """
SELECT block_id, round(least(greatest((ae_score - lo) / (hi - lo), 0.0), 1.0), 9) AS score FROM score_pairs,
  (SELECT min(ae_score) AS lo, max(ae_score) AS hi FROM score_pairs JOIN pair_splits USING (block_id) WHERE split = 'train')""")
def e5(spark, sf_dir):
    rows = X.pairs(spark, sf_dir)
    reference = rows.join(X.pair_splits(spark, sf_dir).filter("split = 'train'").select("block_id"), "block_id")
    return normalise_by(rows, reference, "ae_score", "score").select("block_id", F.round("score", 9).alias("score"))


@check("e6_normalize_all", """
SELECT block_id, round((ae_score - min(ae_score) OVER ()) / (max(ae_score) OVER () - min(ae_score) OVER ()), 9) AS score FROM score_pairs""")
def e6(spark, sf_dir):
    rows = normalise_all(X.pairs(spark, sf_dir), "ae_score", "score")
    return rows.select("block_id", F.round("score", 9).alias("score"))


@check("e7_autoencoder_history")
def e7(spark, sf_dir):
    return autoencoder.history_table(spark, autoencoder_model(spark, sf_dir))


# A network of one input, one hidden unit and one output, trained on all rows at every step:
# its four weights, their Adam moments and the loss before each step, step by step.
_FIRST_WEIGHTS = (0.9, 0.1, -0.4, 0.3)
_G = ("w1", "b1", "w2", "b2")
_MOMENTS = ", ".join(f"0.9 * m_{k} + 0.1 * g_{k} AS m_{k}, 0.999 * v_{k} + 0.001 * g_{k} * g_{k} AS v_{k}" for k in _G)
_ZERO = ", ".join(f"CAST(0 AS DOUBLE) AS m_{k}, CAST(0 AS DOUBLE) AS v_{k}" for k in _G)


def _small_network(rate: float, epochs: int, patience: int) -> str:
    """History of the training in SQL: loss before and after each epoch's step, up to the stop."""
    updates = ", ".join(f"{k} - {rate} * (m_{k} / (1 - 0.9 ** k)) / (sqrt(v_{k} / (1 - 0.999 ** k)) + 1e-7) AS {k}" for k in _G)
    updates += ", " + ", ".join(f"m_{k}, v_{k}" for k in _G)
    return f"""
SELECT CAST(epoch AS INTEGER) AS epoch, round(loss, 7) AS loss, round(val_loss, 7) AS val_loss FROM (
  SELECT *, min(CASE WHEN epoch - improved >= {patience} THEN epoch END) OVER () AS stop FROM (
    SELECT *, max(CASE WHEN better THEN epoch END) OVER (ORDER BY epoch) AS improved FROM (
      SELECT *, val_loss < coalesce(min(val_loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1e300) AS better FROM (
        SELECT k AS epoch, loss, lead(loss) OVER (ORDER BY k) AS val_loss FROM (
          WITH RECURSIVE xs AS (SELECT list(CAST(if_score AS DOUBLE)) AS x FROM score_pairs), net AS (
            SELECT 0 AS k, {", ".join(f"CAST({w} AS DOUBLE) AS {k}" for k, w in zip(_G, _FIRST_WEIGHTS))}, {_ZERO}, CAST(NULL AS DOUBLE) AS loss
            UNION ALL
            SELECT k, {updates}, loss FROM (
              SELECT k + 1 AS k, w1, b1, w2, b2, {_MOMENTS}, loss FROM (
                SELECT *, list_sum(list_transform(list_zip(x, d1), lambda p: p[1] * p[2])) AS g_w1, list_sum(d1) AS g_b1,
                  list_sum(list_transform(list_zip(h, d2), lambda p: p[1] * p[2])) AS g_w2, list_sum(d2) AS g_b2 FROM (
                  SELECT *, list_transform(list_zip(h, d2), lambda p: CASE WHEN p[1] > 0 THEN p[2] * w2 ELSE 0 END) AS d1 FROM (
                    SELECT * EXCLUDE (loss), list_avg(list_transform(list_zip(x, y), lambda p: (p[2] - p[1]) * (p[2] - p[1]))) AS loss,
                      list_transform(list_zip(x, y), lambda p: 2 * (p[2] - p[1]) / len(x) * p[2] * (1 - p[2])) AS d2 FROM (
                      SELECT *, list_transform(h, lambda u: 1 / (1 + exp(-(w2 * u + b2)))) AS y FROM (
                        SELECT *, list_transform(x, lambda u: greatest(w1 * u + b1, 0.0)) AS h FROM net, xs WHERE k <= {epochs})))))))
          SELECT k, loss FROM net WHERE k > 0))
      WHERE epoch <= {epochs}))) WHERE epoch <= coalesce(stop, {epochs})"""


def small_network(spark, sf_dir, rate, epochs, patience):
    model = autoencoder.fit_autoencoder(
        X.pairs(spark, sf_dir), ["if_score"], dims=(1,), epochs=epochs, patience=patience, rate=rate, batch=10**12, held_out=0.0, task_bytes=0, start=np.array(_FIRST_WEIGHTS))
    history = autoencoder.history_table(spark, model)
    return history.select("epoch", F.round("loss", 7).alias("loss"), F.round("val_loss", 7).alias("val_loss"))


@check("e7_small_network", _small_network(0.05, 12, 12))
def e7_small(spark, sf_dir):
    """Loss and validation loss of every epoch, told step by step in SQL."""
    return small_network(spark, sf_dir, 0.05, 12, 12)


@check("e8_small_network_stops", _small_network(0.6, 30, 2))
def e8_small(spark, sf_dir):
    """Too long steps: the loss rises again and training stops after two epochs without a better one."""
    return small_network(spark, sf_dir, 0.6, 30, 2)


@check("e8_early_stopping")
def e8(spark, sf_dir):
    """Training on vectors with little patience: the history ends when it stops improving."""
    rows = X.vectors(spark, sf_dir)
    columns = [c for c in rows.columns if c.startswith("f")]
    rows = features.scale_min_max(rows, features.fit_min_max(rows, columns), columns)
    train = rows.filter(F.col("label") == C.NORMAL)
    return autoencoder.history_table(spark, autoencoder.fit_autoencoder(train, columns))


@check("e9_reconstruction_mse", """
SELECT vec_id, round(avg((x - m) * (x - m)), 6) AS mse FROM (
  SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) t(i)) JOIN (
  SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) t(i) GROUP BY label, i) USING (label, i)
GROUP BY vec_id""")
def e9(spark, sf_dir):
    """Error between every vector and the centre of its label."""
    rows = X.table(spark, sf_dir, "embeddings").withColumn("x", F.col("embedding").cast("array<double>"))
    centre = F.array(*[F.avg(F.col("x")[i]) for i in range(64)]).alias("centre")
    rows = rows.join(F.broadcast(rows.groupBy("label").agg(centre)), "label")
    return rows.select("vec_id", F.round(autoencoder.mean_squared_error(F.col("x"), F.col("centre")), 6).alias("mse"))


@check("e9_autoencoder_scores")
def e9_scores(spark, sf_dir):
    return autoencoder.score_autoencoder(global_scaled(spark, sf_dir), autoencoder_model(spark, sf_dir))


@check("e10_percentile_threshold", """
SELECT round(quantile_cont(ae_score, 0.97), 9) AS threshold FROM score_pairs JOIN pair_splits USING (block_id) WHERE split = 'train'""")
def e10(spark, sf_dir):
    rows = X.pairs(spark, sf_dir).join(X.pair_splits(spark, sf_dir).filter("split = 'train'").select("block_id"), "block_id")
    return percentiles(rows, "ae_score", [0.97]).select(F.round("value", 9).alias("threshold"))


@check("e11_ae_decision", """
SELECT block_id, CASE WHEN if_score > 0.877551 THEN 'Anomaly' ELSE 'Normal' END AS prediction FROM score_pairs""")
def e11(spark, sf_dir):
    """Strictly above the threshold, which some scores hit exactly."""
    return X.pairs(spark, sf_dir).select("block_id", decide(F.col("if_score"), 0.877551, strict=True).alias("prediction"))


cte("stacked", """
SELECT block_id, label, 'ae' AS model, ae_score AS score FROM score_pairs
UNION ALL SELECT block_id, label, 'fusion', fusion_score FROM fused_pairs
UNION ALL SELECT block_id, label, 'if', if_score FROM score_pairs""")
cte("score_curve", """
SELECT model, score, pos, neg, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
       CAST(sum(pos) OVER (PARTITION BY model) AS BIGINT) AS total_pos, CAST(sum(neg) OVER (PARTITION BY model) AS BIGINT) AS total_neg
FROM (SELECT model, score, count(*) FILTER (WHERE label = 'Anomaly') AS pos, count(*) FILTER (WHERE label = 'Normal') AS neg
      FROM stacked GROUP BY model, score)
WINDOW w AS (PARTITION BY model ORDER BY score DESC)""")
cte("rated_curve", """
SELECT *, tp / (tp + fp) AS precision, tp / total_pos AS recall, 2 * tp / (2 * tp + (total_pos - tp) + fp) AS f1 FROM score_curve""")

MODELS = {"ae": ("ae_score", "fusion_prediction"), "fusion": ("fusion_score", "fusion_prediction"), "if": ("if_score", "fusion_prediction")}


@shared
def stacked(spark, sf_dir):
    return metrics.stack_scores(X.fused_pairs(spark, sf_dir), MODELS)


@shared
def curve(spark, sf_dir):
    return metrics.score_curve(stacked(spark, sf_dir), by=["model"])


@check("e12_best_f1_threshold", """
SELECT model, score AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f_beta
FROM rated_curve QUALIFY row_number() OVER (PARTITION BY model ORDER BY f1 DESC, score) = 1""")
def e12(spark, sf_dir):
    return metrics.best_threshold(curve(spark, sf_dir), by=["model"])


# Isotonic fit by the min-max formula over the distinct validation scores.
cte("validation_points", """
SELECT if_score AS score, sum(CASE WHEN p.label = 'Anomaly' THEN 1 ELSE 0 END) AS y, count(*) AS w,
       row_number() OVER (ORDER BY if_score) AS i
FROM score_pairs p JOIN pair_splits s USING (block_id) WHERE split = 'validation' GROUP BY if_score""")
cte("validation_sums", "SELECT *, sum(y) OVER (ORDER BY i) AS sy, sum(w) OVER (ORDER BY i) AS sw FROM validation_points")
cte("isotonic", """
SELECT score, max(worst) AS calibrated FROM (
  SELECT p.score, a.i, min((b.sy - a.sy + a.y) / (b.sw - a.sw + a.w)) AS worst
  FROM validation_sums p JOIN validation_sums a ON a.i <= p.i JOIN validation_sums b ON b.i >= p.i GROUP BY p.score, a.i)
GROUP BY score""")


@shared
def isotonic(spark, sf_dir):
    rows = X.pairs(spark, sf_dir)
    part = X.pair_splits(spark, sf_dir).filter("split = 'validation'").select("block_id")
    return calibration.fit_isotonic(rows.join(part, "block_id"), "if_score")


@check("e13_isotonic_fit", "SELECT score, round(calibrated, 6) AS calibrated FROM isotonic")
def e13(spark, sf_dir):
    rows = X.pairs(spark, sf_dir).join(X.pair_splits(spark, sf_dir).filter("split = 'validation'").select("block_id"), "block_id")
    points = rows.select(F.col("if_score").alias("score")).distinct()
    fitted = calibration.calibrate(points, isotonic(spark, sf_dir), "score", "calibrated")
    return fitted.select("score", F.round("calibrated", 6).alias("calibrated"))


# The knots are the first and the last score of every run of equal values.
@check("e13_isotonic_knots", """
SELECT score, round(calibrated, 6) AS calibrated FROM (
  SELECT *, lag(round(calibrated, 9)) OVER (ORDER BY score) AS before, lead(round(calibrated, 9)) OVER (ORDER BY score) AS after FROM isotonic)
WHERE before IS NULL OR after IS NULL OR round(calibrated, 9) <> before OR round(calibrated, 9) <> after""")
def e13_knots(spark, sf_dir):
    return calibration.knots(spark, isotonic(spark, sf_dir)).select("score", F.round("calibrated", 6).alias("calibrated"))


CALIBRATED = """
SELECT block_id, round(CASE WHEN lo.score IS NULL THEN hi.calibrated WHEN hi.score IS NULL OR hi.score = lo.score THEN lo.calibrated
  ELSE lo.calibrated + (hi.calibrated - lo.calibrated) * (if_score - lo.score) / (hi.score - lo.score) END, 6) AS calibrated
FROM (SELECT p.block_id, p.if_score, max(k.score) FILTER (WHERE k.score <= p.if_score) AS below,
             min(k.score) FILTER (WHERE k.score >= p.if_score) AS above FROM score_pairs p, isotonic k GROUP BY p.block_id, p.if_score)
LEFT JOIN isotonic lo ON lo.score = below LEFT JOIN isotonic hi ON hi.score = above"""


@check("e14_calibrated_scores", CALIBRATED)
def e14(spark, sf_dir):
    rows = calibration.calibrate(X.pairs(spark, sf_dir), isotonic(spark, sf_dir), "if_score", "calibrated")
    return rows.select("block_id", F.round("calibrated", 6).alias("calibrated"))


# Two detectors over different populations: order lines and orders.
cte("order_scores", "SELECT concat('blk_', CAST(o_orderkey AS STRING)) AS block_id, o_totalprice AS ae_raw FROM orders")


def order_scores(spark, sf_dir):
    key = F.concat(F.lit("blk_"), F.col("o_orderkey").cast("string"))
    return X.table(spark, sf_dir, "orders").select(key.alias("block_id"), F.col("o_totalprice").alias("ae_raw"))


@check("e15_score_join", "SELECT block_id, if_score, ae_raw FROM score_pairs JOIN order_scores USING (block_id)")
def e15(spark, sf_dir):
    return fusion.join_scores(X.pairs(spark, sf_dir).select("block_id", "if_score"), order_scores(spark, sf_dir))


@check("e15_mismatch", """
SELECT count(*) FILTER (WHERE a.block_id IS NOT NULL AND b.block_id IS NOT NULL) AS joined,
       count(*) FILTER (WHERE b.block_id IS NULL) AS forest_only, count(*) FILTER (WHERE a.block_id IS NULL) AS autoencoder_only
FROM score_pairs a FULL JOIN order_scores b ON a.block_id = b.block_id""")
def e15_mismatch(spark, sf_dir):
    return fusion.score_mismatch(X.pairs(spark, sf_dir), order_scores(spark, sf_dir))


@check("e16_fusion_score", "SELECT block_id, round(fusion_score, 9) AS fusion_score FROM fused_pairs")
def e16(spark, sf_dir):
    return X.fused_pairs(spark, sf_dir).select("block_id", F.round("fusion_score", 9).alias("fusion_score"))


@check("e17_fusion_decision", "SELECT block_id, fusion_prediction FROM fused_pairs")
def e17(spark, sf_dir):
    return X.fused_pairs(spark, sf_dir).select("block_id", "fusion_prediction")


@check("e17_fitted_scores", f"SELECT block_id, calibrated AS if_calibrated FROM ({CALIBRATED})")
def e17_scores(spark, sf_dir):
    """The fitted fusion's calibrated forest scores, as the isotonic fit in SQL gives them."""
    model = fusion.fit_fusion(X.pairs(spark, sf_dir).drop("label"), X.pair_splits(spark, sf_dir))
    fused = fusion.apply_fusion(X.pairs(spark, sf_dir), model)
    return fused.select("block_id", F.round("if_calibrated", 6).alias("if_calibrated"))


@check("e17_fitted_fusion")
def e17_fitted(spark, sf_dir):
    """Both calibrators fitted on the validation slice, then fused."""
    model = fusion.fit_fusion(X.pairs(spark, sf_dir).drop("label"), X.pair_splits(spark, sf_dir))
    return fusion.apply_fusion(X.pairs(spark, sf_dir), model)


@check("e18_fusion_summary", """
SELECT count(*) FILTER (WHERE split = 'train') AS train_blocks, count(*) FILTER (WHERE split = 'validation') AS validation_blocks,
       count(*) FILTER (WHERE split = 'test') AS test_blocks, count(*) AS total_blocks,
       count(*) FILTER (WHERE fusion_prediction = 'Anomaly') AS predicted_anomaly_count,
       count(*) FILTER (WHERE fusion_prediction = 'Normal') AS predicted_normal_count
FROM fused_pairs LEFT JOIN (SELECT block_id, split FROM pair_splits) USING (block_id)""")
def e18(spark, sf_dir):
    return fusion.run_summary(X.fused_pairs(spark, sf_dir), X.pair_splits(spark, sf_dir))


cte("model_metrics", """
SELECT model, 2 * tp / (2 * tp + fp + fn) AS f1_score, roc_auc, pr_auc
FROM (SELECT model, count(*) FILTER (WHERE label = 'Anomaly' AND fusion_prediction = 'Anomaly') AS tp,
             count(*) FILTER (WHERE label = 'Normal' AND fusion_prediction = 'Anomaly') AS fp,
             count(*) FILTER (WHERE label = 'Anomaly' AND fusion_prediction = 'Normal') AS fn
      FROM stacked JOIN (SELECT block_id, fusion_prediction FROM fused_pairs) USING (block_id) GROUP BY model)
JOIN (SELECT model, sum(pos * (total_neg - fp + 0.5 * neg)) / any_value(total_pos * total_neg) AS roc_auc,
             sum((pos / total_pos) * (tp / (tp + fp))) AS pr_auc FROM score_curve GROUP BY model) USING (model)""")


@check("e19_model_delta", """
SELECT round(round(b.f1_score, 6) - round(a.f1_score, 6), 6) AS f1_score_delta, round(round(b.roc_auc, 6) - round(a.roc_auc, 6), 6) AS roc_auc_delta,
       round(round(b.pr_auc, 6) - round(a.pr_auc, 6), 6) AS pr_auc_delta
FROM model_metrics a, model_metrics b WHERE a.model = 'if' AND b.model = 'ae'""")
def e19(spark, sf_dir):
    table = metrics.ablation(X.fused_pairs(spark, sf_dir), MODELS)
    return metrics.metric_deltas(table, "if", "ae")


@check("e19_forest_comparison")
def e19_forests(spark, sf_dir):
    """Baseline and current forest on the same split, each at its own best threshold."""
    scored = X.log_splits(spark, sf_dir)
    for name, rows, model in (
        ("baseline", global_scaled(spark, sf_dir), baseline_forest(spark, sf_dir)),
        ("current", local_scaled(spark, sf_dir), forest(spark, sf_dir)),
    ):
        scored = scored.join(iforest.score_forest(rows, model, name).select("block_id", name), "block_id")
    long = scored.select("block_id", "label", "split", F.expr("stack(2, 'baseline', baseline, 'current', current) AS (model, score)"))
    best = metrics.best_threshold(metrics.score_curve(long.filter("split = 'validation'"), by=["model"]), by=["model"])
    test = long.filter("split = 'test'").join(F.broadcast(best.select("model", "threshold")), "model")
    return metrics.evaluate(test.withColumn("prediction", decide(F.col("score"), F.col("threshold"))), by=["model"])


def _grid(weights):
    return f"""
SELECT if_weight, score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY if_weight) AS total_pos
FROM (SELECT if_weight, score, count(*) FILTER (WHERE label = 'Anomaly') AS pos, count(*) FILTER (WHERE label = 'Normal') AS neg
      FROM (SELECT label, w AS if_weight, w * if_score + round(1 - w, 6) * ae_score AS score
            FROM score_pairs, (SELECT CAST(unnest({list(weights)}) AS DOUBLE) AS w)) GROUP BY if_weight, score)
WINDOW w AS (PARTITION BY if_weight ORDER BY score DESC)"""


FINE = tuple(sorted({*C.WEIGHT_GRID_FULL, *C.WEIGHT_GRID_AE_DOMINANT}))
cte("grid_curve", _grid(C.WEIGHT_GRID))
cte("fine_curve", _grid(FINE))
_GRID_SEARCH = """
SELECT *, if_weight = first(if_weight) OVER (ORDER BY f_beta DESC, if_weight) AS chosen FROM (
  SELECT if_weight, round(score, 9) AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / total_pos, 6) AS recall,
         round(2 * tp / (2 * tp + (total_pos - tp) + fp), 6) AS f_beta
  FROM grid_curve QUALIFY row_number() OVER (PARTITION BY if_weight ORDER BY 2 * tp / (2 * tp + (total_pos - tp) + fp) DESC, score) = 1)"""


@check("e20_grid_search", _GRID_SEARCH)
def e20(spark, sf_dir):
    rows = fusion.grid_search(X.pairs(spark, sf_dir))
    return rows.withColumn("threshold", F.round("threshold", 9))


@check("e20_fine_grid", _GRID_SEARCH.replace("grid_curve", "fine_curve"))
def e20_fine(spark, sf_dir):
    """Tenths and, between them, more weights where the autoencoder dominates."""
    rows = fusion.grid_search(X.pairs(spark, sf_dir), FINE)
    return rows.withColumn("threshold", F.round("threshold", 9))


@check("e21_recall_floor", """
SELECT model, score AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f_beta
FROM rated_curve WHERE recall >= 0.8 QUALIFY row_number() OVER (PARTITION BY model ORDER BY precision DESC, score) = 1""")
def e21(spark, sf_dir):
    return metrics.best_threshold(curve(spark, sf_dir), by=["model"], recall_floor=C.RECALL_FLOOR)


@check("e21_f2_threshold", """
SELECT model, score AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(5.0 * tp / (5.0 * tp + 4.0 * (total_pos - tp) + fp), 6) AS f_beta
FROM rated_curve QUALIFY row_number() OVER (PARTITION BY model ORDER BY CAST(5.0 * tp AS DOUBLE) / (5.0 * tp + 4.0 * (total_pos - tp) + fp) DESC, score) = 1""")
def e21_f2(spark, sf_dir):
    return metrics.best_threshold(curve(spark, sf_dir), beta=2.0, by=["model"])


cte("reference_pairs", "SELECT if_score, ae_score FROM score_pairs JOIN pair_splits USING (block_id) WHERE split <> 'test'")
_NORM = "least(greatest(({c} - (SELECT min({c}) FROM reference_pairs)) / ((SELECT max({c}) FROM reference_pairs) - (SELECT min({c}) FROM reference_pairs)), 0.0), 1.0)"
_RANK = "(SELECT {c}, n_at / (SELECT count(*) FROM reference_pairs) AS {c}_rank FROM (SELECT {c}, sum(n) OVER (ORDER BY {c}) AS n_at FROM (SELECT {c}, sum(r) AS n FROM (SELECT {c}, 1 AS r FROM reference_pairs UNION ALL SELECT {c}, 0 FROM score_pairs) GROUP BY {c})))"


@check("e22_strategies", f"""
SELECT block_id, round(CAST(0.1 AS DOUBLE) * if_score + CAST(0.9 AS DOUBLE) * ae_score, 9) AS weighted_raw,
       round(CAST(0.1 AS DOUBLE) * a + CAST(0.9 AS DOUBLE) * b, 9) AS weighted_normalized, round(greatest(a, b), 9) AS max,
       round(CAST(0.1 AS DOUBLE) * if_score_rank + CAST(0.9 AS DOUBLE) * ae_score_rank, 9) AS rank
FROM (SELECT *, {_NORM.format(c='if_score')} AS a, {_NORM.format(c='ae_score')} AS b FROM score_pairs)
JOIN {_RANK.format(c='if_score')} USING (if_score) JOIN {_RANK.format(c='ae_score')} USING (ae_score)""")
def e22(spark, sf_dir):
    rows = X.pairs(spark, sf_dir)
    reference = rows.join(X.pair_splits(spark, sf_dir).filter("split <> 'test'").select("block_id"), "block_id")
    scored = fusion.strategy_scores(rows, reference)
    return scored.select("block_id", *[F.round(c, 9).alias(c) for c in C.STRATEGIES])
