"""Combining detector scores: joins, calibrated fusion, strategies and grid search."""

from dataclasses import dataclass

from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocklens import config as C
from blocklens.functions.scale import lookup_join, running_totals
from blocklens.functions.scoring import decide, normalise_by
from blocklens.operators import metrics
from blocklens.operators.calibration import calibrate, fit_isotonic
from blocklens.operators.splits import require_no_leakage
from blocklens.sources.logs import InputError


@dataclass
class Fusion:
    """Fitted calibrators with the weights and the threshold they belong to."""

    if_calibrator: IsotonicRegressionModel
    ae_calibrator: IsotonicRegressionModel
    if_weight: float = C.IF_WEIGHT
    ae_weight: float = C.AE_WEIGHT
    threshold: float = C.FUSION_THRESHOLD

    def tables(self, spark) -> dict:
        """Weights and threshold; the calibrators are saved as models of their own."""
        row = [(self.if_weight, self.ae_weight, self.threshold)]
        return {"fusion_meta": spark.createDataFrame(row, "if_weight double, ae_weight double, threshold double")}

    @classmethod
    def from_tables(cls, tables: dict, if_calibrator, ae_calibrator) -> "Fusion":
        return cls(if_calibrator, ae_calibrator, **tables["fusion_meta"].first().asDict())


def check_weights(if_weight: float, ae_weight: float) -> None:
    if round(if_weight + ae_weight, 6) != 1.0:
        raise ValueError(f"weights {if_weight} and {ae_weight} must sum to 1")


def join_scores(forest: DataFrame, autoencoder: DataFrame) -> DataFrame:
    """Blocks scored by both detectors; none at all is an error."""
    joined = forest.join(autoencoder, "block_id")
    if joined.isEmpty():
        raise InputError("the detectors share no block")
    return joined


def score_mismatch(forest: DataFrame, autoencoder: DataFrame) -> DataFrame:
    """How many blocks both, only one or only the other detector scored."""
    a = forest.select("block_id", F.lit(True).alias("a"))
    b = autoencoder.select("block_id", F.lit(True).alias("b"))
    return a.join(b, "block_id", "full_outer").agg(
        F.count_if(F.col("a") & F.col("b")).alias("joined"),
        F.count_if(F.col("b").isNull()).alias("forest_only"),
        F.count_if(F.col("a").isNull()).alias("autoencoder_only"),
    )


def weighted(if_score: Column, ae_score: Column, if_weight=C.IF_WEIGHT, ae_weight=C.AE_WEIGHT) -> Column:
    check_weights(if_weight, ae_weight)
    return F.lit(if_weight) * if_score + F.lit(ae_weight) * ae_score


def fuse(scored: DataFrame, if_score="if_calibrated", ae_score="ae_calibrated", if_weight=C.IF_WEIGHT,
         ae_weight=C.AE_WEIGHT, threshold=C.FUSION_THRESHOLD) -> DataFrame:
    """Add the fused score and its decision (at or above the threshold)."""
    score = weighted(F.col(if_score), F.col(ae_score), if_weight, ae_weight)
    return scored.withColumn("fusion_score", score).withColumn(
        "fusion_prediction", decide(F.col("fusion_score"), threshold)
    )


def fit_fusion(scored: DataFrame, splits: DataFrame, **settings) -> Fusion:
    """Fit both calibrators on the validation slice only."""
    require_no_leakage(splits)
    validation = scored.join(splits.filter(F.col("split") == "validation"), "block_id")
    return Fusion(fit_isotonic(validation, "if_score"), fit_isotonic(validation, "ae_score"), **settings)


def apply_fusion(scored: DataFrame, model: Fusion) -> DataFrame:
    """Calibrate both scores and fuse them for every block."""
    both = calibrate(scored, model.if_calibrator, "if_score", "if_calibrated")
    both = calibrate(both, model.ae_calibrator, "ae_score", "ae_calibrated")
    return fuse(both, if_weight=model.if_weight, ae_weight=model.ae_weight, threshold=model.threshold)


def run_summary(scored: DataFrame, splits: DataFrame, prediction: str = "fusion_prediction") -> DataFrame:
    """Split sizes and predicted counts of one run."""
    rows = scored.select("block_id", prediction).join(splits.select("block_id", "split"), "block_id", "left")
    return rows.agg(
        *[F.count_if(F.col("split") == s).alias(f"{s}_blocks") for s in ("train", "validation", "test")],
        F.count(F.lit(1)).alias("total_blocks"),
        F.count_if(F.col(prediction) == C.ANOMALY).alias("predicted_anomaly_count"),
        F.count_if(F.col(prediction) == C.NORMAL).alias("predicted_normal_count"),
    )


def percentile_rank(scored: DataFrame, reference: DataFrame, score: str, name: str) -> DataFrame:
    """Share of reference rows at or below each score.

    Both sides are reduced to distinct scores before the running total, and the result
    comes back by a measured, if need be salted, lookup: one frequent score is no hot key.
    """
    ref = reference.groupBy(F.col(score).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    points = ref.unionByName(scored.select(F.col(score).alias("_s"), F.lit(0).cast("long").alias("_n")).distinct())
    points = points.filter(F.col("_s").isNotNull()).groupBy("_s").agg(F.sum("_n").alias("_n"))
    curve = running_totals(points, "_s", {"_upto": F.col("_n")})
    total = curve.agg(F.sum("_n").alias("_total"))
    ranks = curve.crossJoin(F.broadcast(total)).select(
        F.col("_s").alias(score), F.try_divide(F.col("_upto"), F.col("_total")).alias(name)
    )
    return lookup_join(scored, ranks, score)


def strategy_scores(scored: DataFrame, reference: DataFrame, if_weight: float = C.IF_WEIGHT) -> DataFrame:
    """Add one fused score per strategy.

    ``reference`` is the train and validation population that bounds and ranks refer to.
    """
    ae_weight = round(1 - if_weight, 6)
    both = normalise_by(scored, reference, "if_score", "_if_norm")
    both = normalise_by(both, reference, "ae_score", "_ae_norm")
    both = percentile_rank(both, reference, "if_score", "_if_rank")
    both = percentile_rank(both, reference, "ae_score", "_ae_rank")
    mix = lambda a, b: weighted(F.col(a), F.col(b), if_weight, ae_weight)
    return both.withColumns(
        {
            "weighted_raw": mix("if_score", "ae_score"),
            "weighted_normalized": mix("_if_norm", "_ae_norm"),
            "rank": mix("_if_rank", "_ae_rank"),
            "max": F.greatest("_if_norm", "_ae_norm"),
        }
    ).drop("_if_norm", "_ae_norm", "_if_rank", "_ae_rank")


def weight_grid(scored: DataFrame, weights=C.WEIGHT_GRID, if_score="if_score", ae_score="ae_score") -> DataFrame:
    """One row per block and weight with the fused score."""
    grid = F.explode(F.array(*[F.lit(float(w)) for w in weights])).alias("if_weight")
    wide = scored.select("block_id", "label", if_score, ae_score, grid)
    score = F.col("if_weight") * F.col(if_score) + F.round(1 - F.col("if_weight"), 6) * F.col(ae_score)
    return wide.select("block_id", "label", "if_weight", score.alias("score"))


def grid_search(scored: DataFrame, weights=C.WEIGHT_GRID, beta: float = C.BETA, **columns) -> DataFrame:
    """Best threshold per weight by F-beta, and which weight wins (lowest one of several)."""
    curve = metrics.score_curve(weight_grid(scored, weights, **columns), by=["if_weight"])
    best = metrics.best_threshold(curve, beta, ["if_weight"])
    # One row per weight.
    winner = best.agg(F.max_by("if_weight", F.struct("f_beta", -F.col("if_weight"))).alias("_w"))
    return best.crossJoin(F.broadcast(winner)).withColumn("chosen", F.col("if_weight") == F.col("_w")).drop("_w")
