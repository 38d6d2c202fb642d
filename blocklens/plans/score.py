"""Scoring new blocks with the models an earlier batch run saved; nothing is fitted."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blocklens.functions.scoring import decide, normalise_with
from blocklens.operators import autoencoder, features, fusion, iforest, triage
from blocklens.sources import sinks

TABLES = ("forest_nodes", "forest_meta", "forest_scaler", "forest_threshold", "forest_bounds",
          "ae_layers", "ae_meta", "ae_history", "ae_scaler", "ae_bounds", "fusion_meta")


@dataclass
class Models:
    """Everything a score depends on, as saved."""

    forest: iforest.Forest
    network: autoencoder.Autoencoder
    fusion: fusion.Fusion
    tables: dict


def load_models(spark: SparkSession, path: str) -> Models:
    """Models, scalers, bounds, thresholds and weights of the folder ``models`` of a run."""
    tables = sinks.load_tables(spark, path, TABLES)
    calibrators = [sinks.load_calibrator(path, name) for name in ("fusion_if", "fusion_ae")]
    return Models(iforest.Forest.from_tables(tables), autoencoder.Autoencoder.from_tables(tables),
                  fusion.Fusion.from_tables(tables, *calibrators), tables)


def score_blocks(matrix: DataFrame, models: Models) -> DataFrame:
    """block_id, both scores and decisions, fused score, decision and severity.

    ``matrix`` is a raw feature matrix with missing values filled; features that it lacks count as 0.
    """
    t = models.tables
    wanted = dict.fromkeys([*models.forest.columns, *models.network.columns])
    matrix = matrix.withColumns({c: F.lit(0.0) for c in wanted if c not in matrix.columns})
    local = features.scale_min_max(matrix, t["forest_scaler"], models.forest.columns)
    isolation = normalise_with(iforest.score_forest(local, models.forest), t["forest_bounds"], "raw_score", "if_score")
    isolation = isolation.withColumn("if_prediction", decide(F.col("if_score"), t["forest_threshold"].first().threshold))
    scaled = features.scale_min_max(matrix, t["ae_scaler"], models.network.columns)
    rebuilt = autoencoder.score_autoencoder(scaled, models.network, t["ae_bounds"])
    joined = fusion.join_scores(
        isolation.select("block_id", "if_score", "if_prediction"), rebuilt.select("block_id", "ae_score", "ae_prediction")
    )
    return triage.with_severity(fusion.apply_fusion(joined, models.fusion))
