"""Isotonic calibration of scores."""

from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocklens.functions.scoring import encode_label


def fit_isotonic(validation: DataFrame, score: str) -> IsotonicRegressionModel:
    """Fit on (score, label), reduced to one weighted row per distinct score first."""
    points = (
        validation.filter(F.col(score).isNotNull())
        .groupBy(F.col(score).cast("double").alias("score"))
        .agg(F.avg(encode_label(F.col("label"))).alias("share"), F.count(F.lit(1)).cast("double").alias("weight"))
    )
    fitter = IsotonicRegression(featuresCol="score", labelCol="share", weightCol="weight", predictionCol="calibrated")
    return fitter.fit(points)


def knots(spark, model: IsotonicRegressionModel) -> DataFrame:
    rows = zip(map(float, model.boundaries), map(float, model.predictions))
    return spark.createDataFrame(list(rows), "score double, calibrated double")


def calibrate(scored: DataFrame, model: IsotonicRegressionModel, score: str, name: str) -> DataFrame:
    """Interpolate between knots; beyond the outer ones the end value holds; clipped to 0-1."""
    model = model.copy().setFeaturesCol("_score").setPredictionCol("_calibrated")
    applied = model.transform(scored.withColumn("_score", F.col(score).cast("double")))
    clipped = F.least(F.greatest(F.col("_calibrated"), F.lit(0.0)), F.lit(1.0))
    return applied.withColumn(name, clipped).drop("_score", "_calibrated")
