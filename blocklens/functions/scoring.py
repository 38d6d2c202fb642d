"""Column functions over scores: scaling, decisions, severity, priority."""

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocklens import config as C


def min_max(value: Column, lo: Column, hi: Column, clip: bool = False) -> Column:
    """Scale to 0-1; a constant range gives 0."""
    scaled = F.when(hi > lo, (value - lo) / (hi - lo)).otherwise(F.when(value.isNotNull(), F.lit(0.0)))
    return F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)) if clip else scaled


def decide(score: Column, threshold, strict: bool = False) -> Column:
    """Anomaly at or above the threshold; above it only when ``strict``."""
    hit = score > threshold if strict else score >= threshold
    return F.when(hit, C.ANOMALY).otherwise(C.NORMAL)


def encode_label(label: Column) -> Column:
    """Normal -> 0, Anomaly -> 1, anything else NULL."""
    return F.when(label == C.ANOMALY, 1).when(label == C.NORMAL, 0)


def severity(score: Column) -> Column:
    return (
        F.when(score >= C.CRITICAL_SCORE, "CRITICAL")
        .when(score >= C.HIGH_SCORE, "HIGH")
        .when(score >= C.MEDIUM_SCORE, "MEDIUM")
        .otherwise("LOW")
    )


def severity_band(score: Column) -> Column:
    """Band of a 0-1 score read as a rounded percentage."""
    percent = F.round(score * 100)
    bands = F.lit(None).cast("string")
    for low, high, name in C.SEVERITY_BANDS:
        bands = F.when(percent.between(low, high), name).otherwise(bands)
    return bands


def _lookup(values: dict) -> Column:
    return F.create_map(*[F.lit(v) for v in chain(*values.items())])


def priority(level: Column) -> Column:
    return F.coalesce(F.try_element_at(_lookup(C.PRIORITY), level), F.lit(C.UNKNOWN_PRIORITY))


def triage_status(level: Column) -> Column:
    return F.coalesce(F.try_element_at(_lookup(C.TRIAGE_STATUS), level), F.lit(C.UNKNOWN_STATUS))


def ratio(top: Column, bottom: Column) -> Column:
    """Division with zero for an empty denominator."""
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def normalise_all(scored: DataFrame, raw: str, name: str) -> DataFrame:
    """Min-max over all rows; a constant score becomes 0."""
    bounds = scored.agg(F.min(raw).alias("_lo"), F.max(raw).alias("_hi"))
    joined = scored.crossJoin(F.broadcast(bounds))
    return joined.withColumn(name, min_max(F.col(raw), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def score_bounds(reference: DataFrame, raw: str) -> DataFrame:
    """One row with the least and greatest raw score of a reference slice, to be saved with the model."""
    return reference.agg(F.min(raw).cast("double").alias("lo"), F.max(raw).cast("double").alias("hi"))


def normalise_with(scored: DataFrame, bounds: DataFrame, raw: str, name: str) -> DataFrame:
    """Min-max with saved bounds (one row), clipped to 0-1."""
    one = bounds.select(F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    joined = scored.crossJoin(F.broadcast(one))
    return joined.withColumn(name, min_max(F.col(raw), F.col("_lo"), F.col("_hi"), clip=True)).drop("_lo", "_hi")


def normalise_by(scored: DataFrame, reference: DataFrame, raw: str, name: str) -> DataFrame:
    """Min-max with the bounds of a reference slice, clipped to 0-1."""
    return normalise_with(scored, score_bounds(reference, raw), raw, name)
