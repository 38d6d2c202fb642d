"""Feature selection on training rows: correlation and variance."""

import math

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocklens import config as C


def correlations(train: DataFrame, columns) -> DataFrame:
    """Pearson r of every column pair i < j; NULL when a column is constant.

    The co-moments are summed over the rows in one pass; only the matrix over the
    columns (a few thousand cells) reaches the driver.
    """
    values = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in columns])
    matrix = Correlation.corr(train.select(array_to_vector(values).alias("x")), "x").first()[0].toArray()
    pairs = [
        (i, j, columns[i], columns[j], None if math.isnan(matrix[i, j]) else float(matrix[i, j]))
        for j in range(len(columns))
        for i in range(j)
    ]
    schema = "i int, j int, feature_a string, feature_b string, r double"
    return train.sparkSession.createDataFrame(pairs, schema)


def variances(train: DataFrame, columns) -> DataFrame:
    """Sample variance per feature."""
    rows = [
        F.struct(F.lit(c).alias("feature"), F.var_samp(F.col(f"`{c}`").cast("double")).alias("variance"))
        for c in columns
    ]
    return train.agg(F.array(*rows).alias("v")).select(F.explode("v").alias("v")).select("v.*")


def selection(train: DataFrame, columns, limit=C.CORRELATION_LIMIT, floor=C.VARIANCE_FLOOR) -> DataFrame:
    """Per feature whether it is kept.

    A feature is dropped when any earlier one correlates with it beyond the limit, even
    if that one is dropped itself, or when its variance is below the floor.
    """
    strong = (
        correlations(train, columns)
        .filter(F.abs("r") > limit)
        .groupBy(F.col("feature_b").alias("feature"))
        .agg(F.count(F.lit(1)).alias("n_correlated"))
    )
    # One row per feature on both sides.
    table = variances(train, columns).join(F.broadcast(strong), "feature", "left")
    table = table.withColumn("n_correlated", F.coalesce("n_correlated", F.lit(0)))
    keep = (F.col("n_correlated") == 0) & (F.coalesce("variance", F.lit(0.0)) >= floor)
    return table.withColumn("selected", keep)


def selected_features(train: DataFrame, columns, **limits) -> list:
    """Names of the kept features in column order (a few dozen names at most)."""
    kept = {r.feature for r in selection(train, columns, **limits).filter("selected").collect()}
    return [c for c in columns if c in kept]
