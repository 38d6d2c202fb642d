"""Ground-truth labels."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blocklens import config as C
from blocklens.sources.logs import InputError


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label CSV with columns BlockId and Label, all text, labels trimmed."""
    raw = spark.read.option("header", "true").csv(path)
    missing = {"BlockId", "Label"} - set(raw.columns)
    if missing:
        raise InputError(f"label file lacks {sorted(missing)}, found {raw.columns}")
    return clean_labels(raw.select(F.col("BlockId").alias("block_id"), F.col("Label").alias("label")))


def clean_labels(labels: DataFrame) -> DataFrame:
    return labels.withColumn("label", F.trim("label"))


def label_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def unexpected_labels(labels: DataFrame) -> DataFrame:
    """Label values outside Normal and Anomaly with their counts."""
    valid = F.col("label").isin(C.NORMAL, C.ANOMALY)
    return label_counts(labels.filter(~valid | F.col("label").isNull()))


def require_known_labels(labels: DataFrame) -> DataFrame:
    bad = [r.label for r in unexpected_labels(labels).limit(20).collect()]
    if bad:
        raise InputError(f"unexpected label values: {bad}")
    return labels
