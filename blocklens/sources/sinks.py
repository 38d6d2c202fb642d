"""Writing and re-reading parsed logs, predictions, reports and model tables."""

from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARSED_COLUMNS = (
    "line_id",
    "date",
    "time",
    "ts_raw",
    "pid",
    "level",
    "component",
    "content",
    "block_id",
    "event_id",
    "event_template",
    "params",
    "raw_line",
)
FEATURE_INPUT = ("ts_raw", "level", "component", "block_id", "event_id")


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Parquet keeps types; CSV stores arrays as JSON text."""
    if fmt == "csv":
        arrays = [f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")]
        df = df.withColumns({c: F.to_json(c) for c in arrays})
        df.write.mode("overwrite").option("header", "true").csv(path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)


def write_parsed(parsed: DataFrame, path: str, fmt: str = "parquet") -> None:
    write_table(parsed.select(*PARSED_COLUMNS), path, fmt)


def read_feature_input(spark: SparkSession, path: str) -> DataFrame:
    """Only the columns the feature stage needs; Parquet skips the others."""
    return spark.read.parquet(path).select(*FEATURE_INPUT)


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report as a single JSON document."""
    report.coalesce(1).write.mode("overwrite").json(path)


def save_model(tables: dict, path: str, calibrators: dict | None = None) -> None:
    """Save model tables (name -> DataFrame) and fitted calibrators under one folder."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    for name, model in (calibrators or {}).items():
        model.write().overwrite().save(f"{path}/{name}")


def load_tables(spark: SparkSession, path: str, names) -> dict:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def load_calibrator(path: str, name: str) -> IsotonicRegressionModel:
    return IsotonicRegressionModel.load(f"{path}/{name}")
