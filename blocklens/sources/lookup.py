"""Block-keyed layout of parsed logs for fast lookups of single blocks."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOOKUP_COLUMNS = ("block_id", "line_id", "ts_raw", "component", "event_id", "event_template", "content")


def write_lookup(parsed: DataFrame, path: str, partitions: int | None = None) -> None:
    """Range partition by block and line, so one huge block spreads over several files.

    Files hold sorted block ids: a filter on block_id skips row groups by their min/max
    and by a bloom filter.
    """
    rows = parsed.filter(F.col("block_id").isNotNull()).select(*LOOKUP_COLUMNS)
    keys = ["block_id", "line_id"]
    ranged = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    (
        ranged.sortWithinPartitions(*keys)
        .write.mode("overwrite")
        .option("parquet.bloom.filter.enabled#block_id", "true")
        .parquet(path)
    )


def block_logs(spark: SparkSession, path: str, block_id: str) -> DataFrame:
    """All lines of one block; the filter reaches the Parquet scan."""
    return spark.read.parquet(path).filter(F.col("block_id") == block_id)
