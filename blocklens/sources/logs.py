"""Reading raw log files and measuring their quality."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blocklens import config as C
from blocklens.functions import text
from blocklens.functions.scale import checkpointed, global_rank, lookup_join, running_totals


SPLIT_TABLE_BYTES = 512 << 20


class InputError(ValueError):
    """Inputs are missing, empty or do not have the expected shape."""


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Path, name, extension and size of every non-empty file, without reading contents."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return listing.select(
        "path",
        name.alias("file_name"),
        F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("extension"),
        F.col("length").alias("size_bytes"),
    )


def validate_inputs(spark: SparkSession, folder: str, required) -> DataFrame:
    """Raise when a required file is missing or empty, else return the listing."""
    listing = list_files(spark, folder)
    wanted = spark.createDataFrame([(r,) for r in required], "file_name string")
    bad = wanted.join(listing, "file_name", "left_anti").orderBy("file_name").collect()
    if bad:
        raise InputError("missing or empty: " + ", ".join(r.file_name for r in bad))
    return listing


def discover_files(spark, folder, extensions=C.LOG_EXTENSIONS) -> DataFrame:
    """Log files by extension, in path order."""
    return list_files(spark, folder).filter(F.col("extension").isin(*extensions)).orderBy("path")


def read_lines(spark: SparkSession, path) -> DataFrame:
    """One row per line, blank ones kept, with the file and split it came from.

    Bytes that are not valid UTF-8 are read as Latin-1, line by line.
    """
    lines = spark.read.text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_size").alias("size_bytes"),
        F.col("_metadata.file_block_start").alias("split_start"),
        text.decode_line(F.col("value")).alias("raw_line"),
    )


def number_file_lines(lines: DataFrame) -> DataFrame:
    """Contiguous ``line_id`` over non-blank lines in file order (lines that later fail use one up).

    Lines of a split are consecutive within their task, so the position inside a split
    needs no sort: only one row per split is ordered to find where each split starts.
    Where splits lie depends on the session and may change between jobs, so the lines are
    stored with their split and position first, and both steps read that table. A line
    that finds no split start, which would otherwise vanish, is an error.
    """
    kept = lines.filter(~text.is_blank(F.col("raw_line"))).withColumn("_seq", F.monotonically_increasing_id())
    kept = checkpointed(kept)
    splits = kept.groupBy("path", "split_start").agg(
        F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    ends = running_totals(splits, ["path", "split_start"], {"_end": F.col("_n")})
    starts = ends.select("path", "split_start", "_first", (F.col("_end") - F.col("_n")).alias("_offset"))
    # One row per split of the input (128 MB by default): about 150 MB for 100 TB of logs.
    placed = lookup_join(kept, starts, ["path", "split_start"], limit=SPLIT_TABLE_BYTES)
    line_id = F.col("_offset") + F.col("_seq") - F.col("_first") + 1
    lost = F.raise_error(F.lit("a line has no split start")).cast("long")
    return placed.withColumn("line_id", F.coalesce(line_id, lost)).drop("_seq", "_first", "_offset")


def number_lines(lines: DataFrame, order) -> DataFrame:
    """Contiguous ``line_id`` over non-blank lines along explicit order columns."""
    return global_rank(lines.filter(~text.is_blank(F.col("raw_line"))), order, name="line_id")


def _file_key(table: DataFrame) -> list:
    """What tells files apart: the path where it is known, as names repeat in other folders."""
    return ["path", "file_name"] if "path" in table.columns else ["file_name"]


def file_stats(lines: DataFrame, validate: bool = True) -> DataFrame:
    """Line, blank and malformed counts per file; malformed is NULL unless validated."""
    line = F.col("raw_line")
    malformed = F.count_if(~text.is_blank(line) & ~text.matches_line_format(line))
    measures = [
        F.count(F.lit(1)).alias("line_count"),
        F.count_if(text.is_blank(line)).alias("empty_line_count"),
        (malformed if validate else F.lit(None).cast("long")).alias("malformed_line_count"),
    ]
    if "size_bytes" in lines.columns:
        measures.append(F.max("size_bytes").alias("size_bytes"))
    return lines.groupBy(*_file_key(lines)).agg(*measures)


def sample_lines(lines: DataFrame, order, n: int = C.SAMPLE_LINES) -> DataFrame:
    """First ``n`` non-blank lines of every file; only ``n`` rows per task are shuffled."""
    key = _file_key(lines)
    first = Window.partitionBy(*key).orderBy(order)
    return (
        lines.filter(~text.is_blank(F.col("raw_line")))
        .withColumn("sample_no", F.row_number().over(first))
        .filter(F.col("sample_no") <= n)
        .select(*key, "sample_no", "raw_line")
    )


def malformed_warnings(stats: DataFrame, limit: float = C.MALFORMED_RATIO) -> DataFrame:
    """Malformed share per file and a warning text where it exceeds ``limit``."""
    share = F.col("malformed_line_count") / F.greatest("line_count", F.lit(1))
    message = F.concat(
        F.col("file_name"),
        F.lit(": "),
        F.format_string("%.2f", F.round(share * 100, 2)),
        F.lit("% of lines do not match the expected log format."),
    )
    return stats.withColumn("malformed_ratio", share).withColumn(
        "warning", F.when((F.col("malformed_line_count") > 0) & (share > limit), message)
    )


def collection_totals(stats: DataFrame) -> DataFrame:
    """One row over all files."""
    measures = [
        F.count(F.lit(1)).alias("total_files"),
        F.coalesce(F.sum("line_count"), F.lit(0)).alias("total_lines"),
        F.coalesce(F.sum("empty_line_count"), F.lit(0)).alias("total_empty_lines"),
        F.count("warning").alias("warning_count"),
    ]
    if "size_bytes" in stats.columns:
        measures.append(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"))
    return malformed_warnings(stats).agg(*measures)


def file_report(stats: DataFrame, samples: DataFrame) -> DataFrame:
    """One record per file with its warning and sample lines (a few per file)."""
    sample = F.array_sort(F.collect_list(F.struct("sample_no", "raw_line")))
    key = _file_key(samples)
    examples = samples.groupBy(*key).agg(sample.alias("_s"))
    lines = F.coalesce(F.col("_s.raw_line"), F.array().cast("array<string>"))
    return (
        malformed_warnings(stats)
        .join(examples, key, "left")
        .withColumn("sample_lines", lines)
        .drop("_s")
    )
