"""From raw lines to parsed rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocklens import config as C
from blocklens.functions import text


def parse_headers(lines: DataFrame, explode_ids: bool = False) -> DataFrame:
    """Rows of non-blank lines with a valid header, its fields, time and block id.

    The first block id of a line is kept; ``explode_ids`` gives one row per distinct id.
    """
    line = F.col("raw_line")
    parsed = (
        lines.filter(text.has_header(line))
        .withColumn("_parts", text.header_parts(line))
        .withColumns(text.header_columns(F.col("_parts"), line))
        .drop("_parts")
        .withColumn("ts", text.parse_timestamp(F.col("ts_raw")))
    )
    if explode_ids:
        return parsed.withColumn("block_id", F.explode_outer(text.all_block_ids(F.col("content"))))
    return parsed.withColumn("block_id", text.first_block_id(F.col("content")))


def rejected_lines(lines: DataFrame) -> DataFrame:
    """Non-blank lines without a valid header."""
    line = F.col("raw_line")
    return lines.filter(~text.is_blank(line) & ~text.has_header(line))


def reject_sample(lines: DataFrame, order="line_id", n: int = C.REJECT_SAMPLE) -> DataFrame:
    """The first failed lines, as shown in the run's log."""
    return rejected_lines(lines).orderBy(order).limit(n)


def parse_counts(lines: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """Lines read, parsed and failed and the success rate, in one pass.

    With stored ``parsed`` rows (one for each line) they are counted instead of parsing again.
    """
    line = F.col("raw_line")
    read, ok = ~text.is_blank(line), text.has_header(line)
    if parsed is None:
        counts = lines.agg(
            F.count_if(read).alias("total_lines_read"),
            F.count_if(read & ok).alias("total_lines_parsed"),
            F.count_if(read & ~ok).alias("total_lines_failed"),
        )
    else:
        good = parsed.agg(F.count(F.lit(1)).alias("total_lines_parsed"))
        counts = lines.agg(F.count_if(read).alias("total_lines_read")).crossJoin(F.broadcast(good))
        counts = counts.withColumn("total_lines_failed", F.col("total_lines_read") - F.col("total_lines_parsed"))
    share = F.try_divide(F.col("total_lines_parsed"), F.col("total_lines_read"))
    return counts.withColumn("parsing_success_rate", F.round(F.coalesce(share, F.lit(0.0)), 6))


def parse_report(lines: DataFrame, dictionary: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """Parse counts plus the number of templates."""
    templates = dictionary.agg(F.count(F.lit(1)).alias("unique_template_count"))
    return parse_counts(lines, parsed).crossJoin(F.broadcast(templates))


def full_parse_report(report: DataFrame, top: DataFrame) -> DataFrame:
    """``parse_report`` with the most frequent templates (``top``, a short list) and warnings."""
    entry = F.struct("event_id", "template", F.col("n_lines").alias("occurrence_count"))
    order = F.struct((-F.col("n_lines")).alias("n"), "first_line", entry.alias("entry"))
    listed = top.agg(F.transform(F.array_sort(F.collect_list(order)), lambda r: r["entry"]).alias("most_frequent_templates"))
    failed = F.col("total_lines_failed")
    lost = F.when(failed > 0, F.concat(failed.cast("string"), F.lit(" line(s) have no valid header and are left out")))
    return report.crossJoin(F.broadcast(listed)).withColumn("warnings", F.array_compact(F.array(lost)))
