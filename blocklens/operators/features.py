"""Per-block features from parsed, template-labelled lines."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocklens import config as C
from blocklens.functions import text
from blocklens.functions.scoring import min_max

SINGLE_PASS_TEMPLATES = 200


def block_rows(events: DataFrame) -> DataFrame:
    return events.filter(F.col("block_id").isNotNull() & (F.col("block_id") != ""))


def dropped_rows(events: DataFrame) -> DataFrame:
    """Rows read, kept and dropped for want of a block id."""
    has_block = F.coalesce(F.col("block_id") != "", F.lit(False))
    return events.agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(has_block).alias("rows_kept"),
        F.count_if(~has_block).alias("rows_dropped"),
    )


def partial_counts(events: DataFrame) -> DataFrame:
    """Lines pre-aggregated to (block, event, component, level).

    Everything else is computed from this much smaller table, so distinct counts never
    see raw lines and a block holding a third of all lines is already reduced map-side.
    """
    rows = block_rows(events)
    if "ts" not in rows.columns:
        rows = rows.withColumn("ts", text.parse_timestamp(F.col("ts_raw")))
    level = F.upper("level")
    level = F.when(level.isin(*C.KNOWN_LEVELS), level).otherwise("OTHER")
    return (
        rows.withColumn("level", level)
        .groupBy("block_id", "event_id", "component", "level")
        .agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("ts_min"), F.max("ts").alias("ts_max"))
    )


def base_features(partial: DataFrame, *extra) -> DataFrame:
    """The ten base and level features per block, from ``partial_counts``, and ``extra`` aggregates."""
    seconds = F.unix_seconds(F.max("ts_max")) - F.unix_seconds(F.min("ts_min"))
    levels = [
        F.coalesce(F.sum(F.when(F.col("level") == name, F.col("n"))), F.lit(0)).alias(f"{name.lower()}_count")
        for name in (*C.KNOWN_LEVELS, "OTHER")
    ]
    # Distinct counts over this already reduced table.
    grouped = partial.groupBy("block_id").agg(
        F.sum("n").alias("total_log_events"),
        F.count_distinct("event_id").alias("unique_template_count"),
        F.count_distinct("component").alias("unique_component_count"),
        F.greatest(F.coalesce(seconds, F.lit(0)), F.lit(0)).cast("double").alias("time_duration_seconds"),
        *levels,
        *extra,
    )
    density = F.col("total_log_events") / (F.col("time_duration_seconds") + C.DENSITY_EPSILON)
    return grouped.withColumns(
        {"event_sequence_length": F.col("total_log_events"), "event_density": density}
    ).select("block_id", *C.BASE_FEATURES, *grouped.columns[len(C.BASE_FEATURES) - 1 :])


def template_counts_long(partial: DataFrame) -> DataFrame:
    """(block, event) counts; lines without an event id are ignored."""
    return (
        partial.filter(F.col("event_id").isNotNull())
        .groupBy("block_id", "event_id")
        .agg(F.sum("n").alias("n"))
    )


def template_column(event_id: str) -> str:
    return f"tmpl_{event_id}_count"


def template_counts_wide(long: DataFrame, event_ids) -> DataFrame:
    """One column per given event id, in text order."""
    ids = sorted(event_ids)
    pivoted = long.groupBy("block_id").pivot("event_id", ids).agg(F.sum("n"))
    zeroed = [F.coalesce(F.col(f"`{e}`"), F.lit(0)).alias(template_column(e)) for e in ids]
    return pivoted.select("block_id", *zeroed)


def feature_matrix(events: DataFrame, event_ids) -> DataFrame:
    """Block id, ten base features and one count per template, missing values still NULL.

    Everything comes from one aggregation by block over one scan of the lines. Very large
    dictionaries are pivoted instead, which scans twice but needs no aggregate per template.
    """
    partial = partial_counts(events)
    if len(event_ids) > SINGLE_PASS_TEMPLATES:
        wide = template_counts_wide(template_counts_long(partial), event_ids)
        return base_features(partial).join(wide, "block_id", "left")
    known = F.count("event_id") > 0
    count_of = lambda e: F.coalesce(F.sum(F.when(F.col("event_id") == e, F.col("n"))), F.lit(0))
    return base_features(
        partial, *[F.when(known, count_of(e)).alias(template_column(e)) for e in sorted(event_ids)]
    )


def feature_columns(matrix: DataFrame) -> list:
    return [c for c in matrix.columns if c not in ("block_id", "label", "split")]


def missing_cells(matrix: DataFrame) -> DataFrame:
    missing = sum((F.col(f"`{c}`").isNull().cast("long") for c in feature_columns(matrix)), F.lit(0))
    return matrix.agg(F.coalesce(F.sum(missing), F.lit(0)).alias("missing_cells"))


def fill_missing(matrix: DataFrame) -> DataFrame:
    return matrix.na.fill(0, feature_columns(matrix))


def fit_min_max(matrix: DataFrame, columns=None) -> DataFrame:
    """Scaler table (feature, lo, hi) from one aggregation."""
    columns = columns or feature_columns(matrix)
    bounds = [
        F.struct(
            F.lit(c).alias("feature"),
            F.min(F.col(f"`{c}`").cast("double")).alias("lo"),
            F.max(F.col(f"`{c}`").cast("double")).alias("hi"),
        )
        for c in columns
    ]
    return matrix.agg(F.array(*bounds).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def _bounds(scaler: DataFrame) -> dict:
    """The scaler's rows, one per feature, to be used as constants in expressions."""
    return {r.feature: (F.lit(r.lo), F.lit(r.hi)) for r in scaler.collect()}


def scale_min_max(matrix: DataFrame, scaler: DataFrame, columns, clip: bool = False) -> DataFrame:
    """Scale ``columns``; features constant in the scaler become 0."""
    bounds = _bounds(scaler)
    return matrix.withColumns({c: min_max(F.col(f"`{c}`").cast("double"), *bounds[c], clip) for c in columns})


def unscale_min_max(matrix: DataFrame, scaler: DataFrame, columns) -> DataFrame:
    """Recover raw values; a constant feature returns to its constant."""
    bounds = _bounds(scaler)
    raw = {c: F.col(f"`{c}`") * (hi - lo) + lo for c, (lo, hi) in bounds.items() if c in columns}
    return matrix.withColumns(raw)


def zero_duration(matrix: DataFrame) -> DataFrame:
    return matrix.agg(F.count_if(F.col("time_duration_seconds") == 0).alias("blocks_with_zero_duration"))


def feature_report(events: DataFrame, matrix: DataFrame) -> DataFrame:
    """One row: rows read, blocks, columns, zero durations, filled cells, bad timestamps."""
    columns = feature_columns(matrix)
    missing = sum((F.col(f"`{c}`").isNull().cast("long") for c in columns), F.lit(0))
    blocks = matrix.agg(
        F.count(F.lit(1)).alias("total_blocks"),
        F.count_if(F.col("time_duration_seconds") == 0).alias("blocks_with_zero_duration"),
        F.coalesce(F.sum(missing), F.lit(0)).alias("missing_value_cells_filled"),
    ).withColumns(
        {
            "total_feature_columns": F.lit(len(columns)).cast("long"),
            "template_feature_columns": F.lit(sum(c.startswith("tmpl_") for c in columns)).cast("long"),
        }
    )
    rows = block_rows(events).agg(
        F.count(F.lit(1)).alias("total_rows_read"),
        F.count_if(text.parse_timestamp(F.col("ts_raw")).isNull()).alias("bad_timestamps"),
    )
    return rows.crossJoin(F.broadcast(blocks))
