"""The line operators on Structured Streaming: parse, match to a frozen dictionary, aggregate, score.

The line scan in chunks becomes a file stream. No operator is redefined here: a stream
goes through the same column functions as a table, and changed blocks through the same saved
models as a batch.
"""

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from blocklens import config as C
from blocklens.functions import text
from blocklens.functions.scale import checkpointed
from blocklens.operators.features import template_column
from blocklens.operators.lines import parse_headers
from blocklens.operators.templates import match_signatures, with_signature
from blocklens.plans import score


def stream_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """New text files of a folder as a stream of lines."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.text(path)
    return lines.select(
        F.col("_metadata.file_name").alias("file_name"), text.decode_line(F.col("value")).alias("raw_line")
    )


def stream_events(lines: DataFrame, dictionary: DataFrame, threshold: float = C.SIMILARITY_THRESHOLD) -> DataFrame:
    """Parsed lines with the event id of a static dictionary; unmatched ones stay NULL."""
    parsed = with_signature(parse_headers(lines)).withColumn("tokens", F.split("signature", " "))
    parsed = parsed.withColumns({"n_tok": F.size("tokens"), "key0": F.get("tokens", 0)})
    return match_signatures(parsed, dictionary, threshold).drop("signature", "tokens", "n_tok", "key0")


def windowed_features(events: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Base and level features per block and event-time window; late lines beyond ``delay`` are left out.

    Distinct counts are approximate here (about 5 %), as a window keeps a sketch for each
    block; ``block_features`` and the batch features count exactly.
    """
    level = F.upper("level")
    grouped = (
        events.filter(F.col("block_id").isNotNull() & F.col("ts").isNotNull())
        .withWatermark("ts", delay)
        .groupBy(F.window("ts", window), "block_id")
    )
    counts = grouped.agg(
        F.count(F.lit(1)).alias("total_log_events"),
        F.approx_count_distinct("event_id").alias("unique_template_count"),
        F.approx_count_distinct("component").alias("unique_component_count"),
        (F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))).cast("double").alias("time_duration_seconds"),
        *[F.count_if(level == name).alias(f"{name.lower()}_count") for name in C.KNOWN_LEVELS],
        F.count_if(F.coalesce(~level.isin(*C.KNOWN_LEVELS), F.lit(True))).alias("other_count"),
    )
    density = F.col("total_log_events") / (F.col("time_duration_seconds") + C.DENSITY_EPSILON)
    return counts.withColumns({"event_sequence_length": F.col("total_log_events"), "event_density": density})


_CELLS = "block_id string, event_id string, component string, level string, n long, lo long, hi long"
_KEYS = ["block_id", "event_id", "component", "level"]
_STATE = "cells string, lo long, hi long"
_UPDATES = (
    "block_id string, total_log_events long, unique_template_count long, unique_component_count long, time_duration_seconds double, "
    "event_sequence_length long, event_density double, info_count long, warn_count long, error_count long, other_count long, "
    "events array<string>, counts array<long>"
)


def _summed_up(batches):
    """Lines of a task's batch by (block, event, component, level), so a hot block sends few rows on."""
    for rows in batches:
        if len(rows):
            yield rows.groupby(_KEYS, dropna=False, as_index=False).agg(n=("n", "sum"), lo=("lo", "min"), hi=("hi", "max"))


def _updated(key, batches, state):
    """Add a block's new cells to what is known of it, whenever their lines were written, and tell its features anew."""
    cells, lo, hi = {}, None, None
    if state.exists:
        held, lo, hi = state.get
        cells = {tuple(c[:3]): c[3] for c in json.loads(held)}
    text_or_none = lambda v: None if pd.isna(v) else v
    for rows in batches:
        for event, component, level, n in zip(rows["event_id"], rows["component"], rows["level"], rows["n"]):
            cell = (text_or_none(event), text_or_none(component), level)
            cells[cell] = cells.get(cell, 0) + int(n)
        if rows["lo"].notna().any():
            low, high = int(rows["lo"].min()), int(rows["hi"].max())
            lo, hi = low if lo is None else min(lo, low), high if hi is None else max(hi, high)
    state.update((json.dumps([[*c, n] for c, n in cells.items()]), lo, hi))
    total = sum(cells.values())
    seconds = float(max(hi - lo, 0)) if lo is not None else 0.0
    counts = {}
    for (event, _, _), n in cells.items():
        if event is not None:
            counts[event] = counts.get(event, 0) + n
    levels = [sum(n for c, n in cells.items() if c[2] == level) for level in (*C.KNOWN_LEVELS, "OTHER")]
    components = len({c[1] for c in cells if c[1] is not None})
    row = [key[0], total, len(counts), components, seconds, total, total / (seconds + C.DENSITY_EPSILON), *levels, list(counts), list(counts.values())]
    yield pd.DataFrame([row], columns=[f.split()[0] for f in _UPDATES.split(", ")])


def block_features(events: DataFrame) -> DataFrame:
    """Exact features of every block that a micro-batch has lines of, over all its lines so far.

    Each block keeps a count for every (event, component, level) and its first and last time,
    so lines that come late count like any others. Columns: block_id, the base features, and
    the template counts as two arrays, events and counts. Use it in update mode; the last row
    of a block is the valid one.
    """
    level = F.upper("level")
    seconds = F.unix_seconds("ts")
    rows = events.filter(F.col("block_id").isNotNull() & (F.col("block_id") != "")).select(
        "block_id", "event_id", "component", F.when(level.isin(*C.KNOWN_LEVELS), level).otherwise("OTHER").alias("level"),
        F.lit(1).cast("long").alias("n"), seconds.alias("lo"), seconds.alias("hi"))
    cells = rows.mapInPandas(_summed_up, _CELLS)
    return cells.groupBy("block_id").applyInPandasWithState(_updated, _UPDATES, _STATE, "update", GroupStateTimeout.NoTimeout)


def as_matrix(updates: DataFrame, columns) -> DataFrame:
    """One column for each of ``columns``, template counts included, from the arrays of ``block_features``."""
    before, after = template_column("|").split("|")
    counts = F.map_from_arrays("events", "counts")
    own = {c: F.coalesce(F.try_element_at(counts, F.lit(c[len(before) : -len(after)])), F.lit(0)) for c in columns if c.startswith(before) and c.endswith(after)}
    return updates.withColumns(own).drop("events", "counts")


def score_stream(events: DataFrame, models: score.Models, out: str, checkpoint: str, **trigger):
    """Start a query that scores changed blocks with saved models and stores severity and features.

    Each micro-batch is written to its own folder below ``out`` (batch=0, 1, ...), so one that
    is repeated after a failure replaces itself; ``latest_scores`` reads the last row of every
    block. ``trigger`` is that of ``DataStreamWriter.trigger``.
    """
    columns = list(dict.fromkeys([*models.forest.columns, *models.network.columns]))

    def write(updates: DataFrame, batch_id: int) -> None:
        # The state has told every changed block once in this micro-batch.
        matrix = checkpointed(as_matrix(updates, columns))
        scored = score.score_blocks(matrix, models)
        scored.join(matrix.select("block_id", "total_log_events", "time_duration_seconds"), "block_id").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = block_features(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def latest_scores(spark: SparkSession, out: str) -> DataFrame:
    """The last score of every block that ``score_stream`` has written."""
    rows = spark.read.parquet(out)
    last = Window.partitionBy("block_id").orderBy(F.desc("batch"))  # as many rows as micro-batches changed the block
    return rows.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r", "batch")
