"""Alert triage and analytics over scored blocks.

``master`` rows carry block_id, scores, ``fusion_score``, ``fusion_prediction`` and,
when available, ``label`` and raw features.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blocklens import config as C
from blocklens.functions import text
from blocklens.functions.scale import global_rank, lookup_join, split_hash
from blocklens.functions.scoring import priority, severity, severity_band, triage_status
from blocklens.sources.lookup import LOOKUP_COLUMNS


def master_table(predictions: DataFrame, labels: DataFrame | None = None, features: DataFrame | None = None) -> DataFrame:
    """Predictions with labels and raw features where they exist; each input may be absent."""
    table = predictions
    for extra in (labels, features):
        if extra is not None:
            table = table.join(extra, "block_id", "left")
    return table


def with_severity(master: DataFrame, score: str = "fusion_score") -> DataFrame:
    return master.withColumn("severity", severity(F.col(score)))


def with_bands(master: DataFrame, score: str = "fusion_score") -> DataFrame:
    return master.withColumn("band", severity_band(F.col(score)))


def with_priority(alerts: DataFrame) -> DataFrame:
    level = F.col("severity")
    return alerts.withColumns({"priority": priority(level), "status": triage_status(level)})


def filter_alerts(alerts: DataFrame, severities=C.SEVERITIES, decisions=(C.ANOMALY, C.NORMAL), low=0.0, high=1.0,
                  search: str | None = None, regex: bool = False) -> DataFrame:
    """Severity, decision and inclusive score filters, optional literal or regex id search."""
    kept = alerts.filter(
        F.col("severity").isin(*severities)
        & F.col("fusion_prediction").isin(*decisions)
        & F.col("fusion_score").between(low, high)
    )
    if search:
        found = F.col("block_id").rlike(search) if regex else F.col("block_id").contains(search)
        kept = kept.filter(found)
    return kept


def with_any_event(alerts: DataFrame, long_counts: DataFrame, event_ids) -> DataFrame:
    """Blocks containing at least one of the events."""
    holders = long_counts.filter(F.col("event_id").isin(*event_ids) & (F.col("n") > 0))
    return alerts.join(holders.select("block_id"), "block_id", "left_semi")


def first_seen(events: DataFrame) -> DataFrame:
    """Earliest raw timestamp text per block, then parsed; NULL when that text is invalid."""
    earliest = events.filter(F.col("block_id").isNotNull()).groupBy("block_id").agg(F.min("ts_raw").alias("_first"))
    return earliest.select("block_id", text.parse_timestamp(F.col("_first")).alias("first_seen"))


def filter_first_seen(alerts: DataFrame, seen: DataFrame, start, end) -> DataFrame:
    """Blocks first seen in the range, and blocks whose first-seen time is unknown."""
    inside = F.col("first_seen").isNull() | F.col("first_seen").between(F.lit(start), F.lit(end))
    return alerts.join(seen, "block_id", "left").filter(inside)


def alert_queue(alerts: DataFrame, n: int = 200) -> DataFrame:
    """Most urgent alerts: priority, then score, then id; only n rows per task are kept."""
    ranked = with_priority(alerts if "severity" in alerts.columns else with_severity(alerts))
    return ranked.orderBy("priority", F.desc("fusion_score"), "block_id").limit(n)


def analyst_view(alerts: DataFrame) -> DataFrame:
    """What an analyst sees: never the ground-truth label."""
    wanted = ("priority", "block_id", "severity", "fusion_prediction", "fusion_score", "first_seen", "status")
    return alerts.select(*[c for c in wanted if c in alerts.columns])


def kpis(alerts: DataFrame) -> DataFrame:
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    counts = alerts.agg(
        F.count(F.lit(1)).alias("total_blocks"),
        is_("fusion_prediction", C.NORMAL).alias("normal_blocks"),
        is_("fusion_prediction", C.ANOMALY).alias("anomaly_blocks"),
        is_("severity", "CRITICAL").alias("critical_alerts"),
        is_("severity", "HIGH").alias("high_alerts"),
    )
    rate = F.try_divide(F.col("anomaly_blocks") * 100.0, F.col("total_blocks"))
    return counts.withColumns(
        {"needs_investigation": F.col("critical_alerts") + F.col("high_alerts"), "anomaly_rate": rate}
    )


def severity_distribution(alerts: DataFrame) -> DataFrame:
    """Blocks per severity in fixed order, zeros included, from one aggregation."""
    cells = [
        F.struct(F.lit(i + 1).alias("position"), F.lit(s).alias("severity"), F.count_if(F.col("severity") == s).alias("n_blocks"))
        for i, s in enumerate(C.SEVERITIES)
    ]
    return alerts.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def decision_share(alerts: DataFrame) -> DataFrame:
    counts = alerts.groupBy("fusion_prediction").agg(F.count(F.lit(1)).alias("n_blocks"))
    # Two decisions, so the window sees two rows.
    total = F.sum("n_blocks").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("share", F.col("n_blocks") / total)


def histogram(master: DataFrame, column: str, by=(), bins: int = C.HISTOGRAM_BINS) -> DataFrame:
    """Rows per equal-width bin between the column's smallest and largest value."""
    x = F.col(column).cast("double")
    bounds = master.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    wide = F.col("_hi") > F.col("_lo")
    place = F.when(wide, F.least(F.floor((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins) + 1, F.lit(bins)))
    placed = master.filter(x.isNotNull()).crossJoin(F.broadcast(bounds))
    placed = placed.withColumn("bin", F.coalesce(place, F.lit(1)).cast("long"))
    return placed.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n_blocks"))


def hourly_trend(alerts: DataFrame, seen: DataFrame) -> DataFrame:
    """Blocks per first-seen hour and decision, zeros included."""
    rows = alerts.select("block_id", "fusion_prediction").join(seen, "block_id").filter(F.col("first_seen").isNotNull())
    decided = lambda d: F.count_if(F.col("fusion_prediction") == d)
    return rows.groupBy(F.date_trunc("hour", "first_seen").alias("bucket")).agg(
        decided(C.NORMAL).alias("normal"), decided(C.ANOMALY).alias("anomaly")
    )


def top_suspicious(master: DataFrame, n: int = C.TOP_SUSPICIOUS) -> DataFrame:
    return master.orderBy(F.desc_nulls_last("fusion_score"), "block_id").limit(n)


def sample_rows(master: DataFrame, n: int = C.SCATTER_ROWS, seed: int = C.SEED) -> DataFrame:
    """A repeatable sample: the n smallest hashes of the id."""
    return master.withColumn("_h", split_hash("block_id", seed)).orderBy("_h", "block_id").limit(n).drop("_h")


def template_totals(long_counts: DataFrame, view: DataFrame, n: int = C.TOP_TOTALS) -> DataFrame:
    """Largest event totals over the blocks of a view."""
    rows = long_counts.join(view.select("block_id"), "block_id", "left_semi")
    totals = rows.groupBy("event_id").agg(F.sum("n").alias("n_events"))
    return totals.orderBy(F.desc("n_events"), "event_id").limit(n)


def timeline(events: DataFrame) -> DataFrame:
    """Lines of every block in time order with a step number.

    Ordered by (time, line) with unparsable times last. The numbering is distributed and works
    on keys only, so one block may hold any share of all lines; content is joined last, by the
    line ids, which are unique.
    """
    rows = events.filter(F.col("block_id").isNotNull()).select(*LOOKUP_COLUMNS)
    rows = rows.withColumn("ts", text.parse_timestamp(F.col("ts_raw")))
    keys = rows.select("block_id", "ts", "line_id")
    steps = global_rank(keys, [F.asc_nulls_last("ts"), F.asc("line_id")], by=["block_id"], name="step")
    return rows.join(steps.select("line_id", "block_id", "step"), ["line_id", "block_id"]).select(*rows.columns, "step")


def block_event_frequency(long_counts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Events of each block with their share in percent and the template text."""
    # A block has at most as many rows here as there are templates.
    total = F.sum("n").over(Window.partitionBy("block_id"))
    shares = long_counts.withColumn("percentage", F.round(F.col("n") / total * 100, 2))
    named = lookup_join(shares, dictionary.select("event_id", "template"), "event_id")
    return named.withColumn("template", F.coalesce("template", F.lit(C.NO_TEMPLATE)))


def label_features(features: DataFrame, dictionary: DataFrame, column: str = "feature") -> DataFrame:
    """Add ``feature_label``: fixed names, or event id and shortened template text."""
    fixed = F.lit(None).cast("string")
    for name, label in C.FEATURE_LABELS.items():
        fixed = F.when(F.col(column) == name, label).otherwise(fixed)
    rows = with_template(features, dictionary, column)
    short = F.when(F.length("template") <= C.LABEL_LENGTH, F.col("template")).otherwise(
        F.concat(F.substring("template", 1, C.LABEL_LENGTH - 3), F.lit("..."))
    )
    known = F.concat(F.col("event_id"), F.lit(": "), short)
    unknown = F.concat(F.col("event_id"), F.lit(" " + C.NO_TEMPLATE))
    label = F.coalesce(fixed, known, unknown, F.col(column))
    return rows.withColumn("feature_label", label).drop("event_id", "template")


def with_template(features: DataFrame, dictionary: DataFrame, column: str = "feature") -> DataFrame:
    """Add event id and template text to template-count features."""
    event = F.nullif(F.regexp_extract(column, r"^tmpl_(.+)_count$", 1), F.lit(""))
    return lookup_join(features.withColumn("event_id", event), dictionary.select("event_id", "template"), "event_id")


def describe_features(features: DataFrame, dictionary: DataFrame, column: str = "feature") -> DataFrame:
    """Add ``description``: the feature name with its full template text."""
    rows = with_template(features, dictionary, column)
    body = F.coalesce("template", F.lit(C.NO_TEMPLATE.strip("()")))
    full = F.concat(F.col(column), F.lit(" ("), F.col("event_id"), F.lit(": "), body, F.lit(")"))
    return rows.withColumn("description", F.coalesce(full, F.col(column))).drop("event_id", "template")


def feature_values(master: DataFrame, columns) -> DataFrame:
    """One row per block and feature."""
    cells = [F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns]
    return master.select("block_id", F.explode(F.array(*cells)).alias("c")).select("block_id", "c.*")


def _fixed(score, digits: int):
    """Text with a fixed number of decimals, rounded half up in decimal arithmetic."""
    return F.round(score.cast("decimal(18,9)"), digits).cast(f"decimal(18,{digits})").cast("string")


def evidence_text(alerts: DataFrame, threshold: float = C.FUSION_THRESHOLD) -> DataFrame:
    """A sentence of evidence for every alert."""
    score = F.col("fusion_score")
    relation = F.when(score >= threshold, "at or above").otherwise("below")
    sentence = F.concat(
        F.lit("Block "), F.col("block_id"), F.lit(" was classified as "), F.col("fusion_prediction"),
        F.lit(" (severity "), F.col("severity"), F.lit("). Its fusion score of "), _fixed(score, 4),
        F.lit(" is "), relation, F.lit(f" the threshold of {threshold}. Autoencoder score "),
        _fixed(F.col("ae_score"), 4), F.lit(", isolation score "), _fixed(F.col("if_score"), 4), F.lit("."),
    )
    return alerts.withColumn("evidence", sentence)


def score_composition(fused: DataFrame, if_score="if_calibrated", ae_score="ae_calibrated", if_weight=C.IF_WEIGHT,
                      ae_weight=C.AE_WEIGHT) -> DataFrame:
    """Weighted part of each detector in the fused score."""
    parts = F.array(
        F.struct(F.lit("isolation_forest").alias("detector"), (F.lit(if_weight) * F.col(if_score)).alias("part")),
        F.struct(F.lit("autoencoder").alias("detector"), (F.lit(ae_weight) * F.col(ae_score)).alias("part")),
    )
    return fused.select("block_id", F.explode(parts).alias("p")).select("block_id", "p.*")


def dataset_summary(parse=None, collection=None, labels=None, blocks=None) -> DataFrame:
    """Lines from the parse report, else the collection; blocks and label counts from labels, else features.

    Arguments are one-row counts (``parse``, ``collection``) and per-block tables.
    """
    source = parse if parse is not None else collection
    lines = "total_lines_parsed" if parse is not None else "total_lines"
    per_block = labels if labels is not None else blocks
    summary = source.select(F.col(lines).alias("total_lines"))
    counts = per_block.agg(
        F.count(F.lit(1)).alias("total_blocks"),
        *([F.count_if(F.col("label") == v).alias(f"{v.lower()}_blocks") for v in (C.NORMAL, C.ANOMALY)] if labels is not None else []),
    )
    # Two one-row tables.
    return summary.crossJoin(F.broadcast(counts))
