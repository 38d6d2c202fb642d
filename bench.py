"""Headline timings on one data folder; prints one JSON line.

Each job starts from the table its stage starts from in a batch run (raw lines, parsed
logs, scores), which is stored beforehand; nothing inside a job is reused. Jobs run once
to warm up and once timed. BENCH_SF_DIR and BENCH_CPUS choose data and cores.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from blocklens import config as C  # noqa: E402
from blocklens.functions import text  # noqa: E402
from blocklens.functions.scale import checkpointed  # noqa: E402
from blocklens.operators import (  # noqa: E402
    attribution, autoencoder, features, fusion, iforest, lines, metrics, splits, templates, triage,
)
from blocklens.session import ship_package  # noqa: E402
from blocklens.sources import sinks  # noqa: E402
from checks import fixtures as X  # noqa: E402
from checks.session import local_session  # noqa: E402


STORED = []


def consume(df):
    df.write.format("noop").mode("overwrite").save()


def parse_and_mask(spark, d):
    parsed = lines.parse_headers(X.log_lines(spark, d))
    consume(parsed.withColumn("signature", text.signature_text(F.col("content"))))


def parse_and_mine(spark, d):
    parsed = checkpointed(templates.with_signature(lines.parse_headers(X.log_lines(spark, d))))
    consume(templates.assign_events(parsed, templates.mine_templates(parsed)))


def mine_documents(spark, d):
    rows = X.text_lines(spark, d).filter(~text.is_blank(F.col("raw_line")))
    rows = rows.select((F.col("doc_id") * 1_000_000 + F.col("line_no")).alias("line_id"), F.col("raw_line").alias("content"))
    consume(templates.mine_templates(rows).dictionary)


def parsed_logs(spark, d):
    """The parsed logs as a stored table, written before timing."""
    path = f"{spark.sparkContext.getCheckpointDir()}/bench-parsed"
    if d not in STORED:
        STORED.append(d)
        sinks.write_parsed(X.events(spark, d), path)
    return spark.read.parquet(path)


def block_features(spark, d):
    rows = parsed_logs(spark, d).select(*sinks.FEATURE_INPUT)
    consume(features.feature_matrix(rows, X.EVENT_IDS))


def block_timeline(spark, d):
    consume(triage.timeline(parsed_logs(spark, d)))


def pair_metrics(spark, d):
    table = X.pairs(spark, d)
    fused = fusion.fuse(table, "if_score", "ae_score")
    consume(metrics.ablation(fused, {"if": ("if_score", "fusion_prediction"), "fusion": ("fusion_score", "fusion_prediction")}))


def grid_search(spark, d):
    consume(fusion.grid_search(X.pairs(spark, d), C.WEIGHT_GRID_FULL))


def exact_splits(spark, d):
    consume(splits.assign_splits(X.pairs(spark, d)))


def vector_columns(rows):
    return [c for c in rows.columns if c.startswith("f")]


def forest_fit_and_score(spark, d):
    rows = X.vectors(spark, d)
    model = iforest.fit_forest(rows.filter(F.col("label") == C.NORMAL), vector_columns(rows), n_trees=200, max_samples=0.5)
    consume(iforest.score_forest(rows, model))


def autoencoder_epochs(spark, d):
    rows = X.vectors(spark, d)
    columns = vector_columns(rows)
    scaled = features.scale_min_max(rows, features.fit_min_max(rows, columns), columns)
    model = autoencoder.fit_autoencoder(scaled.filter(F.col("label") == C.NORMAL), columns, epochs=5)
    consume(autoencoder.score_autoencoder(scaled, model))


def attribution_of_vectors(spark, d):
    rows = X.vectors(spark, d)
    columns = vector_columns(rows)
    shapes = autoencoder.layer_shapes(len(columns))
    model = autoencoder.Autoencoder(columns, shapes, autoencoder.initial_weights(shapes, 1))
    consume(attribution.attribute_autoencoder(rows, attribution.background(rows), model))


def alert_queue(spark, d):
    fused = fusion.fuse(X.pairs(spark, d), "if_score", "ae_score")
    consume(triage.analyst_view(triage.alert_queue(triage.with_severity(fused))))


BENCH = [parse_and_mask, parse_and_mine, mine_documents, block_features, block_timeline, pair_metrics, grid_search,
         exact_splits, forest_fit_and_score, autoencoder_epochs, attribution_of_vectors, alert_queue]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    ship_package(spark)
    checkpointed(spark.range(1))
    parsed_logs(spark, sf_dir)
    X.pairs(spark, sf_dir)
    wanted, took = sys.argv[1:], {}
    for job in BENCH:
        if wanted and job.__name__ not in wanted:
            continue
        job(spark, sf_dir)
        start = time.perf_counter()
        job(spark, sf_dir)
        took[job.__name__] = round(time.perf_counter() - start, 3)
        print(job.__name__, took[job.__name__], file=sys.stderr, flush=True)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
