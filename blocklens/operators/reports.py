"""Evaluation reports of detectors, kept as a history that runs can be compared in."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blocklens import config as C
from blocklens.functions.scale import checkpointed
from blocklens.functions.scoring import decide
from blocklens.operators import metrics

MEASURES = ("accuracy", "precision", "recall", "f1_score", "false_positive_rate", "roc_auc", "pr_auc")
COUNTS = ("tn", "fp", "fn", "tp")
#: What a run's evaluation is made on: parts of the split, and everything that is not trained on.
SLICES = {"validation": ("validation",), "test": ("test",), "holdout": ("validation", "test")}


def sliced(scored: DataFrame) -> DataFrame:
    """A row for each slice that a block's ``split`` belongs to; training blocks belong to none."""
    names = [F.when(F.col("split").isin(*parts), F.lit(name)) for name, parts in SLICES.items()]
    return scored.withColumn("slice", F.explode(F.array_compact(F.array(*names))))


def evaluation_report(scored: DataFrame, model: str, score: str = "score", prediction: str = "prediction", ks=C.PRECISION_AT) -> DataFrame:
    """One row per slice: who was measured, how well, and at the threshold that is best on validation blocks.

    ``scored`` has block_id, label, split, score and prediction. Columns: model, slice,
    n_training (blocks left out), n_normal, n_anomaly, the confusion counts and ``MEASURES``
    of the prediction, threshold and the same measures with ``calibrated_`` before them for
    scores at or above it, precision_at (array of k, k_used, hits, precision, recall by k)
    and warnings. A slice without blocks has no row.
    """
    scored = scored.select("block_id", "label", "split", F.col(score).cast("double").alias("score"), F.col(prediction).alias("prediction"))
    rows = checkpointed(sliced(scored))
    told = metrics.evaluate(rows.withColumnRenamed("slice", "_slice"), by=["_slice"]).drop("warning", "slice").withColumnRenamed("_slice", "slice")
    by_slice = rows.groupBy("slice").agg(
        F.count_if(F.col("label") == C.NORMAL).alias("n_normal"), F.count_if(F.col("label") == C.ANOMALY).alias("n_anomaly"), F.count_if(F.col("score").isNull()).alias("n_unscored"))
    # One row: no validation block means the threshold is 0.5.
    best = metrics.best_threshold(metrics.score_curve(rows.filter("slice = 'validation'"))).select("threshold")
    decided = rows.crossJoin(F.broadcast(best)).withColumn("prediction", decide(F.col("score"), F.col("threshold")))
    again = metrics.rates(metrics.confusion(decided, ["slice", "threshold"]))
    again = again.select("slice", "threshold", *[F.col(c).alias(f"calibrated_{c}") for c in (*COUNTS, *MEASURES[:5])])
    trained = scored.agg(F.count_if(F.col("split") == "train").alias("n_training"))
    out = told.join(by_slice, "slice").join(again, "slice").join(_precision_at(rows, ks), "slice").crossJoin(F.broadcast(trained))
    warnings = F.array_compact(F.array(
        F.when((F.col("n_normal") == 0) | (F.col("n_anomaly") == 0), F.lit("only one class present, ROC-AUC is undefined")),
        F.when(F.col("n_unscored") > 0, F.concat(F.col("n_unscored").cast("string"), F.lit(" block(s) have no score"))),
    ))
    calibrated = [f"calibrated_{c}" for c in (*COUNTS, *MEASURES[:5])]
    return out.select(F.lit(model).alias("model"), "slice", "n_training", "n_normal", "n_anomaly", *COUNTS, *MEASURES, "threshold", *calibrated, "precision_at", warnings.alias("warnings"))


def _precision_at(rows: DataFrame, ks) -> DataFrame:
    """precision_at by slice; only the largest k rows of each of the three slices are ordered."""
    tables = []
    for name in SLICES:
        own = metrics.precision_at(rows.filter(F.col("slice") == name), "score", ks)
        entry = F.struct("k", "k_used", "hits", F.col("precision_at_k").alias("precision"), F.col("recall_at_k").alias("recall"))
        tables.append(own.agg(F.array_sort(F.collect_list(entry)).alias("precision_at")).withColumn("slice", F.lit(name)))
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


def add_to_history(report: DataFrame, path: str, run: str) -> None:
    """Store a run's report rows in the table at ``path``, a folder per run and model; a repeated run replaces its own."""
    for model in [r.model for r in report.select("model").distinct().collect()]:  # the detectors of one run
        report.filter(F.col("model") == model).drop("model").write.mode("overwrite").parquet(f"{path}/run={run}/model={model}")


def read_history(spark, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path).withColumns({c: F.col(c).cast("string") for c in ("run", "model")})


def compare_runs(history: DataFrame, base: str, other: str) -> DataFrame:
    """Change of every measure from one run to another, by model and slice; models of one run only are left out."""
    values = [*MEASURES, "threshold", *[f"calibrated_{c}" for c in MEASURES[:5]]]
    side = lambda run, name: history.filter(F.col("run") == run).select("model", "slice", F.struct(*values).alias(name))
    both = side(base, "_before").join(side(other, "_after"), ["model", "slice"])
    return both.select("model", "slice", *[F.round(F.col("_after")[v] - F.col("_before")[v], 6).alias(f"{v}_delta") for v in values])


def best_runs(history: DataFrame, measure: str = "f1_score", part: str = "test") -> DataFrame:
    """Each model's runs by a measure on one slice, the best first."""
    order = Window.partitionBy("model").orderBy(F.desc_nulls_last(measure), "run")  # one row per run
    return history.filter(F.col("slice") == part).withColumn("rank", F.row_number().over(order)).select("model", "run", measure, "rank")
