"""Exact, tie-aware evaluation on distributed running totals.

``by`` names columns that hold independent evaluations (a model, a weight), so several
are measured in one job.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocklens import config as C
from blocklens.functions.scale import global_rank, percentiles, running_totals
from blocklens.functions.scoring import encode_label, ratio
from blocklens.sources.labels import require_known_labels
from blocklens.sources.logs import InputError


def join_labels(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Predictions with labels; an empty result or an unknown label is an error."""
    joined = predictions.join(labels.select("block_id", "label"), "block_id")
    require_known_labels(joined)
    if joined.isEmpty():
        raise InputError("no block has both a prediction and a label")
    return joined


def unmatched(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Number of predictions without a label."""
    missing = predictions.join(labels.select("block_id"), "block_id", "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("unmatched"))


def confusion(scored: DataFrame, by=(), prediction: str = "prediction") -> DataFrame:
    """tn, fp, fn, tp of a decision column against ``label``."""
    y, p = F.col("label") == C.ANOMALY, F.col(prediction) == C.ANOMALY
    counts = [
        F.count_if(~y & ~p).alias("tn"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(y & p).alias("tp"),
    ]
    return scored.groupBy(*by).agg(*counts) if by else scored.agg(*counts)


def rates(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and false-positive rate, six decimals."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.withColumns(
        {
            "accuracy": F.round(ratio(tp + tn, tp + tn + fp + fn), 6),
            "precision": F.round(ratio(tp, tp + fp), 6),
            "recall": F.round(ratio(tp, tp + fn), 6),
            "f1_score": F.round(ratio(2 * tp, 2 * tp + fp + fn), 6),
            "false_positive_rate": F.round(ratio(fp, fp + tn), 6),
        }
    )


def score_counts(scored: DataFrame, score: str = "score", by=()) -> DataFrame:
    """Positives and negatives per distinct score: everything a curve needs."""
    y = encode_label(F.col("label"))
    return (
        scored.filter(F.col(score).isNotNull() & y.isNotNull())
        .groupBy(*by, F.col(score).alias("score"))
        .agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    )


def score_curve(scored: DataFrame, score: str = "score", by=()) -> DataFrame:
    """Per distinct score the counts at or above it (tp, fp) and the totals."""
    counts = score_counts(scored, score, by)
    sums = {"tp": F.col("pos"), "fp": F.col("neg")}
    curve = running_totals(counts, F.desc("score"), sums, by)
    totals = [F.sum("pos").alias("total_pos"), F.sum("neg").alias("total_neg")]
    # One row per evaluation: `by` takes values from a model or weight list.
    if by:
        return curve.join(F.broadcast(curve.groupBy(*by).agg(*totals)), list(by))
    return curve.crossJoin(F.broadcast(curve.agg(*totals)))


def areas(curve: DataFrame, by=()) -> DataFrame:
    """ROC-AUC and average precision; NULL ROC-AUC when only one class is present."""
    pos, neg = F.col("pos"), F.col("neg")
    below = F.col("total_neg") - F.col("fp")
    won = F.sum(pos * (below + 0.5 * neg))
    auc = F.try_divide(won, (F.max("total_pos") * F.max("total_neg")).cast("double"))
    step = F.try_divide(pos, F.col("total_pos")) * F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    measures = [F.round(auc, 6).alias("roc_auc"), F.round(F.sum(step), 6).alias("pr_auc")]
    return curve.groupBy(*by).agg(*measures) if by else curve.agg(*measures)


def pr_curve(curve: DataFrame, by=()) -> DataFrame:
    """Precision and recall at every distinct score used as threshold."""
    tp, fp = F.col("tp"), F.col("fp")
    return curve.select(
        *by,
        F.col("score").alias("threshold"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, F.col("total_pos")).alias("recall"),
    )


def roc_curve(curve: DataFrame, by=()) -> DataFrame:
    return curve.select(
        *by,
        F.col("score").alias("threshold"),
        ratio(F.col("fp"), F.col("total_neg")).alias("fpr"),
        ratio(F.col("tp"), F.col("total_pos")).alias("tpr"),
    )


def _f_beta(beta: float):
    """From counts rather than from precision and recall, so equal values tie exactly."""
    b2 = beta * beta
    missed = F.col("total_pos") - F.col("tp")
    return ratio((1 + b2) * F.col("tp"), (1 + b2) * F.col("tp") + b2 * missed + F.col("fp"))


def best_threshold(curve: DataFrame, beta: float = C.BETA, by=(), recall_floor: float | None = None) -> DataFrame:
    """Threshold with the highest F-beta, the lowest one of several.

    With ``recall_floor`` the highest precision among thresholds reaching that recall.
    Without any threshold the answer is 0.5.
    """
    tp, fp = F.col("tp"), F.col("fp")
    candidates = curve.withColumns(
        {
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, F.col("total_pos")),
            "f_beta": _f_beta(beta),
        }
    )
    goal = "f_beta"
    if recall_floor is not None:
        candidates, goal = candidates.filter(F.col("recall") >= recall_floor), "precision"
    best = F.max_by(F.struct("score", "precision", "recall", "f_beta"), F.struct(goal, -F.col("score")))
    top = candidates.groupBy(*by).agg(best.alias("b")) if by else candidates.agg(best.alias("b"))
    return top.select(
        *by,
        F.coalesce("b.score", F.lit(0.5)).alias("threshold"),
        F.round("b.precision", 6).alias("precision"),
        F.round("b.recall", 6).alias("recall"),
        F.round("b.f_beta", 6).alias("f_beta"),
    )


def precision_at(scored: DataFrame, score: str = "score", ks=C.PRECISION_AT) -> DataFrame:
    """Precision and recall among the k highest scores; k is capped at the number of rows.

    Only the largest k rows reach one task.
    """
    y = encode_label(F.col("label"))
    totals = scored.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(y), F.lit(0)).alias("n_pos"))
    order = [F.desc_nulls_last(score), "block_id"]
    top = scored.orderBy(*order).limit(max(ks)).select("block_id", score, y.alias("y"))
    ranked = global_rank(top, order)
    hits = ranked.agg(*[F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("y"))), F.lit(0)).alias(f"h{k}") for k in ks])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits")) for k in ks]))
    # Two one-row tables.
    table = hits.select(rows.alias("r")).crossJoin(F.broadcast(totals))
    k = F.least(F.col("r.k"), F.col("n"))
    return table.select(
        F.col("r.k").cast("long").alias("k"),
        k.cast("long").alias("k_used"),
        F.col("r.hits").alias("hits"),
        F.round(ratio(F.col("r.hits"), k), 6).alias("precision_at_k"),
        F.round(F.col("r.hits") / F.greatest("n_pos", F.lit(1)), 6).alias("recall_at_k"),
    )


def evaluate(scored: DataFrame, score: str = "score", prediction: str = "prediction", by=(), part="test") -> DataFrame:
    """Confusion counts, rates and areas in one row per evaluation, with the slice named."""
    counts = rates(confusion(scored, by, prediction))
    area = areas(score_curve(scored, score, by), by)
    joined = counts.join(area, list(by)) if by else counts.crossJoin(F.broadcast(area))
    only_one = F.when(F.col("roc_auc").isNull(), "only one class present, ROC-AUC is undefined")
    return joined.withColumns({"slice": F.lit(part), "warning": only_one})


def calibrated_metrics(scored: DataFrame, fit_on: DataFrame, score: str = "score") -> DataFrame:
    """Metrics at the F1-optimal threshold of ``fit_on``, applied to ``scored``."""
    threshold = best_threshold(score_curve(fit_on, score)).select("threshold")
    hit = F.when(F.col(score) >= F.col("threshold"), C.ANOMALY).otherwise(C.NORMAL)
    # The threshold is one row.
    decided = scored.crossJoin(F.broadcast(threshold)).withColumn("prediction", hit)
    return rates(confusion(decided, ["threshold"]))


def stack_scores(scored: DataFrame, columns: dict) -> DataFrame:
    """Long form (model, score, prediction); ``columns``: model -> (score, prediction) columns."""
    rows = [
        F.struct(F.lit(m).alias("model"), F.col(s).alias("score"), F.col(p).alias("prediction"))
        for m, (s, p) in columns.items()
    ]
    return scored.select("block_id", "label", F.explode(F.array(*rows)).alias("r")).select("block_id", "label", "r.*")


def ablation(scored: DataFrame, columns: dict, part: str = "test") -> DataFrame:
    """The same metrics for several detectors side by side."""
    return evaluate(stack_scores(scored, columns), by=["model"], part=part)


def metric_deltas(table: DataFrame, base: str, other: str) -> DataFrame:
    """Change of F1 and the areas from one model to another on the same slice."""
    pick = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    return table.agg(
        *[F.round(pick(other, c) - pick(base, c), 6).alias(f"{c}_delta") for c in ("f1_score", "roc_auc", "pr_auc")]
    )


def score_scale(scored: DataFrame, columns, fractions=(0.5, 0.9, 0.99)) -> DataFrame:
    """Range, moments and percentiles per score column."""
    tables = []
    for c in columns:
        x = F.col(c).cast("double")
        moments = scored.agg(
            F.count(x).alias("n"),
            F.min(x).alias("lo"),
            F.max(x).alias("hi"),
            F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"),
            F.skewness(x).alias("skewness"),
        )
        wide = percentiles(scored, c, fractions).agg(
            *[F.max(F.when(F.col("fraction") == q, F.col("value"))).alias(f"p{round(q * 100)}") for q in fractions]
        )
        tables.append(moments.crossJoin(F.broadcast(wide)).withColumn("model", F.lit(c)))
    return reduce(DataFrame.unionByName, tables)
