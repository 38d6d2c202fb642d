"""Feature attribution of detector scores for many alerts, and reports on it.

Contributions are Shapley values against a small background sample: by default the solution of
a least-squares problem over coalitions of features with the Shapley kernel's weights
(Lundberg and Lee, 2017), or by antithetic permutation sampling (Strumbelj and Kononenko, 2014).
"""

import math

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blocklens import config as C
from blocklens.functions.scale import checkpointed, split_hash, spread
from blocklens.operators.autoencoder import Autoencoder, squared_error
from blocklens.operators.iforest import Forest, ForestScorer, alike, forest_scorer, vectors
from blocklens.operators.triage import label_features, with_template

#: Alerts explained together, and alerts of a task: each costs thousands of scores.
AT_ONCE, TASK_ALERTS = 512, 2_000


def background(rows: DataFrame, n: int = C.BACKGROUND_ROWS, seed: int = C.SEED) -> DataFrame:
    """A repeatable sample of the scored population, free of any label."""
    return rows.withColumn("_h", split_hash("block_id", seed)).orderBy("_h", "block_id").limit(n).drop("_h")


def normal_background(rows: DataFrame, prediction="fusion_prediction", n=C.NORMAL_BACKGROUND_ROWS, seed=C.SEED) -> DataFrame:
    """Background from blocks predicted Normal."""
    return background(rows.filter(F.col(prediction) == C.NORMAL), n, seed)


def _contributions(score: Callable, base_rows: np.ndarray, x: np.ndarray, orders: np.ndarray):
    """Average change of the mean score while features switch from background to ``x``."""
    d, m = len(x), len(base_rows)
    phi = np.zeros(d)
    for order in orders:
        grid = np.repeat(base_rows[None], d + 1, axis=0)
        for step, f in enumerate(order):
            grid[step + 1 :, :, f] = x[f]
        means = score(grid.reshape(-1, d)).reshape(d + 1, m).mean(axis=1)
        phi[order] += np.diff(means)
    return phi / len(orders), means[0], means[-1]


def coalitions(d: int, n: int, seed: int = C.SEED):
    """About ``n`` coalitions of ``d`` features (rows of zeros and ones) and their weights.

    A size s of all non-trivial ones weighs (d - 1) / (s (d - s)). From the smallest and
    largest sizes inwards, sizes are taken in full, with their complements, while that fits
    ``n``; the rest is drawn in complementary pairs and shares the weight of its sizes. With
    n >= 2^d - 2 all coalitions are there and the values are exact.
    """
    if d < 2:
        return np.zeros((0, d)), np.zeros(0)
    mass = {s: (d - 1) / (s * (d - s)) * (1 if 2 * s == d else 2) for s in range(1, d // 2 + 1)}
    rows, weights, left, sizes = [], [], n, list(mass)
    while sizes:
        s = sizes[0]
        both = math.comb(d, s) * (1 if 2 * s == d else 2)
        if both > left:
            break
        for chosen in combinations(range(d), s):
            row = np.zeros(d)
            row[list(chosen)] = 1
            rows += [row] if 2 * s == d else [row, 1 - row]
        weights += [mass[s] / both] * both
        left -= both
        sizes.pop(0)
    if sizes and left >= 2:
        rng = np.random.default_rng(seed)
        share = np.array([mass[s] for s in sizes])
        found = {}
        for s in rng.choice(sizes, left // 2, p=share / share.sum()):
            row = np.zeros(d)
            row[rng.permutation(d)[:s]] = 1
            for r in (row, 1 - row):
                found[r.tobytes()] = found.get(r.tobytes(), 0) + 1
        rows += [np.frombuffer(k) for k in found]
        times = np.array(list(found.values()), float)
        weights += list(share.sum() * times / times.sum())
    return np.array(rows).reshape(-1, d), np.array(weights)


def kernel_solver(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The matrix from the coalitions' values to all contributions but the last, whose value follows from their sum."""
    a = z[:, :-1] - z[:, -1:]
    root = np.sqrt(w)[:, None]
    return np.linalg.pinv(a * root) * root.T


def _kernel_contributions(score: Callable, base_rows: np.ndarray, x: np.ndarray, z: np.ndarray, solver: np.ndarray):
    """Contributions that fit the mean scores of all coalitions best and add up to the score exactly."""
    d, m = len(x), len(base_rows)
    base, f_x = float(score(base_rows).mean()), float(score(x[None])[0])
    if d < 2:
        return np.full(d, f_x - base), base, f_x
    values = np.concatenate([
        score((part[:, None, :] * x + (1 - part[:, None, :]) * base_rows).reshape(-1, d)).reshape(len(part), m).mean(axis=1)
        for part in np.array_split(z, max(1, len(z) * m * d >> 22))])
    phi = solver @ (values - base - z[:, -1] * (f_x - base))
    return np.append(phi, f_x - base - phi.sum()), base, f_x


def _kernel_contributions_by_leaves(score: ForestScorer, base_rows: np.ndarray, xs: np.ndarray, z: np.ndarray, solver: np.ndarray):
    """The same for many rows at once, with a forest's mean scores of coalitions summed over its leaves."""
    base, f_x = float(score(base_rows).mean()), score(xs)
    values = score.coalition_means(base_rows, xs, z)
    phi = (values - base - np.outer(f_x - base, z[:, -1])) @ solver.T
    last = f_x - base - phi.sum(axis=1)
    return [(np.append(p, q), base, float(f)) for p, q, f in zip(phi, last, f_x)]


def attribute(alerts: DataFrame, reference: DataFrame, columns, score: Callable, model: str, method: str = "kernel",
              n_coalitions: int | None = None, pairs: int = 1, seed: int = C.SEED, max_reference: int = 1000) -> DataFrame:
    """Long table (block_id, model, feature, value, phi, base, f_x), positive = towards anomaly.

    ``score`` maps a matrix to scores. ``method`` is "kernel", with about ``n_coalitions``
    coalitions (2048 and two for each feature unless given) that are the same for all alerts,
    so their system is solved once, or
    "permutation" with ``pairs`` pairs of orders. Alerts are dealt out to tasks of some
    thousand; the scorer and the rows of ``reference`` are broadcast: more than ``max_reference`` of them are an
    error (see ``background``). base + sum(phi) = f_x per block.
    """
    columns = list(columns)
    rows = vectors(reference, columns).select("block_id", "x").limit(max_reference + 1).collect()
    if not 0 < len(rows) <= max_reference:
        raise ValueError(f"the background needs 1 to {max_reference} rows; attribution.background() draws a sample")
    base_rows = np.array([r.x for r in sorted(rows, key=lambda r: r.block_id)])
    if method == "kernel":
        z, w = coalitions(len(columns), n_coalitions or 2 * len(columns) + C.MORE_COALITIONS, seed)
        explain_one, options = _kernel_contributions, (z, kernel_solver(z, w) if len(columns) > 1 else None)
    else:
        rng = np.random.default_rng(seed)
        orders = np.array([o for _ in range(pairs) for p in [rng.permutation(len(columns))] for o in (p, p[::-1])])
        explain_one, options = _contributions, (orders,)
    by_leaves = method == "kernel" and len(columns) > 1 and isinstance(score, ForestScorer) and score.sums_leaves(len(columns))
    shared = alerts.sparkSession.sparkContext.broadcast((score, base_rows, options))

    @F.pandas_udf("phi array<double>, base double, f_x double")
    def explain(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer, base, more = shared.value
        for batch in batches:
            if by_leaves:
                xs = np.stack(batch.to_list()) if len(batch) else np.zeros((0, base.shape[1]))
                order, done = alike(xs), [None] * len(xs)
                for own in (order[i : i + AT_ONCE] for i in range(0, len(xs), AT_ONCE)):
                    for i, one in zip(own, _kernel_contributions_by_leaves(scorer, base, xs[own], *more)):
                        done[i] = one
            else:
                done = [explain_one(scorer, base, np.asarray(x), *more) for x in batch]
            yield pd.DataFrame(
                {"phi": [p for p, _, _ in done], "base": [b for _, b, _ in done], "f_x": [f for _, _, f in done]}
            )

    dealt = spread(checkpointed(vectors(alerts, columns).select("block_id", "x")), TASK_ALERTS)
    explained = dealt.select("block_id", "x", explain("x").alias("e"))
    names = F.array(*[F.lit(c) for c in columns])
    cells = F.explode(F.arrays_zip(names.alias("feature"), F.col("x").alias("value"), F.col("e.phi").alias("phi")))
    return explained.select("block_id", F.lit(model).alias("model"), cells.alias("c"), "e.base", "e.f_x").select(
        "block_id", "model", "c.feature", "c.value", "c.phi", "base", "f_x"
    )


def attribute_autoencoder(alerts: DataFrame, reference: DataFrame, model: Autoencoder, **options) -> DataFrame:
    score = partial(squared_error, flat=model.weights, shapes=model.shapes)
    return attribute(alerts, reference, model.columns, score, "autoencoder", **{"n_coalitions": C.AE_COALITIONS} | options)


def attribute_forest(alerts: DataFrame, reference: DataFrame, forest: Forest, **options) -> DataFrame:
    """Both inputs carry the forest's locally scaled features."""
    return attribute(alerts, reference, forest.columns, forest_scorer(forest), "isolation_forest", **options)


# Reports over a long attribution table. A block and model have one row per feature, so
# the windows below are bounded by the number of features.


def _size():
    """|phi| rounded for ranking, so that equal contributions tie on every engine."""
    return F.round(F.abs("phi"), 9)


def top_positive(attributions: DataFrame) -> DataFrame:
    """Strongest contributor towards anomaly per block and model; NULL when none is positive."""
    ranked = Window.partitionBy("block_id", "model").orderBy(F.round("phi", 9).desc(), "feature")
    first = attributions.withColumn("_r", F.row_number().over(ranked)).filter(F.col("_r") == 1)
    positive = F.col("phi") > 0
    return first.select(
        "block_id",
        "model",
        F.when(positive, F.col("feature")).alias("feature"),
        F.when(positive, F.col("phi")).alias("phi"),
    )


def top_absolute(attributions: DataFrame, n: int = C.TOP_ABSOLUTE) -> DataFrame:
    """Largest contributions by size per block and model."""
    order = Window.partitionBy("block_id", "model").orderBy(_size().desc(), "feature")
    return attributions.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def top_signed(attributions: DataFrame, n: int = C.TOP_SIGNED) -> DataFrame:
    """Largest positive and largest negative contributions per block and model."""
    signed = attributions.filter(F.col("phi") != 0).withColumn(
        "direction", F.when(F.col("phi") > 0, "positive").otherwise("negative")
    )
    order = Window.partitionBy("block_id", "model", "direction").orderBy(_size().desc(), "feature")
    return signed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def waterfall(attributions: DataFrame, n: int = C.TOP_WATERFALL) -> DataFrame:
    """Steps from baseline to output: the n largest contributions and the sum of the others.

    Needs ``base`` and ``f_x``. ``position`` is 0 for the baseline and grows to the output.
    """
    order = Window.partitionBy("block_id", "model").orderBy(_size().desc(), "feature")
    ranked = attributions.withColumn("_r", F.row_number().over(order))
    step = F.least("_r", F.lit(n + 1))
    parts = ranked.groupBy("block_id", "model", step.alias("position")).agg(
        F.when(F.max("_r") > n, F.concat(F.lit("Other "), F.count(F.lit(1)).cast("string"), F.lit(" feature(s)")))
        .otherwise(F.min("feature"))
        .alias("step"),
        F.sum("phi").alias("amount"),
        F.first("base").alias("base"),
        F.first("f_x").alias("f_x"),
    )
    first = F.struct(F.lit(0).alias("position"), F.lit("Baseline").alias("step"), F.col("base").alias("amount"))
    last = F.struct(F.lit(n + 2).alias("position"), F.lit("Model output").alias("step"), F.col("f_x").alias("amount"))
    here = F.struct("position", "step", "amount")
    ends = F.when(F.col("position") == 1, F.array(first, here, last)).otherwise(F.array(here))
    return parts.select("block_id", "model", F.explode(ends).alias("s")).select("block_id", "model", "s.*")


def template_mapping(attributions: DataFrame, dictionary: DataFrame, n: int = C.TOP_TEMPLATE_FEATURES) -> DataFrame:
    """Template features per block by their largest contribution over all models, with full text."""
    sizes = (
        attributions.filter(F.col("feature").rlike(r"^tmpl_.+_count$"))
        .groupBy("block_id", "feature")
        .agg(F.max(_size()).alias("max_abs_phi"))
    )
    order = Window.partitionBy("block_id").orderBy(F.desc("max_abs_phi"), "feature")
    top = sizes.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return with_template(top, dictionary).withColumn("template", F.coalesce("template", F.lit(C.NO_TEMPLATE)))


def labelled(attributions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Attributions with readable feature labels."""
    return label_features(attributions, dictionary)
