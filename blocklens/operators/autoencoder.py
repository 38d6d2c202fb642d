"""Dense autoencoder trained by mini-batches: every step takes the mean gradient of its whole batch.

One rule holds for any number of rows. A table that fits a task is trained there, epoch by
epoch; a larger one step by step, each step a job in which all tasks sum the gradients of
their rows of the batch. Rows never leave their task, a few thousand numbers do.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocklens import config as C
from blocklens.functions.scale import checkpointed, percentiles, stored
from blocklens.functions.scoring import decide, normalise_all, normalise_with
from blocklens.operators.iforest import uniform, vectors
from blocklens.operators.sparse import dense_rows

#: Bytes of training rows that one task holds; beyond that each step is a job. Either way the result is the same.
TASK_BYTES = 256 << 20
HELD = -1


@dataclass
class Autoencoder:
    columns: list
    shapes: list
    weights: np.ndarray
    threshold: float | None = None
    history: list = field(default_factory=list)

    def tables(self, spark) -> dict:
        rows = [(i, *shape, w.ravel().tolist(), b.tolist()) for i, (shape, (w, b)) in enumerate(zip(self.shapes, self.layers()))]
        return {
            "ae_layers": spark.createDataFrame(rows, "layer int, n_in int, n_out int, w array<double>, b array<double>"),
            "ae_meta": spark.createDataFrame([(self.columns, self.threshold)], "columns array<string>, threshold double"),
            "ae_history": history_table(spark, self),
        }

    @classmethod
    def from_tables(cls, tables: dict) -> "Autoencoder":
        layers = tables["ae_layers"].orderBy("layer").collect()
        meta = tables["ae_meta"].first()
        flat = np.concatenate([np.concatenate([r.w, r.b]) for r in layers])
        history = [(r.epoch, r.loss, r.val_loss) for r in tables["ae_history"].orderBy("epoch").collect()]
        return cls(list(meta.columns), [(r.n_in, r.n_out) for r in layers], flat, meta.threshold, history)

    def layers(self):
        return unpack(self.weights, self.shapes)


def layer_shapes(width: int, dims=C.ENCODING_DIMS) -> list:
    sizes = [width, *dims, *reversed(dims[:-1]), width]
    return list(zip(sizes[:-1], sizes[1:]))


def unpack(flat: np.ndarray, shapes) -> list:
    layers, at = [], 0
    for n_in, n_out in shapes:
        w = flat[at : at + n_in * n_out].reshape(n_in, n_out)
        at += n_in * n_out
        layers.append((w, flat[at : at + n_out]))
        at += n_out
    return layers


def initial_weights(shapes, seed: int) -> np.ndarray:
    """Glorot-uniform matrices and zero biases."""
    rng = np.random.default_rng(seed)
    parts = []
    for n_in, n_out in shapes:
        bound = math.sqrt(6 / (n_in + n_out))
        parts += [rng.uniform(-bound, bound, n_in * n_out), np.zeros(n_out)]
    return np.concatenate(parts)


def _forward(x: np.ndarray, layers) -> list:
    """Activations of every layer: rectified inside, sigmoid at the output."""
    acts = [x]
    for w, b in layers[:-1]:
        acts.append(np.maximum(acts[-1] @ w + b, 0.0))
    w, b = layers[-1]
    acts.append(1.0 / (1.0 + np.exp(-np.clip(acts[-1] @ w + b, -60, 60))))
    return acts


def squared_error(x: np.ndarray, flat: np.ndarray, shapes) -> np.ndarray:
    """Mean squared reconstruction error per row."""
    return np.mean((x - _forward(x, unpack(flat, shapes))[-1]) ** 2, axis=1)


def _gradient(x, flat, shapes):
    layers = unpack(flat, shapes)
    acts = _forward(x, layers)
    y = acts[-1]
    delta = 2.0 * (y - x) / x.size * y * (1.0 - y)
    grads = []
    for i in range(len(layers) - 1, -1, -1):
        grads += [delta.sum(axis=0), (acts[i].T @ delta).ravel()]
        if i:
            delta = (delta @ layers[i][0].T) * (acts[i] > 0)
    return float(np.mean((y - x) ** 2)), np.concatenate(grads[::-1])


def _columns(batches, width: int, most: int = 0):
    """x and batch number of all rows of a task, each row held once; ``most`` rows are expected at most, more are taken too."""
    x, number, n = np.empty((most, width)), np.empty(most, np.int64), 0
    for b in batches:
        if not b.num_rows:
            continue
        if n + b.num_rows > len(x):
            x, number = (np.concatenate([v[:n], np.empty((max(n, b.num_rows), *v.shape[1:]), v.dtype)]) for v in (x, number))
        dense = "cells" not in b.schema.names
        x[n : n + b.num_rows] = b.column("x").flatten().to_numpy().reshape(-1, width) if dense else dense_rows(b.column("cells"), width)
        number[n : n + b.num_rows] = b.column("batch").to_numpy()
        n += b.num_rows
    return x[:n], number[:n]


def _told(n, loss, numbers):
    return pa.RecordBatch.from_arrays([pa.array([int(n)]), pa.array([float(loss)]), pa.array([numbers.tolist()], pa.list_(pa.float64()))], names=["n", "loss", "numbers"])


_TOLD = "n long, loss double, numbers array<double>"


def _update(state, g, rate):
    """The state (weights, both moments, step) after an Adam step along the mean gradient ``g``."""
    flat, m, v = np.split(state[:-1], 3)
    step = state[-1] + 1
    m = 0.9 * m + 0.1 * g
    v = 0.999 * v + 0.001 * g * g
    flat = flat - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    return np.concatenate([flat, m, v, [step]])


def _batch_sums(state, shapes, held: bool):
    """Over a task's rows: their number and squared error, and the sum of their gradients unless they are held out."""
    flat = state[: (len(state) - 1) // 3]

    def run(batches):
        x, _ = _columns(batches, shapes[0][0])
        if held:
            yield _told(len(x), squared_error(x, flat, shapes).sum() if len(x) else 0.0, np.zeros(0))
        elif len(x):
            loss, g = _gradient(x, flat, shapes)
            yield _told(len(x), loss * len(x), g * len(x))

    return run


def _whole_epoch(state, shapes, rate, order, most: int = 0):
    """All steps of an epoch over the rows of one task, ``most`` of them at most; the state they lead to.

    Rows stay where they came; a step takes those of its batch.
    """

    def run(batches):
        x, number = _columns(batches, shapes[0][0], most)
        place = np.argsort(number, kind="stable")
        number, now, n, total = number[place], state, 0, 0.0
        for k in order:
            some = x[place[slice(*np.searchsorted(number, [k, k + 1]))]]
            if len(some):
                loss, g = _gradient(some, now[: (len(now) - 1) // 3], shapes)
                now, n, total = _update(now, g, rate), n + len(some), total + loss * len(some)
        yield _told(n, total, now)

    return run


def _stepwise_epoch(rows, state, shapes, rate, order):
    """The same with a job for each step: (n, loss, state)."""
    n, total = 0, 0.0
    for k in order:
        # One row of a few thousand numbers from each task.
        told = rows.filter(F.col("batch") == int(k)).mapInArrow(_batch_sums(state, shapes, False), _TOLD).collect()
        own = sum(r.n for r in told)
        if own:
            state = _update(state, np.sum([r.numbers for r in told], axis=0) / own, rate)
            n, total = n + own, total + sum(r.loss for r in told)
    return n, total, state


def fit_autoencoder(
    train: DataFrame,
    columns,
    dims=C.ENCODING_DIMS,
    epochs: int = C.EPOCHS,
    patience: int = C.PATIENCE,
    rate: float = C.LEARNING_RATE,
    batch: int = C.BATCH_SIZE,
    held_out: float = C.AE_VALIDATION_RATIO,
    contamination: float = C.CONTAMINATION,
    seed: int = C.SEED,
    task_bytes: int = TASK_BYTES,
    start: np.ndarray | None = None,
) -> Autoencoder:
    """Fit on rows with ``block_id`` and feature columns scaled to 0-1.

    ``columns`` are their names, or the number of features of sparse vectors in a column
    ``cells``, which become rows of numbers in the tasks, a batch at a time.

    Rows are dealt to batches of about ``batch`` rows by a hash of their id; every epoch takes
    all batches in another order, and a step follows the mean gradient over the batch's rows,
    wherever they are. Up to ``task_bytes`` of rows an epoch is one job in one task, beyond
    that every step is a job over rows stored sorted by batch, which reads that batch only;
    the way and the number of tasks change nothing but the rounding of sums. A lost executor
    repeats the epoch or the step. After ``patience`` epochs without a better validation loss
    training stops and keeps the best weights; without held-out rows that is the training loss
    at the weights in question. ``start`` gives the first weights, an earlier model's for instance.
    """
    width, name = (columns, "cells") if isinstance(columns, int) else (len(columns), "x")
    vectored = checkpointed((train if name == "cells" else vectors(train, columns)).select("block_id", name))
    total = vectored.count()
    steps = max(1, math.ceil(total * (1 - held_out) / batch))
    held = uniform("block_id", F.lit(seed), F.lit("held")) < held_out
    number = F.when(held, F.lit(HELD)).otherwise(F.floor(uniform("block_id", F.lit(seed), F.lit("batch")) * steps)).cast("long")
    rows = stored(vectored.select(name, number.alias("batch")).sortWithinPartitions("batch"))
    whole = total * width * 8 <= task_bytes
    shapes = layer_shapes(width, dims)
    flat = initial_weights(shapes, seed) if start is None else np.asarray(start, float)
    state = np.concatenate([flat, np.zeros(2 * len(flat)), [0.0]])
    training, checking = rows.filter(F.col("batch") != HELD), rows.filter(F.col("batch") == HELD)
    history, best, best_loss, since = [], flat, math.inf, 0
    for epoch in range(epochs + 1):
        checked = checking.mapInArrow(_batch_sums(state, shapes, True), _TOLD).collect() if held_out > 0 else []
        n_held, held_loss = sum(r.n for r in checked), sum(r.loss for r in checked)
        order = np.random.default_rng([seed, epoch]).permutation(steps)
        if not n_held or epoch < epochs:
            if whole:
                told = training.coalesce(1).mapInArrow(_whole_epoch(state, shapes, rate, order, total), _TOLD).collect()
                n, loss, new_state = (told[0].n, told[0].loss, np.array(told[0].numbers)) if told else (0, 0.0, state)
            else:
                n, loss, new_state = _stepwise_epoch(training, state, shapes, rate, order)
        val = held_loss / n_held if n_held else loss / max(n, 1)
        if epoch:
            history[-1] = (*history[-1][:2], val)
            since = 0 if val < best_loss else since + 1
            if val < best_loss:
                best, best_loss = state[: len(flat)], val
            if since >= patience or epoch == epochs:
                break
        state = new_state
        history.append((epoch + 1, loss / max(n, 1), None))
    model = Autoencoder([] if name == "cells" else list(columns), shapes, best, history=history)
    errors = sparse_error(vectored, model) if name == "cells" else vectored.select(error_udf(vectored.sparkSession, model)("x").alias("reconstruction_error"))
    model.threshold = percentiles(errors, "reconstruction_error", [1 - contamination]).first().value
    return model


def history_table(spark, model: Autoencoder) -> DataFrame:
    rows = [(int(e), float(l), None if v is None else float(v)) for e, l, v in model.history]
    return spark.createDataFrame(rows, "epoch int, loss double, val_loss double")


def error_udf(spark, model: Autoencoder):
    """The reconstruction error of a feature array as a vectorised column function."""
    # A few thousand weights, fixed by the architecture.
    shared = spark.sparkContext.broadcast((model.weights, model.shapes))

    @F.pandas_udf("double")
    def error(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        flat, shapes = shared.value
        for x in batches:
            yield pd.Series(squared_error(np.stack(x.to_list()), flat, shapes) if len(x) else [], dtype=float)

    return error


def reconstruction_error(rows: DataFrame, model: Autoencoder, name: str = "reconstruction_error") -> DataFrame:
    """Add the mean squared reconstruction error; rows stay in their partitions."""
    error = error_udf(rows.sparkSession, model)
    return vectors(rows, model.columns, "_x").withColumn(name, error("_x")).drop("_x")


def sparse_error(rows: DataFrame, model: Autoencoder, name: str = "reconstruction_error") -> DataFrame:
    """block_id and reconstruction error of sparse vectors (``cells``); some four million numbers are dense at a time."""
    shared = rows.sparkSession.sparkContext.broadcast((model.weights, model.shapes))
    width = model.shapes[0][0]
    kind = rows.schema["block_id"].dataType.simpleString()

    def run(batches):
        flat, shapes = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, some := max(1, (1 << 22) // width)):
                part = batch.slice(k, some)
                yield pa.RecordBatch.from_arrays([part.column("block_id"), pa.array(squared_error(dense_rows(part.column("cells"), width), flat, shapes))], names=["block_id", name])

    return rows.select("block_id", "cells").mapInArrow(run, f"block_id {kind}, {name} double")


def mean_squared_error(a: Column, b: Column) -> Column:
    """The same error between two array columns, as a plain expression."""
    squares = F.zip_with(a, b, lambda p, q: (p - q) * (p - q))
    return F.aggregate(squares, F.lit(0.0), lambda acc, s: acc + s) / F.size(a)


def score_autoencoder(rows: DataFrame, model: Autoencoder, bounds: DataFrame | None = None) -> DataFrame:
    """block_id, raw error, 0-1 score and the decision (error above the threshold).

    Scores are scaled by ``bounds`` (of the training blocks, saved with the model), or over
    all scored rows without them.
    """
    found = sparse_error(rows, model) if "cells" in rows.columns else reconstruction_error(rows, model)
    errors = checkpointed(found.select("block_id", "reconstruction_error"))
    if bounds is None:
        scored = normalise_all(errors, "reconstruction_error", "ae_score")
    else:
        scored = normalise_with(errors, bounds, "reconstruction_error", "ae_score")
    return scored.withColumn("ae_prediction", decide(F.col("reconstruction_error"), model.threshold, strict=True))
