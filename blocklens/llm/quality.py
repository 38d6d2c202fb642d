"""Quality classifier: hashed word n-gram logistic regression trained with FTRL-proximal."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocklens.llm.words import lean, mixed, slices, split_words, text_numbers, training_sample, with_columns

BITS = 18
MAX_TRAIN = 8_000
#: Text bytes worked on at a time; features take some 30 times as much memory.
BLOCK = 2 << 20
SAME_WORD = np.uint64(0x5A5A5A5A12345678)


def word_hashes(distinct: pa.Array):
    """Of each distinct word: a hash of its letters, of the signs at its end, and of its case.

    Signs are a word of their own, so an unseen word with a known ending still tells something.
    """
    text = distinct.to_pandas()
    core = text.str.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    tail = np.where(core.str.len().to_numpy() > 0, [w[w.find(c) + len(c) :] for w, c in zip(text, core)], text)
    upper = (core.str.isupper() & (core.str.len() > 1)).to_numpy(dtype=bool)
    h = pandas_hash(core.str.lower()), pandas_hash(tail, 1)
    return h[0], h[1], upper, tail != "", (core != "").to_numpy(dtype=bool)


def pandas_hash(values, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of strings that does not depend on the process."""
    import pandas as pd

    key = f"{salt:016d}"
    return pd.util.hash_array(np.asarray(values, dtype=object), hash_key=key, categorize=False).astype(np.uint64)


def features(texts: pa.Array, bits: int = BITS):
    """Sparse rows of a block: (index, value, text number), summed within texts, L2-normalised.

    Features are single words, word pairs (a word repeated at once is one pair whatever the
    word), signs and all-capital words, by hash. Whole texts are read.
    """
    codes, starts, distinct = split_words(texts)
    n, mask = len(starts) - 1, np.uint64((1 << bits) - 1)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), n
    word, tail, upper, has_tail, has_core = word_hashes(distinct)
    doc = text_numbers(starts)
    w = word[codes]
    follows = np.flatnonzero(doc[1:] == doc[:-1])
    first, second = w[follows], w[follows + 1]
    pair = np.where(first == second, mixed(SAME_WORD[None]), mixed(first ^ mixed(second, 1), 2))
    parts = [
        (mixed(word, 3)[codes], doc),
        (mixed(tail, 4)[codes][has_tail[codes]], doc[has_tail[codes]]),
        (np.full(int(upper[codes].sum()), mixed(SAME_WORD[None], 5)[0]), doc[upper[codes]]),
        (pair, doc[follows]),
    ]
    index = np.concatenate([(h & mask).astype(np.int64) for h, _ in parts])
    rows = np.concatenate([d for _, d in parts])
    key = (rows << bits) | index
    del parts, index, rows, w, first, second, pair
    key.sort()
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(edge, len(key))).astype(np.float64)
    index, rows = key[edge] & ((1 << bits) - 1), key[edge] >> bits
    norm = np.sqrt(np.bincount(rows, count * count, n))
    return index, count / norm[rows], rows, n


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def follow_the_leader(rows, bits=BITS, alpha=3.0, beta=1.0, l1=0.01, l2=0.01, passes=3):
    """Weights and bias from rows (indices, values, label in 0/1), read in the given order.

    Per coordinate FTRL-proximal: z and n gather gradients and their squares, and a weight
    is the closed form of the regularised leader, zero until |z| passes ``l1``.
    """
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = 1 << bits

    def leader(i):
        return np.where(np.abs(z[i]) <= l1, 0.0, (np.sign(z[i]) * l1 - z[i]) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(passes):
        for index, value, label in rows:
            i, x = np.append(index, bias), np.append(value, 1.0)
            w = leader(i)
            g = (sigmoid(w @ x) - label) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    w = leader(np.arange(len(z)))
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, label="quality", id_col="doc_id", text="text", max_train=MAX_TRAIN, bits=BITS):
    """Weights and bias learnt from about ``max_train`` labelled documents (by hash of the id).

    ``labels`` has id and label (0/1); null ids or labels are left out and of several labels
    of a document the smallest counts. The sample's sparse rows, a bounded number, meet in
    one task, in an order given by the id's hash, so the model is the same for any
    partitioning. Without labels all weights are 0, which scores 0.5.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label).alias("_label"))
    # About max_train rows of two numbers: safe to broadcast.
    chosen = F.broadcast(training_sample(known, [], max_train, id_col))
    rows = docs.select(id_col, F.col(text).alias("_text")).join(chosen, id_col)

    def sparse(batches):
        for batch in batches:
            for part in slices(batch, "_text", BLOCK, tidy=True):
                index, value, row, n = features(part.column("_text"), bits)
                cuts = np.searchsorted(row, np.arange(n + 1))
                lists = [pa.array([x[a:b].astype(t).tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()) for x, t in ((index, "<i4"), (value, "<f4"))]
                yield pa.RecordBatch.from_arrays([part.column("_place"), pc.cast(part.column("_label"), pa.int32()), *lists], names=["place", "label", "index", "value"])

    placed = rows.select("_text", "_label", F.xxhash64(F.lit(11), id_col, "_text").alias("_place"))
    table = placed.mapInArrow(lean(sparse), "place long, label int, index binary, value binary")

    def learn(group):
        group = group.sort_values("place", kind="stable")
        rows = [(np.frombuffer(i, "<i4"), np.frombuffer(v, "<f4").astype(float), y) for i, v, y in zip(group["index"], group["value"], group["label"])]
        w, b = follow_the_leader(rows, bits)
        import pandas as pd

        return pd.DataFrame({"weights": [w.astype("<f4").tobytes()], "bias": [b]})

    model = table.groupBy().applyInPandas(learn, "weights binary, bias double").collect()
    if not model:
        return np.zeros(1 << bits, np.float32), 0.0
    return np.frombuffer(bytes(model[0]["weights"]), "<f4"), model[0]["bias"]


def score(docs: DataFrame, model, text="text", out="score", bits=BITS) -> DataFrame:
    """Append the probability of label 1 for every whole text; null and empty texts get the bias's."""
    weights = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits numbers, whatever the data

    def make(texts):
        w, b = weights.value
        index, value, rows, n = features(texts, bits)
        return [sigmoid(np.bincount(rows, w[index] * value, n) + b)]

    return with_columns(docs, text, f"{out} double", make, BLOCK, tidy=True)
