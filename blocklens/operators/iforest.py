"""Isolation forest (Liu, Ting and Zhou, 2008) as Spark jobs over a node table.

A node is named by its heap number within the tree (root 1, children 2i and 2i+1), so the
model is a plain table (tree, node, feature, threshold, n); ``feature`` is -1 in leaves.
"""

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocklens import config as C
from blocklens.functions.scale import checkpointed, stored
from blocklens.functions.scoring import decide

NODE_SCHEMA = "tree int, node long, feature int, threshold double, n long"
LOCAL_ROWS = 50_000
BROADCAST_NODES = 4_000_000
#: Nodes of a tree, and of the trees that are worked on together, in sums over leaves: each has a bit for a row.
NODES_PER_TREE, NODES_AT_ONCE = 1 << 20, 1 << 16


@dataclass
class Forest:
    nodes: DataFrame
    sample_size: int
    columns: list

    def tables(self) -> dict:
        spark = self.nodes.sparkSession
        meta = spark.createDataFrame([(self.sample_size, self.columns)], "sample_size long, columns array<string>")
        return {"forest_nodes": self.nodes, "forest_meta": meta}

    @classmethod
    def from_tables(cls, tables: dict) -> "Forest":
        meta = tables["forest_meta"].first()
        return cls(tables["forest_nodes"], meta.sample_size, list(meta.columns))


def vectors(matrix: DataFrame, columns, name: str = "x") -> DataFrame:
    """Add the feature columns as one array of doubles."""
    values = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in columns]
    return matrix.withColumn(name, F.array(*values))


def uniform(*keys) -> Column:
    """A number in [0, 1) that depends on the keys only."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) / F.lit(float(1 << 52))


def draw(tree, node, seed: int, what: str):
    """A number in [0, 1) for a node: 52 bits of an MD5, the same from columns and from plain numbers."""
    if isinstance(tree, Column):
        text = F.concat_ws("|", tree.cast("string"), node.cast("string"), F.lit(str(seed)), F.lit(what))
        return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    return int(hashlib.md5(f"{tree}|{node}|{seed}|{what}".encode()).hexdigest()[:13], 16) / float(1 << 52)


def fit_forest(
    train: DataFrame,
    columns,
    n_trees: int = C.FOREST["n_trees"],
    max_samples: float | int = C.FOREST["max_samples"],
    seed: int = C.SEED,
    local_rows: int = LOCAL_ROWS,
) -> Forest:
    """Fit on rows with ``block_id`` and the feature columns.

    ``max_samples`` is a share of the rows (float) or a number of rows (int). A row joins
    a tree when its hash falls below the sampling rate, so no sampling sort is needed and
    the forest does not depend on partitioning. A row is stored once, with one bit for each
    tree that says whether it is a member.

    While a node holds more than ``local_rows`` rows it is split by a pass over the rows,
    which finds each row's open nodes by walking the splits so far and sums up their bounds;
    nothing is stored for a level but its splits. Smaller nodes are finished within one task
    each. Feature and threshold of a node come from one keyed hash, so the node table is the
    same for any ``local_rows``.
    """
    spark = train.sparkSession
    vectored = vectors(train, columns).select("block_id", "x")
    total = vectored.count()
    psi = max(1, min(total, int(max_samples * total) if isinstance(max_samples, float) else max_samples))
    rate = psi / max(total, 1)
    # A row joins a tree if the first 52 bits of the pair's MD5 are below the rate, compared as hexadecimal text.
    below = f"{int(rate * (1 << 52)):014x}"
    trees = F.sequence(F.lit(0), F.lit(n_trees - 1))
    pair = lambda t: F.concat_ws("|", F.col("block_id").cast("string"), t.cast("string"), F.lit(str(seed)))
    bits = F.transform(trees, lambda t: F.when(F.concat(F.lit("0"), F.substring(F.md5(pair(t)), 1, 13)) < below, "1").otherwise("0"))
    rows = checkpointed(vectored.select("block_id", "x", _bits(F.array_join(bits, ""), n_trees).alias("member")))
    limit = math.ceil(math.log2(max(psi, 2)))
    # Splits are looked up in every task: their number is kept within the broadcast bound.
    local_rows = max(local_rows, math.ceil(2 * total * rate * n_trees / BROADCAST_NODES))
    tops = _no_splits()
    if psi * 1.2 > local_rows:
        tops = _split_levels(rows, len(columns), n_trees, limit, seed, local_rows)
    kind = rows.schema["block_id"].dataType.simpleString()
    placed = rows.mapInArrow(_open_rows(spark.sparkContext.broadcast(tops), n_trees), f"block_id {kind}, x array<double>, tree int, node long")
    nodes = placed.groupBy("tree", "node").applyInPandas(_grow(limit, seed), NODE_SCHEMA)
    if len(tops):
        nodes = nodes.unionByName(spark.createDataFrame(tops, NODE_SCHEMA))
    return Forest(checkpointed(nodes), psi, list(columns))


def _bits(text: Column, n: int) -> Column:
    """A text of n zeros and ones as bytes, eight to a byte, from the left."""
    padded = F.rpad(text, -(-n // 8) * 8, "0")
    return F.unhex(F.concat(*[F.lpad(F.conv(F.substring(padded, 1 + 8 * k, 8), 2, 16), 2, "0") for k in range(-(-n // 8))]))


def _no_splits() -> pd.DataFrame:
    kinds = {"tree": "int32", "node": "int64", "feature": "int32", "threshold": "float64", "n": "int64"}
    return pd.DataFrame({c: pd.Series(dtype=t) for c, t in kinds.items()})


class _Tops:
    """The splits so far, for finding the open node of a row in each of its trees."""

    def __init__(self, splits: pd.DataFrame, n_trees: int):
        splits = splits.sort_values(["tree", "node"], ignore_index=True)
        self.n_trees = n_trees
        self.feature, self.threshold = splits["feature"].to_numpy(), np.nan_to_num(splits["threshold"].to_numpy(dtype=float))
        place = {pair: i for i, pair in enumerate(zip(splits["tree"].tolist(), splits["node"].tolist()))}
        self.root = np.array([place.get((t, 1), -1) for t in range(n_trees)], np.int64)
        self.child = np.array([[place.get((t, 2 * n + r), -1) for r in (0, 1)] for t, n in place], np.int64).reshape(-1, 2)

    def open_nodes(self, x: np.ndarray, member: np.ndarray):
        """Row, tree and node of every pair of a row and one of its trees that is in no leaf yet."""
        row, tree = np.nonzero(member)
        at, node = self.root[tree], np.ones(len(row), np.int64)
        if not len(self.feature):
            return row, tree, node
        while True:
            inner = np.flatnonzero((at >= 0) & (self.feature[at] >= 0))
            if not len(inner):
                break
            k = at[inner]
            right = (x[row[inner], self.feature[k]] > self.threshold[k]).astype(np.int64)
            node[inner] = 2 * node[inner] + right
            at[inner] = self.child[k, right]
        left = at < 0
        return row[left], tree[left], node[left]


def _pieces(batches, tops: _Tops):
    """Small pieces of a task's rows: the batch, x, and the open pairs (row, tree, node)."""
    for batch in batches:
        for k in range(0, batch.num_rows, 1024):
            part = batch.slice(k, 1024)
            x = part.column("x").flatten().to_numpy().reshape(part.num_rows, -1)
            packed = np.frombuffer(b"".join(part.column("member").to_pylist()), np.uint8).reshape(part.num_rows, -1)
            yield part, x, tops.open_nodes(x, np.unpackbits(packed, axis=1)[:, : tops.n_trees])


def _open_rows(splits, n_trees: int):
    """Copies of the rows for the nodes that are still open, each row once for each of its trees."""

    def run(batches):
        tops = _Tops(splits.value, n_trees)
        for part, x, (row, tree, node) in _pieces(batches, tops):
            for k in range(0, len(row), 16_384):
                own = slice(k, k + 16_384)
                taken = pa.array(row[own])
                yield pa.RecordBatch.from_arrays(
                    [part.column("block_id").take(taken), part.column("x").take(taken), pa.array(tree[own].astype(np.int32)), pa.array(node[own])], names=["block_id", "x", "tree", "node"])

    return run


def _node_bounds(splits, n_trees: int, width: int):
    """Rows and bounds of the open nodes, summed up over each piece of a task's rows."""

    def run(batches):
        tops = _Tops(splits.value, n_trees)
        for _, x, (row, tree, node) in _pieces(batches, tops):
            if not len(row):
                continue
            order = np.lexsort((node, tree))
            row, tree, node = row[order], tree[order], node[order]
            cuts = np.flatnonzero(np.concatenate([[True], (tree[1:] != tree[:-1]) | (node[1:] != node[:-1])]))
            lo, hi = (f.reduceat(x[row], cuts, axis=0) for f in (np.minimum, np.maximum))
            columns = [pa.array(tree[cuts].astype(np.int32)), pa.array(node[cuts]), pa.array(np.diff(np.append(cuts, len(row))))]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(v[:, i]) for v in (lo, hi) for i in range(width)]], names=["tree", "node", "n", *_bound_names(width)])

    return run


def _bound_names(width: int) -> list:
    return [f"{k}{i}" for k in ("lo", "hi") for i in range(width)]


def _split_levels(rows: DataFrame, width: int, n_trees: int, limit: int, seed: int, local_rows: int) -> pd.DataFrame:
    """Splits of all nodes above ``local_rows``, level by level; at most ``limit`` + 1 passes."""
    spark, tops = rows.sparkSession, _no_splits()
    schema = "tree int, node long, n long, " + ", ".join(f"{c} double" for c in _bound_names(width))
    lows, highs = (_bound_names(width)[k * width :][:width] for k in (0, 1))
    while True:
        bounds = rows.mapInArrow(_node_bounds(spark.sparkContext.broadcast(tops), n_trees, width), schema)
        sums = [F.sum("n").alias("n"), *[F.min(c).alias(c) for c in lows], *[F.max(c).alias(c) for c in highs]]
        # Only nodes above the bound are told, at most all rows' copies divided by it.
        large = bounds.groupBy("tree", "node").agg(*sums).filter(F.col("n") > local_rows).toPandas()
        if not len(large):
            return tops
        made = []
        for tree, node, n, lo, hi in zip(large["tree"].tolist(), large["node"].tolist(), large["n"].tolist(), large[lows].to_numpy(), large[highs].to_numpy()):
            open_features = np.flatnonzero(hi > lo) if node.bit_length() <= limit else []
            f, t = -1, np.nan
            if len(open_features):
                f = int(open_features[int(draw(tree, node, seed, "feature") * len(open_features))])
                t = lo[f] + draw(tree, node, seed, "threshold") * (hi[f] - lo[f])
            made.append((tree, node, f, t, n))
        found = pd.DataFrame(made, columns=tops.columns).astype(tops.dtypes.to_dict())
        tops = pd.concat([tops, found], ignore_index=True) if len(tops) else found


def _grow(limit: int, seed: int):
    """Finishes the subtree below one node; the group is bounded by ``local_rows``."""

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block_id")
        tree, root = int(rows["tree"].iloc[0]), int(rows["node"].iloc[0])
        x = np.stack(rows["x"].to_list())
        out, todo = [], [(root, np.arange(len(x)))]
        while todo:
            node, idx = todo.pop()
            part = x[idx]
            lo, hi = part.min(axis=0), part.max(axis=0)
            open_features = np.flatnonzero(hi > lo)
            if node.bit_length() > limit or len(idx) < 2 or not len(open_features):
                out.append((tree, node, -1, np.nan, len(idx)))
                continue
            f = int(open_features[int(draw(tree, node, seed, "feature") * len(open_features))])
            t = lo[f] + draw(tree, node, seed, "threshold") * (hi[f] - lo[f])
            right = part[:, f] > t
            out.append((tree, node, f, t, len(idx)))
            todo += [(2 * node + 1, idx[right]), (2 * node, idx[~right])]
        return pd.DataFrame(out, columns=["tree", "node", "feature", "threshold", "n"])

    return grow


def average_path(n):
    """Expected path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    many = np.maximum(n, 3)
    long = 2 * (np.log(many - 1) + np.euler_gamma) - 2 * (many - 1) / many
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


class Walker:
    """Node rows as arrays; children are adjacent once sorted by heap number."""

    def __init__(self, nodes: pd.DataFrame):
        nodes = nodes.sort_values(["tree", "node"], ignore_index=True)
        node, tree = nodes["node"].to_numpy(), nodes["tree"].to_numpy()
        self.feature = nodes["feature"].to_numpy()
        self.threshold = np.nan_to_num(nodes["threshold"].to_numpy(dtype=float))
        self.roots = np.flatnonzero(node == 1)
        starts = np.searchsorted(tree, tree)
        self.child = np.full(len(node), -1)
        for root, end in zip(self.roots, [*self.roots[1:], len(node)]):
            inner = root + np.flatnonzero(self.feature[root:end] >= 0)
            self.child[inner] = starts[inner] + np.searchsorted(node[root:end], 2 * node[inner])
        depth = np.floor(np.log2(node))
        self.length = np.where(self.child < 0, depth + average_path(nodes["n"]), 0.0)

    def total_path(self, x: np.ndarray) -> np.ndarray:
        """Sum of path lengths over the trees for every row."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        while True:
            child = self.child[at]
            inner = child >= 0
            if not inner.any():
                return self.length[at].sum(axis=1)
            right = x[rows, self.feature[at]] > self.threshold[at]
            at = np.where(inner, child + right, at)


def raw_score(total_path, n_trees: int, sample_size: int):
    """2^(-E[h]/c(psi)) - 0.5: above zero means more isolated than average."""
    scale = max(float(average_path(sample_size)), 1e-12)
    return 2.0 ** (-np.asarray(total_path) / n_trees / scale) - 0.5


def forest_scorer(forest: Forest, limit: int = BROADCAST_NODES):
    """Callable matrix -> raw scores, for a forest within the broadcast bound; a larger one is an error."""
    if forest.nodes.count() > limit:
        raise ValueError(f"a forest of more than {limit} nodes does not fit a task; score it with score_forest")
    return ForestScorer(Walker(forest.nodes.toPandas()), forest.sample_size)


class ForestScorer:
    """Raw scores of rows, and mean scores of coalitions without walking their rows."""

    def __init__(self, walker: Walker, sample_size: int):
        self.walker, self.sample_size = walker, sample_size

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return raw_score(self.walker.total_path(x), len(self.walker.roots), self.sample_size)

    def sums_leaves(self, width: int) -> bool:
        """Whether summing over leaves costs less than walking rows of ``width`` features: a tree's nodes are worked on in one piece."""
        return width > 0 and int(np.diff(np.append(self.walker.roots, len(self.walker.child))).max()) <= NODES_PER_TREE

    def coalition_means(self, base: np.ndarray, xs: np.ndarray, z: np.ndarray) -> np.ndarray:
        """(rows of ``xs``, coalitions ``z``): the mean score while the coalition's features are the row's, the others the background's.

        A row mixed of x and b goes x's way at a node whose feature is in the coalition and b's
        way elsewhere. So for a coalition the x that reach a node, and the b that do, are told
        by a bit each, 64 rows to a word, from the root down, and nodes that no x or no b
        reaches are left out. The total paths of 64 x and all b are the product of two tables
        over the leaves that some of both reach. Rows next to each other should be alike
        (``alike``), as they then share leaves.
        """
        n, m = len(xs), len(base)
        paths, split = np.zeros((len(z), n, m)), -(-n // 64)
        every = np.hstack([_packed(np.ones((1, k), bool)) for k in (n, m)])
        for first, last in self._parts():
            goes = np.hstack([_right(self.walker, first, last, rows) for rows in (xs, base)])
            for c, chosen in enumerate(z > 0):
                decide = np.where((np.arange(len(every[0])) < split) == chosen[:, None], ~np.uint64(0), np.uint64(0))
                leaves, of_x, of_b = _reached(self.walker, first, last, goes, every, decide, split)
                weighted = _unpacked(of_b, m) * self.walker.length[leaves, None]
                for k in range(0, n, 64):
                    here = np.flatnonzero(of_x[:, k >> 6])
                    own = _unpacked(of_x[here, k >> 6, None], min(64, n - k))
                    paths[c, k : k + 64] += own.T @ weighted[here]
        return raw_score(paths, len(self.walker.roots), self.sample_size).mean(axis=2).T

    def _parts(self) -> list:
        """Ranges of nodes, whole trees each, of about ``NODES_AT_ONCE`` nodes."""
        out, first, ends = [], 0, [*self.walker.roots[1:].tolist(), len(self.walker.child)]
        for end, following in zip(ends, [*ends[1:], np.inf]):
            if following - first > NODES_AT_ONCE:
                out.append((first, end))
                first = end
        return out


def alike(rows: np.ndarray, most: int = 64) -> np.ndarray:
    """An order of ``rows`` in which each ``most`` in turn lie close to each other: halves by the feature of the widest spread."""
    todo, out = [np.arange(len(rows))], []
    while todo:
        own = todo.pop()
        if len(own) <= most:
            out.append(own)
            continue
        part = rows[own]
        middle = most * (-(-len(own) // most) // 2)
        own = own[np.argpartition(part[:, np.nan_to_num(part).std(axis=0).argmax()], middle)]
        todo += [own[middle:], own[:middle]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _packed(flags: np.ndarray) -> np.ndarray:
    """Flags (cells, rows) as words of 64 rows each."""
    bytes_of = np.packbits(flags, axis=1, bitorder="little")
    words = np.zeros((len(flags), -(-flags.shape[1] // 64) * 8), np.uint8)
    words[:, : bytes_of.shape[1]] = bytes_of
    return words.view(np.uint64)


def _unpacked(words: np.ndarray, n: int) -> np.ndarray:
    """Words of 64 rows each as numbers 0 and 1 (cells, rows)."""
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, count=n, bitorder="little").astype(float)


def _right(walker: Walker, first: int, last: int, rows: np.ndarray) -> np.ndarray:
    """(nodes, words): which ``rows`` go right at each of the nodes ``first`` to ``last``, leaves aside."""
    columns, inner = np.ascontiguousarray(rows.T), first + np.flatnonzero(walker.child[first:last] >= 0)
    out = np.zeros((last - first, -(-len(rows) // 64)), np.uint64)
    for own in np.array_split(inner, max(1, len(inner) * len(rows) >> 20)):
        out[own - first] = _packed(columns[walker.feature[own]] > walker.threshold[own, None])
    return out


def _reached(walker: Walker, first: int, last: int, goes: np.ndarray, rows: np.ndarray, decide: np.ndarray, split: int):
    """Leaves among the nodes ``first`` to ``last`` that rows of both tables reach, and which.

    ``goes`` has the words of both tables, ``split`` of the first one, and ``rows`` those of all
    rows. ``decide`` has for each feature the words that are divided between a node's children;
    the others go to both.
    """
    at = walker.roots[(walker.roots >= first) & (walker.roots < last)]
    here, found = np.repeat(rows, len(at), axis=0), []
    while len(at):
        inner = walker.child[at] >= 0
        if not inner.all():
            found.append((at[~inner], here[~inner]))
            at, here = at[inner], here[inner]
        k, divided = len(at), decide[walker.feature[at]]
        below = np.empty((2 * k, here.shape[1]), np.uint64)
        np.bitwise_and(goes[at - first], divided, out=below[:k])
        np.bitwise_and(here, below[:k], out=below[k:])
        np.bitwise_xor(here, below[k:], out=below[:k])
        below[k:] |= here & ~divided
        at = np.concatenate([walker.child[at], walker.child[at] + 1])
        alive = np.flatnonzero(below[:, :split].any(axis=1) & below[:, split:].any(axis=1))
        at, here = at[alive], below[alive]
    at, here = (np.concatenate(x) for x in zip(*found))
    return at, here[:, :split], here[:, split:]


def score_forest(rows: DataFrame, forest: Forest, name: str = "raw_score", limit: int = BROADCAST_NODES) -> DataFrame:
    """Add the raw anomaly score (higher = more anomalous).

    Rows never move. Up to ``limit`` nodes the model is broadcast as a whole; a larger one is
    broadcast in chunks of trees, one pass over the stored rows after the other, each adding
    its path lengths. Equal sums of paths are added in the order of the trees either way.
    """
    n_nodes = forest.nodes.count()
    n_trees = forest.nodes.agg(F.max("tree")).first()[0] + 1
    per_chunk = max(1, min(n_trees, int(limit * n_trees / max(n_nodes, 1))))
    names = [free(n, rows) for n in ("_x", "_path")]
    x, path = names
    current = vectors(rows, forest.columns, x).withColumn(path, F.lit(0.0))
    for first in range(0, n_trees, per_chunk):
        own = forest.nodes.filter((F.col("tree") >= first) & (F.col("tree") < first + per_chunk))
        walk = _path_udf(rows.sparkSession.sparkContext.broadcast(Walker(own.toPandas())))
        current = (stored(current) if first else current).withColumn(path, walk(x, path))
    scale = max(float(average_path(forest.sample_size)), 1e-12)
    raw = F.pow(F.lit(2.0), -F.col(path) / n_trees / scale) - 0.5
    return current.withColumn(name, raw).drop(*names)


def free(name: str, df: DataFrame) -> str:
    """``name`` with underscores before it until it is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def _path_udf(shared):
    @F.pandas_udf("double")
    def walk(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        walker = shared.value
        for x, before in batches:
            pieces = [np.stack(x.iloc[i : i + 1024].to_list()) for i in range(0, len(x), 1024)]
            total = np.concatenate([walker.total_path(p) for p in pieces]) if pieces else np.zeros(0)
            yield before + total

    return walk


def forest_label(score: str = "raw_score") -> Column:
    """The model's own cut-off: anomalous above a raw score of zero."""
    return decide(F.col(score), 0.0, strict=True)
