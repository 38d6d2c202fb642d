"""Near-duplicates by MinHash with tensored banding and exact confirmation.

Two small collections of ``SIDE`` hashes are made for every distinct shingle set, each hash
combining ``ROWS`` minhashes. A table key is a pair of one hash from each collection, so
SIDE x SIDE tables of 2 x ROWS minhashes cost 2 x SIDE x ROWS minhashes instead of
SIDE x SIDE x 2 x ROWS. A pair with similarity s shares a table unless one whole collection
differs: at most 2 (1 - s**ROWS)**SIDE, 4e-4 at 0.8 and 2e-5 at 0.85.

Equal sets are one node. Nodes that share a table are confirmed on their full sets. Each
node is first held against the node it shares most tables with as that table's smallest,
then the two of every table of two that still lie in different components. Larger tables
with several components are worked on in turns, and at last every pair of different
components that shares a table is met once, under the first hash of the first collection
that it shares, so every such pair is confirmed, refused or already connected.
"""

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blocklens.functions.scale import checkpointed
from blocklens.llm.words import lean, mixed, release, slices, split_words, text_numbers

SIDE, ROWS = 12, 3
FILTER_BITS = 1 << 23
#: A turn that leaves more than this share of the nodes outside is the last one.
SLOW = 0.85
HUBS = 4
#: 64-bit words of a set's parities.
WORDS = 16
#: A shingle of more nodes than this is a common one.
RARE = 8
#: Text bytes worked on at a time.
BLOCK = 4 << 20
#: Shingles whose minhashes are made together, so that they stay in a core's cache.
KEYS_AT_ONCE = 1 << 15
#: Rows of keys that one task sorts in memory.
TASK_KEYS = 2_000_000
#: Partitions for each core that small steps are strung to.
FILES = 4
#: Links that one task connects in memory (16 MB); more are connected in rounds of joins.
LOCAL_LINKS = 1 << 20
#: The most bytes of a table that joins here may broadcast: the driver holds a few copies of each for a while.
BROADCAST = 1 << 20


def strung(df: DataFrame) -> DataFrame:
    """``df`` in at most ``FILES`` partitions for each core, strung together without a shuffle.

    Steps here are many and mostly small: starting Python on a partition, or writing and reading
    a file of it, costs more than its rows do. A task works through its partitions one after the other.
    """
    return df.coalesce(FILES * df.sparkSession.sparkContext.defaultParallelism)


def kept(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in few files: a checkpoint has one for each partition, and its readers a task for each.

    The driver's memory of the step is given back at once, as the next one would add to it.
    """
    out = checkpointed(strung(df))
    release(df.sparkSession)
    return out


@contextmanager
def small_broadcasts(spark):
    """Joins planned inside broadcast tables of at most ``BROADCAST`` bytes by themselves, or less where the session says so."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    bytes_of = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    try:
        if not before.startswith("-") and bytes_of(before) > BROADCAST:
            spark.conf.set(name, BROADCAST)
        yield
    finally:
        spark.conf.set(name, before)


def word_numbers(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each distinct word, A-Z lower-cased."""
    import pandas as pd

    return pd.util.hash_array(pc.ascii_lower(distinct).to_numpy(zero_copy_only=False), categorize=False).astype(np.uint64)


def shingles(texts: pa.Array, width: int):
    """Sorted distinct shingle hashes of all texts in one array, and n + 1 offsets.

    A text with fewer words than ``width`` has one shingle, all its words; one without words has none.
    """
    codes, starts, distinct = split_words(texts)
    n = len(starts) - 1
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    word, doc = word_numbers(distinct)[codes], text_numbers(starts)
    size = np.diff(starts)
    length = np.minimum(size, width)[doc]  # words in this text's shingles
    at = np.flatnonzero(np.arange(len(codes)) + length <= starts[1:][doc])
    key, least = mixed(length[at].astype(np.uint64)), length[at].min()
    for k in range(width):
        longer = mixed(key ^ word[np.minimum(at + k, len(word) - 1)], k + 1)
        key = longer if k < least else np.where(k < length[at], longer, key)
    owner = doc[at]
    cuts = np.searchsorted(owner, np.arange(n + 1))
    own = [np.unique(key[a:b]) for a, b in zip(cuts, cuts[1:])]
    return np.concatenate(own) if own else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)


def collections(keys: np.ndarray, starts: np.ndarray, side=SIDE, rows=ROWS) -> np.ndarray:
    """For every set 2 x ``side`` hashes, each of ``rows`` minhashes; sets must not be empty."""
    n = len(starts) - 1
    out = np.zeros((n, 2 * side), np.uint64)
    # Some sets at a time, so that their keys stay in the cache for all hashes.
    part = starts[:-1] // KEYS_AT_ONCE
    cuts = np.flatnonzero(np.diff(part)) + 1
    for first, end in zip([0, *cuts], [*cuts, n]) if n else ():
        own, begin = keys[starts[first] : starts[end]], starts[first:end] - starts[first]
        for j in range(2 * side):
            for r in range(rows):
                low = np.minimum.reduceat(mixed(own, 100 + j * rows + r), begin)
                out[first:end, j] = mixed(out[first:end, j] ^ low, r)
    return out


def signed(df: DataFrame, text: str, width: int, id_col: str) -> DataFrame:
    """One row per document: id, n_shingles, node (128 bits of the whole set, null if empty) and its hashes."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text", BLOCK, tidy=True):
                keys, starts = shingles(part.column("_text"), width)
                size = np.diff(starts)
                full = size > 0
                begin = starts[:-1][full]
                hashes = collections(keys, np.append(begin, len(keys)))
                node, sig, k = [None] * len(size), [None] * len(size), 0
                with np.errstate(over="ignore"):
                    low = np.add.reduceat(mixed(keys, 7), begin) if len(begin) else []
                    high = np.add.reduceat(mixed(keys, 8), begin) if len(begin) else []
                for i in np.flatnonzero(full):
                    node[i] = int(low[k]).to_bytes(8, "big") + int(high[k]).to_bytes(8, "big")
                    sig[i] = hashes[k].tobytes()
                    k += 1
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(size), pa.array(node, pa.binary()), pa.array(sig, pa.binary())], names=["id", "n_shingles", "node", "sig"])

    return df.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).mapInArrow(lean(run), f"id {kind}, n_shingles long, node binary, sig binary")


def key_batches(batches, extra=(), side=SIDE):
    """The SIDE x SIDE table keys of every node of ``batches``: arrays key, nid and the extra columns."""
    i, j = (x.ravel() for x in np.meshgrid(np.arange(side), side + np.arange(side), indexing="ij"))
    table = mixed((i * side + j).astype(np.uint64), 3)
    for batch in batches:
        for k in range(0, batch.num_rows, 4096):
            part = batch.slice(k, 4096)
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint64).reshape(-1, 2 * side)
            key = mixed(sig[:, i] ^ mixed(sig[:, j], 1), 2) ^ table
            yield key.ravel().view(np.int64), *[np.repeat(part.column(c).to_numpy(), side * side) for c in ("nid", *extra)]


def table_keys(nodes: DataFrame) -> DataFrame:
    """(key, nid, comp) for every table of every node."""

    def run(batches):
        for made in key_batches(batches, ["comp"]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["key", "nid", "comp"])

    return strung(nodes.select("nid", "sig", "comp")).mapInArrow(lean(run), "key long, nid long, comp long")


def with_smallest(key: np.ndarray, nid: np.ndarray):
    """Rows sorted by key, each with the smallest nid of its key."""
    order = np.argsort(key)
    key, nid = key[order], nid[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    if not len(key):
        return key, nid, nid
    return key, nid, np.repeat(np.minimum.reduceat(nid, begin), np.diff(np.append(begin, len(key))))


def stars(nodes: DataFrame, parts: int) -> DataFrame:
    """(pivot, nid, n): each table's smallest node with each other one, and in how many tables.

    Within a batch of nodes only a table's smallest goes on to the table; for the others the
    pair is known at once. So a table that holds a third of all nodes gets a row for each batch.
    """

    def local(batches):
        for key, nid in key_batches(batches):
            key, nid, pivot = with_smallest(key, nid)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(nid), pa.array(pivot, mask=nid == pivot)], names=["key", "nid", "pivot"])

    def merge(batches):
        rows = [(b.column("key").to_numpy(), b.column("nid").to_numpy(), pc.fill_null(b.column("pivot"), -1).to_numpy()) for b in batches]
        if not rows:
            return
        key, nid, pivot = (np.concatenate(x) for x in zip(*rows))
        star = pivot >= 0
        key, node, top = with_smallest(key[~star], nid[~star])
        other = node != top
        a, b = np.concatenate([pivot[star], top[other]]), np.concatenate([nid[star], node[other]])
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)])
        n = np.diff(np.append(new, len(a)))
        a, b = a[new], b[new]
        yield pa.RecordBatch.from_arrays([pa.array(x[a != b]) for x in (a, b, n)], names=["pivot", "nid", "n"])

    dealt = nodes.select("nid", "sig").mapInArrow(lean(local), "key long, nid long, pivot long")
    dealt = dealt.repartition(parts, "key", F.when(F.col("pivot").isNotNull(), F.col("nid")))
    return dealt.mapInArrow(lean(merge), "pivot long, nid long, n long").groupBy("pivot", "nid").agg(F.sum("n").alias("n"))


def bit_filter(ids: DataFrame, column: str):
    """A bit set of ``FILTER_BITS`` bits, whatever the number of ids; a superset test."""
    def gather(batches):
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            place = (mixed(batch.column(column).to_numpy().view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)
            np.bitwise_or.at(bits, place >> 3, (1 << (place & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()])], names=["bits"])

    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in ids.select(column).coalesce(8).mapInArrow(gather, "bits binary").toLocalIterator():
        bits |= np.frombuffer(bytes(row["bits"]), np.uint8)
    return bits


def full_sets(df, text, width, id_col, wanted) -> DataFrame:
    """(node, full): whole shingle sets of the documents whose id's hash may be wanted; the others' are not made again."""
    shared = df.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        bits = shared.value
        for batch in batches:
            place = (mixed(batch.column("_id").to_numpy().view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)
            batch = batch.filter(pa.array((bits[place >> 3] & (1 << (place & 7)).astype(np.uint8)) > 0))
            for part in slices(batch, "_text", BLOCK, tidy=True):
                keys, starts = shingles(part.column("_text"), width)
                begin = starts[:-1][np.diff(starts) > 0]
                if not len(begin):
                    continue
                ends = np.append(begin[1:], len(keys))
                with np.errstate(over="ignore"):
                    low, high = np.add.reduceat(mixed(keys, 7), begin), np.add.reduceat(mixed(keys, 8), begin)
                node = [int(x).to_bytes(8, "big") + int(y).to_bytes(8, "big") for x, y in zip(low, high)]
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array([keys[x:y].tobytes() for x, y in zip(begin, ends)], pa.binary())], names=["node", "full"])

    return df.select(F.xxhash64(id_col).alias("_id"), F.col(text).alias("_text")).mapInArrow(lean(run), "node binary, full binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes with 100 x intersection >= ``percent`` x union on their full sets."""
    left = pairs.join(sets.select(F.col("nid").alias("b"), F.col("full").alias("full_b")), "b")
    both = left.join(sets.select(F.col("nid").alias("a"), F.col("full").alias("full_a")), "a").select("a", "b", "full_a", "full_b")

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("full_a"), batch.column("full_b"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                merged = np.concatenate([x, y])
                merged.sort()
                common = int((merged[1:] == merged[:-1]).sum())
                keep[i] = 100 * common >= percent * (len(merged) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return strung(both).mapInArrow(lean(run), "a long, b long")


def connected(a: np.ndarray, b: np.ndarray):
    """The nodes of the links (a, b), sorted, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        # Of two labels that meet the larger one's node takes the smaller; then labels are followed to their ends.
        x, y = low[a], low[b]
        if (x == y).all():
            return nodes, nodes[low]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(low, low[low]):
            low = low[low]


def few_components(links: DataFrame) -> DataFrame:
    """What ``components`` returns, made by one task: for links that fit its memory."""

    def run(batches):
        rows = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in connected(*(np.concatenate(x) for x in zip(*rows)))], names=["nid", "comp"])

    return kept(links.filter("a <> b").select("a", "b").coalesce(1).mapInArrow(lean(run), "nid long, comp long"))


def components(links: DataFrame) -> DataFrame:
    """(nid, comp): smallest node reachable over ``links`` (a, b); nodes without links are left out.

    Every round a node takes the smallest label of its neighbours and then the label of its
    label; rounds are stored, and end when nothing changes. A node is a neighbour of itself, so
    one join tells its own label and those of the others.
    """
    ways = [F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x in "ab" for y in "ab"]
    edges = kept(links.filter("a <> b").select(F.inline(F.array(*ways))).distinct())
    labels = kept(edges.groupBy(F.col("a").alias("nid")).agg(F.min("b").alias("comp")))
    while True:
        own = F.max(F.when(F.col("a") == F.col("b"), F.col("comp"))).alias("old")
        step = edges.join(labels.withColumnRenamed("nid", "b"), "b").groupBy(F.col("a").alias("nid")).agg(own, F.min("comp").alias("mid"))
        jump = labels.select(F.col("nid").alias("mid"), F.col("comp").alias("far"))
        step = kept(step.join(jump, "mid", "left").select("nid", "old", F.least("mid", "far").alias("comp")))
        changed = step.filter("old <> comp").head(1)
        labels = step.select("nid", "comp")
        if not changed:
            return labels


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after the components that ``links`` (stored) connect have become one.

    Up to ``LOCAL_LINKS`` links are connected by one task: a few jobs instead of some for each round.
    """
    n = links.count()
    if not n:
        return labels
    ends = links.join(labels.select(F.col("nid").alias("a"), F.col("comp").alias("x")), "a")
    ends = ends.join(labels.select(F.col("nid").alias("b"), F.col("comp").alias("y")), "b")
    connect = few_components if n <= LOCAL_LINKS else components
    merged = connect(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
    merged = merged.select(F.col("nid").alias("comp"), F.col("comp").alias("_to"))
    return kept(labels.join(merged, "comp", "left").select("nid", F.coalesce("_to", "comp").alias("comp")))


def outside(inside: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """(key, nid, h0, h1, ...): nodes outside their table's main component, and some members of that.

    The main component has most nodes of the table, the hubs are its members with the smallest
    of ``HUBS`` hashes, which are others in each turn.
    """
    tagged = inside.join(labels, "nid")
    hubs = [f"h{k}" for k in range(HUBS)]
    by_comp = tagged.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), *[F.min(F.struct(F.xxhash64(F.lit(turn * HUBS + k), "nid").alias("h"), "nid")).alias(h) for k, h in enumerate(hubs)])
    tables = by_comp.groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("n", "comp", *[F.col(h).nid.alias(h) for h in hubs])).alias("top"))
    tables = tables.filter("comps > 1").select("key", F.col("top.comp").alias("main"), *[f"top.{h}" for h in hubs])
    return kept(tagged.join(tables, "key").filter("comp <> main").select("key", "nid", *hubs))


def mixed_links(nodes: DataFrame, sets: DataFrame, labels: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Labels once every pair that shares a table is confirmed, refused or connected.

    Tables with two components or more are left over. The two nodes of a table of two are held
    against each other, unless they are one of the pairs (a, b) of ``held``, which were before.
    In turns, each node outside a larger table's main component is held
    against hubs it shares many tables with, and what is confirmed becomes one component,
    so that large groups shrink to one. When a turn changes little, each node outside is held
    against every node of other components that shares a table with it and that their counts
    of common shingles do not rule out (``possible_pairs``).
    """
    keys = table_keys(nodes.join(labels, "nid"))
    by_comp = keys.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.min("nid").alias("nid"))
    tables = by_comp.groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.sum("n").alias("nodes"), F.min("nid").alias("a"), F.max("nid").alias("b"))
    tables = kept(tables.filter("comps > 1"))
    inside = kept(keys.join(tables.filter("nodes > 2").select("key"), "key").select("key", "nid"))
    # One pair for a table of two, so no more pairs than tables; their links join with those of the first turn.
    twos = tables.filter("nodes = 2").select("a", "b").distinct().join(held, ["a", "b"], "left_anti")
    before, turn = None, 0
    while True:
        rest = outside(inside, labels, turn)
        left = rest.count()
        if not left:
            return labels if turn else joined(labels, kept(confirmed(twos, sets, percent)))
        if before is not None and left > SLOW * before:
            break
        # Of each kind of hub the one that a node shares most tables with: HUBS pairs for a node.
        most = rest.groupBy("nid").agg(*[F.mode(f"h{k}").alias(f"h{k}") for k in range(HUBS)])
        best = most.select(F.explode(F.array_distinct(F.array(*[f"h{k}" for k in range(HUBS)]))).alias("a"), F.col("nid").alias("b"))
        best = best if turn else best.union(twos).distinct()
        labels = joined(labels, kept(confirmed(best, sets, percent)))
        before, turn = left, turn + 1
    pairs = kept(possible_pairs(nodes, rest, inside, labels, sets, percent))
    return joined(labels, kept(confirmed(pairs, sets, percent)))


def items_of(sets: DataFrame) -> DataFrame:
    """(nid, item): the shingle hashes of full sets."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                full = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("full")]
                nid = np.repeat(part.column("nid").to_numpy(), [len(x) for x in full])
                yield pa.RecordBatch.from_arrays([pa.array(nid), pa.array(np.concatenate(full))], names=["nid", "item"])

    return strung(sets.select("nid", "full")).mapInArrow(lean(run), "nid long, item long")


def parities(sets: DataFrame) -> DataFrame:
    """(nid, p0, p1, ...): for every set WORDS x 64 bits, each the parity of how many shingles hash to it.

    One shingle more or less flips one bit, so two sets differ in at least as many shingles as
    their parities differ in bits: an exact bound, whatever the sets.
    """
    names = ["nid", *[f"p{k}" for k in range(WORDS)]]

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                full = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("full")]
                row = np.repeat(np.arange(len(full)), [len(x) for x in full])
                place = (mixed(np.concatenate(full), 9) % np.uint64(64 * WORDS)).astype(np.int64)
                odd = (np.bincount(row * 64 * WORDS + place, minlength=len(full) * 64 * WORDS) & 1).astype(np.uint8)
                words = np.packbits(odd.reshape(len(full), -1), axis=1, bitorder="little").view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("nid"), *[pa.array(words[:, k].copy()) for k in range(WORDS)]], names=names)

    return strung(sets.select("nid", "full")).mapInArrow(lean(run), ", ".join(f"{n} long" for n in names))


def sketches(sets: DataFrame) -> DataFrame:
    """(nid, size, marks): of every set the size, and parities as in ``parities`` of at least as many hashes as twice its shingles.

    The number of bits is a power of two, so a longer one is folded to the length of a shorter one.
    """

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                size, marks = [], []
                for x in part.column("full"):
                    full = np.frombuffer(x.as_buffer(), np.uint64)
                    bits = max(64 * WORDS, 1 << (2 * len(full) - 1).bit_length())
                    odd = np.bincount((mixed(full, 9) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
                    size.append(len(full))
                    marks.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
                yield pa.RecordBatch.from_arrays([part.column("nid"), pa.array(size, pa.int64()), pa.array(marks, pa.binary())], names=["nid", "size", "marks"])

    return strung(sets.select("nid", "full")).mapInArrow(lean(run), "nid long, size long, marks binary")


def least_apart(x: np.ndarray, y: np.ndarray) -> int:
    """In how many shingles two sets differ at least, by the words of their ``sketches``."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def close_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) that ``sketches`` do not rule out.

    They have a bit or more for each shingle, so that sets of any size are told apart, and are
    a sixteenth as long as the sets, which go only with the pairs that are left.
    """
    marks = kept(sketches(sets))
    for x in "ba":
        pairs = pairs.join(marks.select(F.col("nid").alias(x), F.col("size").alias(f"size_{x}"), F.col("marks").alias(f"marks_{x}")), x)

    def run(batches):
        for batch in batches:
            sizes = [batch.column(f"size_{x}").to_numpy() for x in "ab"]
            marks = zip(*(batch.column(f"marks_{x}") for x in "ab"))
            apart = np.array([least_apart(*(np.frombuffer(m.as_buffer(), np.uint64) for m in both)) for both in marks], np.int64)
            apart = np.maximum(apart, np.abs(sizes[0] - sizes[1]))
            yield batch.select(["a", "b"]).filter(pa.array((100 + percent) * apart <= (100 - percent) * (sizes[0] + sizes[1])))

    return strung(pairs.select("a", "b", "size_a", "size_b", "marks_a", "marks_b")).mapInArrow(lean(run), "a long, b long")


def first_hashes(nodes: DataFrame, name: str, keep, side=SIDE) -> DataFrame:
    """(i, h, and for ``name``: the hashes s0, s1, ... and the columns ``keep``): a row for each hash of the first collection of every node."""
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    names = ["i", "h", *[f"{name}_s{k}" for k in range(2 * side)], *[f"{name}_{c}" for c in keep]]

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.int64).reshape(-1, 2 * side)
                place = pa.array(np.repeat(np.arange(part.num_rows), side))
                hashes = [pa.array(np.repeat(sig[:, k], side)) for k in range(2 * side)]
                i = pa.array(np.tile(np.arange(side, dtype=np.int32), part.num_rows))
                yield pa.RecordBatch.from_arrays([i, pa.array(sig[:, :side].ravel()), *hashes, *[part.column(c).take(place) for c in keep]], names=names)

    types = ["int", "long", *["long"] * (2 * side), *[kinds[c] for c in keep]]
    return nodes.select("sig", *keep).mapInArrow(lean(run), ", ".join(f"{n} {t}" for n, t in zip(names, types)))


def possible_pairs(nodes: DataFrame, rest: DataFrame, inside: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of an outside node and one of another component that may be linked, and no others.

    Shingles of more than ``RARE`` of the nodes are common. Two nodes either share a rare
    shingle, which few nodes do, or have nothing but common ones in common: then the smaller
    count of common shingles bounds their intersection (plus the rare ones they share), and
    most pairs fall short of the threshold by these counts alone. Others do by the number of
    shingles in which they differ at least (``parities``). No pair that could be linked is left out.
    """
    sigs = nodes.select("nid", "sig")
    near = inside.join(rest.select("key").distinct(), "key")
    there = kept(near.select("nid").distinct().join(labels, "nid"))
    items = kept(items_of(sets.join(there.select("nid"), "nid", "left_semi")))
    counts = items.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    rare = kept(items.join(counts.filter(F.col("n") <= RARE), "item"))
    sizes = items.groupBy("nid").agg(F.count(F.lit(1)).alias("size")).join(rare.groupBy("nid").agg(F.count(F.lit(1)).alias("few")), "nid", "left")
    sizes = (there.join(sizes, "nid").select("nid", "comp", "size", (F.col("size") - F.coalesce("few", F.lit(0))).alias("common")))
    out = rest.select("nid").distinct().withColumn("out", F.lit(True))
    sizes = kept(sizes.join(out, "nid", "left").withColumn("out", F.coalesce("out", F.lit(False))))

    def side(rows, name, *keep):
        return rows.select(*keep, *[F.col(c).alias(f"{name}_{c}") for c in ("nid", "comp", "size", "common", "out")])

    def enough(few):
        """Whether common shingles and ``few`` rare ones shared can reach the threshold."""
        most = F.least("x_common", "y_common") + few
        return (100 + percent) * most >= percent * (F.col("x_size") + F.col("y_size"))

    # Sharing rare shingles: at most RARE nodes for each.
    shared = rare.filter("n > 1").select("item", "nid").join(sizes, "nid")
    x = side(shared.filter("out"), "x", "item")
    met = x.join(side(shared, "y", "item"), "item").filter("x_comp <> y_comp AND (x_nid < y_nid OR NOT y_out)")
    met = met.groupBy(*[f"{k}_{c}" for k in "xy" for c in ("nid", "size", "common")]).agg(F.count(F.lit(1)).alias("few"))
    by_item = met.filter(enough(F.col("few")))
    # Sharing a table, and common shingles enough for the threshold. Two nodes share a table if
    # they share a hash of each collection; they meet under the first of the first collection, once.
    bits = parities(sets.join(there.select("nid"), "nid", "left_semi"))
    held = kept(sizes.join(sigs, "nid").join(bits, "nid"))
    keep = ["nid", "comp", "size", "common", "out", *[f"p{k}" for k in range(WORDS)]]
    x, y = first_hashes(held.filter("out"), "x", keep), first_hashes(held, "y", keep)
    same = lambda k: F.col(f"x_s{k}") == F.col(f"y_s{k}")
    fresh, second = F.lit(True), F.lit(False)
    for k in range(SIDE):
        fresh, second = fresh & ((x["i"] <= k) | ~same(k)), second | same(SIDE + k)
    apart = (F.col("x_comp") != F.col("y_comp")) & ((F.col("x_nid") < F.col("y_nid")) | ~F.col("y_out"))
    differ = sum((F.bit_count(F.col(f"x_p{k}").bitwiseXOR(F.col(f"y_p{k}"))) for k in range(1, WORDS)), F.bit_count(F.col("x_p0").bitwiseXOR(F.col("y_p0"))))
    # At the threshold two sets differ in (100 - percent) / (100 + percent) of the sum of their sizes.
    close = (100 + percent) * differ <= (100 - percent) * (F.col("x_size") + F.col("y_size"))
    by_hash = x.join(y, (x["i"] == y["i"]) & (x["h"] == y["h"]) & apart & enough(F.lit(0)) & close & fresh & second)
    ends = [F.least("x_nid", "y_nid").alias("a"), F.greatest("x_nid", "y_nid").alias("b")]
    pairs = kept(by_item.select(*ends).union(by_hash.select(*ends)).distinct())
    return close_pairs(pairs, sets.join(there.select("nid"), "nid", "left_semi"), percent)


def node_components(df: DataFrame, rows: DataFrame, text: str, width: int, percent: int, id_col: str) -> DataFrame:
    """(node, component_id) for every distinct set of ``rows``, what ``signed`` makes of ``df``."""
    spark = rows.sparkSession
    # One row per distinct set; nid is fixed by the stored table.
    nodes = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("first_id"), F.first("sig").alias("sig"))
    nodes = kept(nodes.withColumn("nid", F.monotonically_increasing_id()))
    total = nodes.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * SIDE * SIDE // TASK_KEYS))
    candidates = kept(stars(nodes, parts))
    best = candidates.groupBy("nid").agg(F.max_by("pivot", F.struct("n", -F.col("pivot"))).alias("pivot"))
    first = best.select(F.col("pivot").alias("a"), F.col("nid").alias("b"))
    wanted = candidates.select("nid").union(candidates.select("pivot")).distinct().join(nodes.select("nid", "node", "first_id"), "nid")
    wanted = kept(wanted)
    # A document with the first id of a node holds its set; ids may repeat, and all may be null.
    ids = wanted.select(F.xxhash64("first_id").alias("id"))
    found = full_sets(df, text, width, id_col, bit_filter(ids, "id")).groupBy("node").agg(F.first("full").alias("full"))
    sets = kept(found.join(wanted.select("node", "nid"), "node").select("nid", "full"))
    ids = wanted.select("nid", F.col("nid").alias("comp"))
    labels = joined(ids, kept(confirmed(first, sets, percent)))
    labels = mixed_links(nodes, sets, labels, first, percent)
    final = nodes.join(labels, "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))
    least = final.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    return kept(final.join(least, "comp").select("node", "component_id"))


def group(df: DataFrame, id_col="doc_id", text="text", width=5, percent=80) -> DataFrame:
    """One row per row of ``df``: id, n_shingles, component_id, kept.

    Words are runs without ASCII white space with A-Z lower-cased; documents are linked if
    100 x intersection >= ``percent`` x union of their sets of ``width``-word shingles.
    component_id is the smallest id reachable, itself included, and ``kept`` says that it is
    the row's own. Texts without words (or null) are linked with nothing. Rows with a null id
    take part and are kept only if their component holds no id. Repeated rows are equal sets.
    """
    rows = checkpointed(signed(df, text, width, id_col))
    with small_broadcasts(df.sparkSession):
        by_node = node_components(df, rows, text, width, percent, id_col)
    out = rows.join(by_node, "node", "left").select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.col("component_id").isNull()))
