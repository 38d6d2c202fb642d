"""Prefix trie of conversations by whole-sequence collapse.

Identical conversations become one weighted sequence with a list of its ends. Prefixes are
made for distinct sequences only, and every prefix is named by a sum over its turns of hashes
of (place, turn), so names come from running totals and no conversation has to fit a task.
Sequences that are proper prefixes of others are dropped by anti-join; what is left are the
leaves. Nodes are the weighted prefixes, aggregated by name.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocklens.functions.scale import checkpointed, global_rank, lookup_join, running_totals
from blocklens.llm.words import spread_join

#: A rebuilt conversation begins with up to HEADS - 1 turns of the first of its HUNDRED.
HEADS, HUNDRED = 6, 100
LANES = ("s0", "s1", "s2", "s3")
#: Ends of a node go to its digest in pieces of about so many bytes.
PIECE = 1 << 20


def turn_digest(role: Column, text: Column) -> Column:
    """A digest of a turn: of the role's length, the role and the text, null as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))


def numbered(df: DataFrame, id_col="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """(conv, at, digest, chars): turns numbered from 1 in their order (null first, ties by digest)."""
    rows = df.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("conv"), F.col(turn).alias("turn"), turn_digest(F.col(role), F.col(text)).alias("digest"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("chars")
    )
    return global_rank(rows, [F.col("turn").asc_nulls_first(), "digest"], ["conv"], "at").select("conv", "at", "digest", "chars")


def rebuilt(turns: DataFrame):
    """All conversations, (conv), and their turns once rebuilt, (conv, depth, digest, chars).

    A conversation c takes the first h = crc32(c) % 6 turns of conversation c - c % 100, all
    if that has fewer, none if it is absent, and then its own turns after its first h.
    """
    counts = checkpointed(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")))
    head = lambda c: F.crc32(c.cast("string")) % HEADS
    base = lambda c: c - c % HUNDRED
    convs = counts.select("conv", base(F.col("conv")).alias("base"), head(F.col("conv")).alias("h"))
    heads = turns.filter((base(F.col("conv")) == F.col("conv")) & (F.col("at") < HEADS))
    heads = heads.select(F.col("conv").alias("base"), "at", "digest", "chars")
    taken = convs.join(heads, "base").filter("at <= h").select("conv", F.col("at").alias("depth"), "digest", "chars")
    # Most bases have enough turns; the others, or their absence, move own turns forward.
    first = convs.select("base").distinct().join(counts.select(F.col("conv").alias("base"), "n"), "base", "left")
    short = first.select("base", F.coalesce("n", F.lit(0)).alias("n")).filter(F.col("n") < HEADS - 1)
    own = turns.withColumns({"base": base(F.col("conv")), "h": head(F.col("conv"))}).filter("at > h")
    own = lookup_join(own, checkpointed(short), "base")
    depth = F.col("at") - F.col("h") + F.least(F.col("h"), F.coalesce("n", F.col("h")))
    return counts.select("conv"), taken.unionByName(own.select("conv", depth.alias("depth"), "digest", "chars"))


def lanes() -> dict:
    """Hashes of (depth, digest) in 32-bit pieces: their sums name a prefix and stay far below 64 bits."""
    halves = [F.xxhash64(F.lit(seed), F.col("depth"), F.col("digest")) for seed in (1, 2)]
    pieces = [p for h in halves for p in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]
    return dict(zip(LANES, pieces))


def name(depth: Column, sums) -> Column:
    """The key of a node: 16 bytes for its depth and the sums over its turns."""
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums])))


def ends_digest(ends: DataFrame, piece_bytes: int = PIECE) -> DataFrame:
    """(key, ends_sha256): SHA-256 of each key's ids ascending, comma-joined; ``ends`` has (key, conv).

    Ids are sorted in ranges and joined to pieces there, so a key with a third of all ids is
    spread over tasks. Its digest is one sequence by definition: one task streams the key's
    pieces in order and holds one piece at a time.
    """
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pieces(batches):
        key, ids, first, size = None, [], None, 0

        def piece():
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(ids)])], names=["key", "first", "ids"])

        for batch in batches:
            for k, c in zip(batch.column("key").to_pylist(), batch.column("conv").to_pylist()):
                if ids and (k != key or size > piece_bytes):
                    yield piece()
                    ids, size = [], 0
                if not ids:
                    key, first = k, c
                ids.append(str(c))
                size += len(ids[-1]) + 1
        if ids:
            yield piece()

    def digests(batches):
        key, state = None, None
        for batch in batches:
            done = []
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if state is not None and k == key:
                    state.update(b",")
                else:
                    if state is not None:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield table(done)
        if state is not None:
            yield table([(key, state.hexdigest())])

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.binary(), pa.string()))], names=["key", "ends_sha256"])

    ordered = ends.select("key", F.col("conv").cast("long").alias("conv")).repartitionByRange(parts, "key", "conv").sortWithinPartitions("key", "conv")
    joined = ordered.mapInArrow(pieces, "key binary, first long, ids string")
    return joined.repartition(parts, "key").sortWithinPartitions("key", "first").mapInArrow(digests, "key binary, ends_sha256 string")


def trie(df: DataFrame, id_col="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """One row per node of the trie of rebuilt conversations (``rebuilt``).

    A node is a distinct sequence of the first d turns (role, text); the root has d = 0.
    Columns: conv_id (its smallest member), depth, parent_conv_id (null for the root), n_convs
    (members), n_children, n_leaves (childless nodes in its subtree), saved_tokens (over its
    subtree, members beyond the first times code points of the last text) and ends_sha256 (of
    the ids of the members that end here).

    Ids are whole numbers; rows with a null id take no part. Null roles and texts are empty,
    null turns come first, equal turn numbers are ordered by the turn's digest, and repeated
    rows are turns of their own. Without a conversation there is no node, not even the root.
    Other columns are ignored.
    """
    turns = checkpointed(numbered(df, id_col, turn, role, text))
    convs, rows = rebuilt(turns)
    rows = checkpointed(rows)

    # Whole-sequence collapse. Conversations without turns are the empty sequence.
    whole = rows.withColumns(lanes()).groupBy("conv").agg(F.max("depth").alias("len"), *[F.sum(s).alias(s) for s in LANES])
    whole = convs.join(whole, "conv", "left").fillna(0, ["len", *LANES])
    ends = checkpointed(whole.select("conv", F.col("len").cast("long").alias("len"), name(F.col("len"), map(F.col, LANES)).alias("key")))
    sequences = checkpointed(ends.groupBy("key", "len").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("weight")))

    # Prefixes of one conversation for each sequence; the root is a prefix of all.
    chosen = rows.join(sequences.select("conv"), "conv", "left_semi").withColumns({f"v{s}": c for s, c in lanes().items()})
    running = running_totals(chosen, "depth", {s: F.col(f"v{s}") for s in LANES}, ["conv"])
    parent = name(F.col("depth") - 1, [F.col(s) - F.col(f"v{s}") for s in LANES])
    prefixes = running.select("conv", "depth", "chars", name(F.col("depth"), map(F.col, LANES)).alias("key"), parent.alias("parent"))
    zero = [F.lit(0).cast("long")] * 5
    root = sequences.select("conv", zero[0].alias("depth"), zero[0].alias("chars"), name(zero[0], zero[1:]).alias("key"), F.lit(None).cast("binary").alias("parent"))
    prefixes = checkpointed(prefixes.unionByName(root))

    # Proper prefixes are parents of something; the sequences that are none are the leaves.
    proper = prefixes.filter("parent IS NOT NULL").select(F.col("parent").alias("key")).distinct()
    leaves = sequences.join(proper, "key", "left_anti").select("conv", F.lit(True).alias("leaf"))
    known = checkpointed(sequences.select("conv", "weight").join(leaves, "conv", "left"))
    weighted = prefixes.join(known, "conv")
    home = F.min(F.when(F.col("leaf"), F.col("conv")))
    nodes = weighted.groupBy("key").agg(
        *[F.first(c).alias(c) for c in ("depth", "chars", "parent")], F.min("conv").alias("conv"), F.sum("weight").alias("n_convs"), F.count("leaf").alias("n_leaves"), home.alias("home")
    )
    nodes = checkpointed(nodes)

    # Every node's saving is told to one leaf below it, its home. Homes along a leaf's path are
    # that leaf from some depth on, so sums from the leaf upwards, added up by node, count each once.
    saving = nodes.select(F.col("home").alias("conv"), "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("saving"))
    paths = prefixes.select("conv", "depth", "key").join(leaves.select("conv"), "conv", "left_semi").join(saving, ["conv", "depth"], "left")
    upwards = running_totals(paths.fillna(0, ["saving"]), F.col("depth").desc(), {"saved": F.col("saving")}, ["conv"])
    saved = upwards.groupBy("key").agg(F.sum("saved").alias("saved_tokens"))

    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = checkpointed(nodes.join(children, "key", "left").join(saved, "key").join(ends_digest(ends), "key", "left"))
    parents = nodes.filter("n_children > 0").select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv_id"), F.col("n_children").alias("_n"))
    kind = df.schema[id_col].dataType
    out = spread_join(nodes.filter("parent IS NOT NULL"), parents, "parent").unionByName(nodes.filter("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast(kind)))
    return out.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
