"""Template mining on distinct signatures, and matching lines to templates.

The number of distinct signatures drives the work, not the number of lines. Following
the published prefix-tree idea (He et al., 2017), signatures meet only within their
(token count, first token) leaf. Signatures that share their first (then their last) fixed
tokens, as many as similarity asks for, become partial clusters by aggregation, wherever
they are; only the templates that are left meet in order of appearance.
"""

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blocklens import config as C
from blocklens.functions import text
from blocklens.functions.scale import checkpointed, fits_broadcast, global_rank, lookup_join, stored

BUCKET_ROWS = 1_000
#: Templates of a leaf that are compared one by one before they are listed by their tokens.
TAIL = 256
#: Pairs of a signature and a template that are held at once.
PAIRS = 1 << 21
_JOINER = " "
# What is clustered: signatures, and templates of an earlier run (those have an event id).
# Texts go as they are, not as arrays of tokens, which take three times their bytes.
_PART_COLUMNS = ("part", "n_tok", "key0", "text", "first_line", "n_lines")
_SEED_COLUMNS = ("n_tok", "key0", "text", "first_line", "event_id", "n_lines")
_MEMBER_COLUMNS = ("cluster", "known", "part", "n_tok", "key0", "text", "first_line", "event_id", "n_lines")
_MEMBER_SCHEMA = (
    "cluster string, known boolean, part long, n_tok int, key0 string, text string, "
    "first_line long, event_id string, n_lines long"
)


@dataclass
class Mined:
    """``dictionary``: one row per template. ``signatures``: signature -> event_id."""

    dictionary: DataFrame
    signatures: DataFrame


def with_signature(parsed: DataFrame) -> DataFrame:
    """Add the signature text, unless the rows (stored by an earlier step) have it."""
    if "signature" in parsed.columns:
        return parsed
    return parsed.withColumn("signature", text.signature_text(F.col("content")))


def distinct_signatures(parsed: DataFrame) -> DataFrame:
    """Signature, its tokens, how many lines have it and the first of them."""
    sigs = (
        with_signature(parsed)
        .groupBy("signature")
        .agg(F.count(F.lit(1)).alias("n_lines"), F.min("line_id").alias("first_line"))
        .withColumn("tokens", F.split("signature", _JOINER))
    )
    return sigs.withColumns({"n_tok": F.size("tokens"), "key0": F.get("tokens", 0)})


def _limit_children(sigs: DataFrame, dictionary: DataFrame | None, max_children: int) -> DataFrame:
    """Only the earliest first tokens of a length get a leaf, later ones share the wildcard's."""
    keys = sigs.select("n_tok", "key0", "first_line")
    if dictionary is not None:
        keys = keys.unionByName(dictionary.select("n_tok", "key0", F.lit(-1).cast("long").alias("first_line")))
    keys = keys.filter(F.col("key0") != C.WILDCARD).groupBy("n_tok", "key0").agg(F.min("first_line").alias("_seen"))
    earliest = Window.partitionBy("n_tok").orderBy("_seen", "key0")
    own = (
        keys.withColumn("_r", F.row_number().over(earliest))
        .filter(F.col("_r") < max_children)
        .select("n_tok", "key0", F.lit(True).alias("_own"))
    )
    # Stored, as what is placed is read some times.
    placed = lookup_join(sigs, checkpointed(own), ["n_tok", "key0"])
    return placed.withColumn("key0", F.when(F.col("_own"), F.col("key0")).otherwise(C.WILDCARD)).drop("_own")


def _enough(threshold: float) -> Column:
    """Number of agreeing fixed tokens that makes two signatures of a length similar."""
    return F.greatest(F.ceil(F.col("n_tok") * F.lit(threshold)), F.lit(1)).cast("int")


def _fixed_tokens(tokens) -> Column:
    """The fixed tokens with their positions: array of (i, t)."""
    placed = F.transform(tokens, lambda t, i: F.struct(i.alias("i"), t.alias("t")))
    return F.filter(placed, lambda p: p["t"] != C.WILDCARD)


def _leaf():
    return F.concat_ws(_JOINER, F.col("n_tok").cast("string"), F.col("key0"))


def _settled(df: DataFrame) -> DataFrame:
    """``df`` stored; what earlier steps have shuffled is deleted once the driver finds that nobody reads it, so it is made to look."""
    out = stored(df, "zstd")
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def _without(parts: DataFrame, ids: DataFrame) -> DataFrame:
    """``parts`` (stored) but those of ``ids``; stored again only where ``ids`` are too many to be broadcast."""
    if fits_broadcast(ids):
        return parts.join(F.broadcast(ids), "part", "left_anti")
    return _settled(parts.join(ids, "part", "left_anti"))


def _merge_alike(parts: DataFrame, threshold: float, last: bool):
    """Merge rows of a leaf that share their first (or ``last``) fixed tokens, as many as make two rows similar.

    ``parts`` has part (a number), n_tok, key0, text, first_line and n_lines. All rows of a
    group are similar to each other and to what they become, so merging is a plain
    aggregation: positions where a row differs from the group's first one become wildcards,
    and a group with most of the rows is summed up where they are. Groups are found by 128 bits
    of their name, so only the texts of rows that merge are written again. Returns the rows that are
    left, and (part, into) for those that went into another.
    """
    fixed, need = _fixed_tokens(F.split("text", _JOINER)), _enough(threshold)
    piece = F.slice(fixed, -need, need) if last else F.slice(fixed, 1, need)
    spelled = F.transform(piece, lambda p: F.concat_ws("=", p["i"].cast("string"), p["t"]))
    group = F.when(F.size(fixed) >= need, F.concat_ws(_JOINER, _leaf(), F.array_join(spelled, _JOINER)))
    # Filtered once it is stored: a filter before it would spell every group twice.
    keyed = _settled(parts.select("part", F.unhex(F.md5(group)).alias("_group"))).filter("_group IS NOT NULL")
    several = _settled(keyed.groupBy("_group").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_group"))
    if several.isEmpty():
        return parts, None
    ids = _settled(lookup_join(keyed, several.withColumn("_many", F.lit(True)), "_group", "inner").select("part", "_group"))
    found = _settled(lookup_join(parts, ids, "part", "inner"))
    first = F.min(F.struct("first_line", "text", "part")).alias("_first")
    groups = _settled(found.groupBy("_group").agg(first).select("_group", F.col("_first.part").alias("into"), F.col("_first.text").alias("_like")))
    members = lookup_join(found, groups, "_group", "inner").withColumns({"_tokens": F.split("text", _JOINER), "_like": F.split("_like", _JOINER)})
    differs = F.filter(F.sequence(F.lit(0), F.col("n_tok") - 1), lambda i: F.get("_tokens", i) != F.get("_like", i))
    wild = members.select("into", F.explode(differs).alias("i")).distinct()
    # At most a position for each token of a template.
    wild = wild.groupBy("into").agg(F.collect_set("i").alias("_wild"))
    merged = members.groupBy("into").agg(
        *[F.first(c).alias(c) for c in ("n_tok", "key0", "_like")], F.min("first_line").alias("first_line"), F.sum("n_lines").alias("n_lines")
    )
    tokens = F.transform("_like", lambda t, i: F.when(F.array_contains("_wild", i), F.lit(C.WILDCARD)).otherwise(t))
    merged = merged.join(wild, "into", "left").withColumn("_wild", F.coalesce("_wild", F.array().cast("array<int>")))
    merged = _settled(merged.select(F.col("into").alias("part"), "n_tok", "key0", F.array_join(tokens, _JOINER).alias("text"), "first_line", "n_lines"))
    left = _without(parts, ids.select("part")).select(*_PART_COLUMNS).unionByName(merged)
    return left, _settled(members.filter("part <> into").select("part", "into"))


def _followed(moved: DataFrame | None, more: DataFrame | None) -> DataFrame | None:
    """Moves (part, into) of one round and of the next as one."""
    if moved is None or more is None:
        return more if moved is None else moved
    onward = lookup_join(moved, more.select(F.col("part").alias("into"), F.col("into").alias("_to")), "into")
    return onward.select("part", F.coalesce("_to", "into").alias("into")).unionByName(more)


class _Leaf:
    """Templates of one leaf, grown by one signature after the other in order of appearance.

    Templates are looked up by (position, token): of a signature with f fixed tokens that must
    agree on k with a template, the f - k + 1 rarest are looked up, and every template that is
    similar enough is found under one of them. Templates only lose fixed tokens, so what is
    listed stays a superset. The last ``TAIL`` templates or more are compared one by one until
    they are listed. Sorted arrays hold the lists, about 20 bytes a token of a template.
    """

    def __init__(self, threshold: float, wild: int, n_tok: int):
        self.threshold, self.wild, self.texts, self.ids = threshold, wild, [], []
        self.first, self.first_known, self.lines = [], [], []
        self.codes = np.empty((16, n_tok), np.int64)
        # The least number of agreeing tokens that makes a share of at least ``threshold``.
        self.need = next((k for k in range(n_tok + 1) if k / n_tok >= threshold), n_tok + 1)
        self.lists, self.listed, self.compared = [], 0, 0

    def _keys(self, codes: np.ndarray) -> np.ndarray:
        places = np.arange(codes.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return codes.view(np.uint64) ^ places

    def _list_tail(self) -> None:
        """Put the templates that are not listed yet into sorted lists; lists of like size become one."""
        codes = self.codes[self.listed : len(self.texts)]
        row, place = np.nonzero(codes != self.wild)
        keys, owners = self._keys(codes)[row, place], (row + self.listed).astype(np.int32)
        while self.lists and len(self.lists[-1][0]) <= 2 * len(keys):
            more, theirs = self.lists.pop()
            keys, owners = np.concatenate([more, keys]), np.concatenate([theirs, owners])
        order = np.argsort(keys, kind="stable")
        self.lists.append((keys[order], owners[order]))
        self.listed = len(self.texts)

    def _listed_near(self, codes: np.ndarray) -> list:
        """For every signature the listed templates that agree on enough tokens with it, as they are now."""
        none = np.zeros(0, np.int64)
        if not self.listed or not len(codes):
            return [none] * len(codes)
        keys, fixed = self._keys(codes), codes != self.wild
        spans = [[np.searchsorted(k, keys, side) for side in ("left", "right")] for k, _ in self.lists]
        often = sum(hi - lo for lo, hi in spans)
        ranks = np.argsort(np.argsort(np.where(fixed, often, np.iinfo(np.int64).max), axis=1, kind="stable"), axis=1)
        probed = fixed & (ranks < (fixed.sum(axis=1) - self.need + 1)[:, None])
        if len(codes) > 1 and often[probed].sum() > PAIRS:
            half = len(codes) // 2
            return self._listed_near(codes[:half]) + self._listed_near(codes[half:])
        rows = np.nonzero(probed)[0]
        pairs = [none]
        for (lo, hi), (_, owners) in zip(spans, self.lists):
            size = (hi - lo)[probed]
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            pairs.append(np.repeat(rows, size) * self.listed + owners[np.repeat(lo[probed], size) + inside])
        pairs = np.unique(np.concatenate(pairs))
        row, owner = pairs // self.listed, pairs % self.listed
        enough = np.zeros(len(pairs), bool)
        step = max(1, PAIRS // codes.shape[1])
        for k in range(0, len(pairs), step):
            theirs = self.codes[owner[k : k + step]]
            enough[k : k + step] = ((theirs == codes[row[k : k + step]]) & (theirs != self.wild)).sum(axis=1) >= self.need
        self.compared += len(pairs)
        return np.split(owner[enough], np.searchsorted(row[enough], np.arange(1, len(codes))))

    def add(self, tokens: list, codes: np.ndarray, event_ids: list) -> list:
        """The numbers of the templates that take these signatures in, one after the other."""
        found = []
        for k in range(0, len(tokens), TAIL):
            part = slice(k, k + TAIL)
            near = self._listed_near(codes[part]) if self.need > 0 else None
            for i, (own, code, event_id) in enumerate(zip(tokens[part], codes[part], event_ids[part])):
                found.append(self._add(own, code, event_id, near[i] if near else np.arange(self.listed)))
            if len(self.texts) - self.listed >= TAIL:
                self._list_tail()
        return found

    def note(self, at: int, known: bool, first_line, n_lines) -> None:
        """Count lines of template ``at``; its first line is that of this run's signatures, without any that of what it was."""
        while len(self.lines) <= at:
            self.first.append(None)
            self.first_known.append(None)
            self.lines.append(0)
        first = self.first_known if known else self.first
        if first_line is not None and (first[at] is None or first_line < first[at]):
            first[at] = first_line
        self.lines[at] += n_lines

    def _add(self, tokens: list, code: np.ndarray, event_id, near: np.ndarray) -> int:
        n, wild = len(self.texts), self.wild
        if event_id is None and n:
            seen = self.codes[self.listed : n]
            if len(near):
                near = np.concatenate([near, np.arange(self.listed, n)])
                seen = self.codes[near]
            self.compared += len(seen)
            same = ((seen == code) & (seen != wild)).sum(axis=1)
            if len(same) and (most := same.max()) >= self.need:
                # The most similar template; of several, the more general, then the older one.
                tied = np.flatnonzero(same == most)
                at = int(tied[np.argmax((seen[tied] == wild).sum(axis=1))])
                best = int(near[at]) if len(near) else self.listed + at
                self.codes[best] = np.where(seen[at] == code, code, wild)
                self.texts[best] = [a if a == b else C.WILDCARD for a, b in zip(self.texts[best], tokens)]
                return best
        if n == len(self.codes):
            self.codes = np.concatenate([self.codes, np.empty_like(self.codes)])
        self.codes[n] = code
        self.texts.append(list(tokens))
        self.ids.append(event_id)
        return n


def _token_codes(tokens) -> np.ndarray:
    """64-bit numbers of tokens, the same in every batch."""
    return pd.util.hash_array(np.asarray(tokens, dtype=object), categorize=False).view(np.int64)


def _cluster_leaves(threshold: float):
    """Clusters sorted leaves as they stream by: one row per part, then one per template.

    What is held in memory are the templates of the leaf at hand and their lists, so one
    procedure serves leaves of every size.
    """
    wild = int(_token_codes([C.WILDCARD])[0])

    def run(batches):
        leaf, key0, state = None, None, None
        for rows in batches:
            if not len(rows):
                continue
            known = rows["event_id"].notna().to_numpy()
            texts, names, owners, keys = (rows[c].to_list() for c in ("text", "leaf", "event_id", "key0"))
            tokens = [x.split(_JOINER) for x in texts]
            firsts = [None if pd.isna(x) else int(x) for x in rows["first_line"].to_list()]
            counts = rows["n_lines"].to_list()
            ends = np.cumsum([0] + [len(t) for t in tokens])
            codes = _token_codes(np.concatenate(tokens))
            owners = [owner if is_known else None for owner, is_known in zip(owners, known)]
            places, done = [], []
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for begin, end in zip(cuts, cuts[1:]):
                if names[begin] != leaf:
                    if state is not None:
                        done += _template_rows(leaf, key0, state)
                    leaf, key0, state = names[begin], keys[begin], _Leaf(threshold, wild, len(tokens[begin]))
                own = codes[ends[begin] : ends[end]].reshape(end - begin, -1)
                at = state.add(tokens[begin:end], own, owners[begin:end])
                for i, row in zip(at, range(begin, end)):
                    state.note(i, known[row], firsts[row], int(counts[row]))
                places += [f"{leaf}#{i}" for i in at]
            members = rows.assign(cluster=places, known=known, n_tok=None, key0=None, text=None, first_line=None, event_id=None, n_lines=None)[list(_MEMBER_COLUMNS)]
            yield members
            if done:
                yield _frame(done)
        if state is not None:
            yield _frame(_template_rows(leaf, key0, state))

    return run


def _template_rows(leaf: str, key0: str, state: _Leaf):
    found = enumerate(zip(state.texts, state.ids, state.first, state.first_known, state.lines))
    return [
        (f"{leaf}#{i}", None, None, len(tokens), key0, _JOINER.join(tokens), known if first is None else first, event_id, lines)
        for i, (tokens, event_id, first, known, lines) in found
    ]


def _frame(rows: list) -> pd.DataFrame:
    """Rows as they are: numbers stay whole beside missing ones."""
    return pd.DataFrame(rows, columns=_MEMBER_COLUMNS, dtype=object)


def mine_templates(
    parsed: DataFrame,
    dictionary: DataFrame | None = None,
    threshold: float = C.SIMILARITY_THRESHOLD,
    max_children: int = C.MAX_CHILDREN,
) -> Mined:
    """Mine templates from parsed lines (``line_id``, ``content``).

    New templates are numbered E1, E2, ... by first line. A ``dictionary`` of an earlier
    run is continued: its templates keep their ids and may become more general; their
    line counts are those of this run. ``max_children`` and the first token keep leaves apart.

    Signatures of a leaf that agree on their first fixed tokens, then templates that agree on
    their last ones, are merged by aggregation (``_merge_alike``), so no task gets a leaf's
    signatures. The templates left of a leaf pass through one task in order of appearance and
    each joins the most similar one there. The result depends on neither size nor partitions.
    """
    sigs = distinct_signatures(parsed).select("signature", "n_lines", "first_line")
    # Numbers are fixed by the stored table, and stand for the signatures from here on.
    sigs = _settled(sigs.withColumn("part", F.monotonically_increasing_id()))
    tokens = F.split("signature", _JOINER)
    placed = _limit_children(sigs.withColumns({"n_tok": F.size(tokens), "key0": F.get(tokens, 0)}), dictionary, max_children)
    parts = placed.select("part", "n_tok", "key0", F.col("signature").alias("text"), "first_line", "n_lines")
    parts, moved = _merge_alike(parts, threshold, last=False)
    parts, more = _merge_alike(parts, threshold, last=True)
    moved = _followed(moved, more)
    seeds = parts.withColumn("event_id", F.lit(None).cast("string")).select("part", *_SEED_COLUMNS)
    if dictionary is not None:
        earlier = dictionary.withColumns({"n_lines": F.lit(0).cast("long"), "part": F.lit(-1).cast("long"), "text": F.array_join("tokens", _JOINER)})
        seeds = seeds.unionByName(earlier.select("part", *_SEED_COLUMNS))
    leaves = seeds.withColumn("leaf", _leaf())
    buckets = max(1, math.ceil(parts.count() / BUCKET_ROWS))
    order = [F.col("event_id").isNull(), "first_line", "text"]
    bucketed = leaves.repartition(buckets, "leaf").sortWithinPartitions("leaf", *order)
    rows = _settled(bucketed.mapInPandas(_cluster_leaves(threshold), _MEMBER_SCHEMA))
    # Rows of parts say ``known``, rows of templates hold the text.
    members = rows.filter(~F.col("known")).select("part", "cluster")
    clusters = rows.filter(F.col("known").isNull()).drop("known", "part")
    named = _settled(_number(clusters, dictionary))
    dictionary = named.select("n_tok", "key0", F.split("text", _JOINER).alias("tokens"), "event_id", "first_line", "n_lines", F.col("text").alias("template"))
    by_part = _settled(lookup_join(members, named.select("cluster", "event_id"), "cluster").select("part", "event_id"))
    if moved is not None:
        inside = lookup_join(moved, by_part.withColumnRenamed("part", "into"), "into")
        by_part = _settled(by_part.unionByName(inside.select("part", "event_id")))
    return Mined(dictionary, lookup_join(sigs.select("part", "signature"), by_part, "part").select("signature", "event_id"))


def _number(clusters: DataFrame, dictionary: DataFrame | None) -> DataFrame:
    start = 0
    if dictionary is not None:
        taken = F.regexp_extract("event_id", r"(\d+)", 1).cast("long")
        start = dictionary.agg(F.coalesce(F.max(taken), F.lit(0))).first()[0]
    # Names and first lines are ranked, texts stay where they are.
    fresh = clusters.filter(F.col("event_id").isNull())
    ranks = checkpointed(global_rank(fresh.select("cluster", "first_line"), "first_line").select("cluster", "rank"))
    fresh = lookup_join(fresh, ranks, "cluster").withColumn("event_id", F.concat(F.lit("E"), (F.col("rank") + start).cast("string")))
    return fresh.drop("rank").unionByName(clusters.filter(F.col("event_id").isNotNull()))


def match_signatures(sigs: DataFrame, dictionary: DataFrame, threshold: float | None = None) -> DataFrame:
    """Best template per row of a stream, without an aggregation: see ``match_by_index``.

    The candidates of a row travel as one array, so this is for dictionaries of which a leaf
    fits a row, as on a stream, where aggregating would need a state.
    """
    template = F.struct(F.col("tokens").alias("t"), "event_id", F.col("first_line").alias("seen"))
    by_key = dictionary.groupBy("n_tok", "key0").agg(F.array_sort(F.collect_list(template)).alias("_own"))
    shared = by_key.filter(F.col("key0") == C.WILDCARD).select("n_tok", F.col("_own").alias("_shared"))
    placed = lookup_join(sigs, by_key.filter(F.col("key0") != C.WILDCARD), ["n_tok", "key0"])
    placed = lookup_join(placed, shared, "n_tok")
    none = F.array().cast(by_key.schema["_own"].dataType)
    candidates = F.concat(F.coalesce("_own", none), F.coalesce("_shared", none))

    def compare(c):
        same = F.size(F.filter(F.zip_with(c["t"], "tokens", lambda a, b: (a == b) & (a != C.WILDCARD)), lambda x: x))
        wild = F.size(F.filter(c["t"], lambda t: t == C.WILDCARD))
        return F.struct(
            (same / F.col("n_tok")).alias("similarity"),
            wild.alias("wild"),
            (-c["seen"]).alias("age"),
            (same + wild == F.col("n_tok")).alias("exact"),
            c["event_id"].alias("event_id"),
        )

    scored = F.transform(candidates, compare)
    fit = (lambda c: c["exact"]) if threshold is None else (lambda c: c["similarity"] >= threshold)
    best = F.array_max(F.filter(scored, fit))
    matched = placed.withColumn("_best", best)
    return matched.select(*sigs.columns, F.col("_best.event_id").alias("event_id"), F.col("_best.similarity").alias("similarity"))


def match_by_index(sigs: DataFrame, dictionary: DataFrame, threshold: float | None = None) -> DataFrame:
    """Best template per signature: the template's fixed tokens must all agree.

    With ``threshold`` it is enough that this share of tokens agrees. Templates of the
    signature's first token and those under the shared wildcard leaf are candidates; the most
    similar one wins, of several the more general, then the older one.

    An inverted index leads from (length, position, token) to templates. A template with f
    fixed tokens of which k must agree is listed under its f - k + 1 rarest ones: a signature
    that agrees on k of them meets it under one of these at least, and common tokens lead
    nowhere. ``sigs`` has one row per signature.
    """
    need = F.size("_fixed") if threshold is None else F.ceil(F.col("n_tok") * F.lit(threshold)).cast("int")
    entry = dictionary.select("event_id", "n_tok", F.col("key0").alias("_key"), F.col("tokens").alias("_like"), F.col("first_line").alias("_seen"), _fixed_tokens("tokens").alias("_fixed"))
    entry = entry.withColumn("_need", need)
    listed = entry.select("event_id", "n_tok", F.explode("_fixed").alias("p")).select("event_id", "n_tok", "p.i", "p.t")
    often = listed.groupBy("n_tok", "i", "t").agg(F.count(F.lit(1)).alias("_often"))
    # A window over one template's tokens.
    rarest = Window.partitionBy("event_id").orderBy("_often", "i", "t")
    ranked = lookup_join(listed, often, ["n_tok", "i", "t"]).withColumn("_r", F.row_number().over(rarest))
    index = entry.drop("n_tok").join(ranked, "event_id").filter(F.col("_r") <= F.size("_fixed") - F.greatest("_need", F.lit(1)) + 1)
    if threshold is None or threshold <= 0:
        # Templates that need no token at all stand under a place before the first.
        index = index.unionByName(entry.filter("_need <= 0").withColumns({"i": F.lit(-1), "t": F.lit(""), "_often": F.lit(0).cast("long"), "_r": F.lit(1)}))
    index = checkpointed(index.drop("_often", "_r", "_fixed", "_need"))
    places = F.concat(F.transform("tokens", lambda t, i: F.struct(i.alias("i"), t.alias("t"))), F.array(F.struct(F.lit(-1).alias("i"), F.lit("").alias("t"))))
    met = sigs.select("signature", "n_tok", "key0", "tokens", F.explode(places).alias("p")).select("signature", "n_tok", "key0", "tokens", "p.i", "p.t")
    met = lookup_join(met, index, ["n_tok", "i", "t"], "inner").filter((F.col("_key") == F.col("key0")) | (F.col("_key") == C.WILDCARD))
    agreed = F.size(F.filter(F.zip_with("_like", "tokens", lambda a, b: (a == b) & (a != C.WILDCARD)), lambda x: x))
    wild = F.size(F.filter("_like", lambda t: t == C.WILDCARD))
    met = met.withColumns({"_agreed": agreed, "_wild": wild})
    fit = F.col("_agreed") + F.col("_wild") == F.col("n_tok") if threshold is None else F.col("_agreed") / F.col("n_tok") >= threshold
    best = F.max(F.struct((F.col("_agreed") / F.col("n_tok")).alias("similarity"), "_wild", (-F.col("_seen")).alias("_age"), "event_id"))
    found = met.filter(fit).groupBy("signature").agg(best.alias("_best")).select("signature", F.col("_best.event_id").alias("event_id"), F.col("_best.similarity").alias("similarity"))
    return sigs.join(found, "signature", "left").select(*sigs.columns, "event_id", "similarity")


def assign_events(parsed: DataFrame, mined: Mined) -> DataFrame:
    """Add event id, the final template text and the parameter values to every line."""
    by_signature = lookup_join(
        mined.signatures,
        mined.dictionary.select("event_id", F.col("template").alias("event_template"), "tokens"),
        "event_id",
    )
    rows = lookup_join(with_signature(parsed), by_signature, "signature")
    params = text.parameters(F.col("content"), F.col("tokens"))
    return rows.withColumn("params", params).drop("signature", "tokens")


def match_templates(
    parsed: DataFrame, dictionary: DataFrame, threshold: float = C.SIMILARITY_THRESHOLD
) -> DataFrame:
    """Match lines to an existing dictionary; unmatched lines keep a NULL event id."""
    sigs = checkpointed(distinct_signatures(parsed))
    best = match_by_index(sigs, dictionary, threshold).select("signature", "event_id", "similarity")
    rows = lookup_join(with_signature(parsed), best, "signature").drop("signature")
    return rows.withColumn("matched", F.col("event_id").isNotNull())


def template_counts(events: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Lines per event id with the template text."""
    counts = events.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_lines"), F.min("line_id").alias("first_line"))
    return lookup_join(counts, dictionary.select("event_id", "template"), "event_id")


def top_templates(events: DataFrame, dictionary: DataFrame, n: int = C.TOP_TEMPLATES) -> DataFrame:
    counts = template_counts(events, dictionary)
    return counts.orderBy(F.desc("n_lines"), "first_line").limit(n)


def template_map(dictionary: DataFrame) -> DataFrame:
    return dictionary.select("event_id", "template")


def cross_check(dictionary: DataFrame, patterns: dict) -> DataFrame:
    """How many mined templates and lines each reference pattern covers.

    ``patterns`` maps ids to texts with ``[*]`` wildcards, a short list given by the user.
    """
    rows = []
    for pattern_id, pattern in patterns.items():
        rx = "^" + ".*".join(re.escape(part) for part in pattern.split("[*]")) + "$"
        hit = F.col("template").rlike(rx)
        rows.append(
            F.struct(
                F.lit(pattern_id).alias("pattern_id"),
                F.lit(pattern).alias("pattern"),
                F.count_if(hit).alias("n_templates"),
                F.coalesce(F.sum(F.when(hit, F.col("n_lines"))), F.lit(0)).alias("n_lines"),
            )
        )
    return dictionary.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")
