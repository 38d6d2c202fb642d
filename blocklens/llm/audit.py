"""How filters interact: what each removes, in every order, from a sparse document-term matrix.

Texts are read once. Every block of texts becomes a shard: a CSR matrix over the block's own
words, with that word list beside it. The word lists, each word once for a shard, make the
global dictionary and are encoded by it; documents themselves are never exploded into words.
Row sums and nonzero counts of the encoded shards decide the filters on words, the other
flags are attached, and only counts by flags go on.
"""

import math
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocklens.functions.scale import checkpointed
from blocklens.llm.words import free_name, hot_keys, lean, slices, split_words, text_numbers

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 100, 80, 10
#: Text bytes in a shard.
SHARD = 4 << 20
#: Rows of a shard, so that one of short texts stays small.
SHARD_ROWS = 20_000
#: Rows of word lists that a task holds before it packs them by shard.
HELD_ROWS = 1 << 20
SIGNS = "#$%&*|"


def count_rows(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many of the bytes marked by ``values`` each text has."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[cuts[1:]] - total[cuts[:-1]]


def sign_flags(texts: pa.Array) -> np.ndarray:
    """Bits of C and D for a block of texts, counted on their bytes."""
    column = pc.fill_null(texts, "").cast(pa.large_binary())
    cuts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[cuts[0] : cuts[-1]]
    cuts = cuts - cuts[0]
    points = count_rows((data & 0xC0) != 0x80, cuts)
    upper = count_rows((data >= 65) & (data <= 90), cuts)
    marked = np.zeros(256, bool)
    marked[list(SIGNS.encode())] = True
    return 4 * (100 * upper > UPPER_PERCENT * points) + 8 * (count_rows(marked[data], cuts) > 0)


def csr(texts: pa.Array):
    """Row starts, columns and counts of a block's document-term matrix, and its words: column k is word k."""
    codes, starts, words = split_words(texts)
    width = max(1, int(len(words)).bit_length())
    key = (text_numbers(starts) << width) | codes
    key.sort()
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    counts = np.diff(np.append(edge, len(key)))
    rows = key[edge] >> width
    return np.searchsorted(rows, np.arange(len(starts))), key[edge] & ((1 << width) - 1), counts, words


def gaps_of(columns: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each row's sorted columns as the first and the differences to the next; numbers that pack well."""
    gaps = np.diff(columns, prepend=0)
    first = starts[:-1][np.diff(starts) > 0]
    gaps[first] = columns[first]
    return gaps


def columns_of(gaps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The columns that ``gaps_of`` made gaps of."""
    total = np.concatenate([[0], np.cumsum(gaps)])
    return total[1:] - np.repeat(total[starts[:-1]], np.diff(starts))


def shards(docs: DataFrame, path: str, text="text", keep=()) -> DataFrame:
    """Write one row per block of texts to ``path`` and read it again.

    Columns: rows (an array of the ``keep`` columns, the text's digest and the flags C and D),
    starts, gaps and counts (the CSR matrix as little-endian 32-bit numbers, columns as
    ``gaps_of``) and words.
    """
    own, digest, mask = (free_name(n, docs) for n in ("_text", "_digest", "_mask"))
    source = docs.select(*keep, F.col(text).alias(own), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias(digest))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    fields = ", ".join(f"`{c}`: {kinds[c]}" for c in keep)
    schema = f"rows array<struct<{fields}{', ' if keep else ''}`{digest}`: binary, `{mask}`: int>>, starts binary, gaps binary, counts binary, words array<string>"

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, SHARD_ROWS):
                for part in slices(batch.slice(k, SHARD_ROWS), own, SHARD):
                    starts, columns, counts, words = csr(part.column(own))
                    flags = pa.array(sign_flags(part.column(own)), pa.int32())
                    rows = pa.StructArray.from_arrays([*(part.column(c) for c in (*keep, digest)), flags], names=[*keep, digest, mask])
                    rows = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
                    listed = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
                    yield pa.RecordBatch.from_arrays([rows, *(pa.array([x.astype("<u4").tobytes()], pa.binary()) for x in (starts, gaps_of(columns, starts), counts)), listed], names=["rows", "starts", "gaps", "counts", "words"])

    source.mapInArrow(lean(run), schema).withColumn("shard", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def encoded(local: DataFrame, path: str, hashed=F.xxhash64) -> DataFrame:
    """Number all distinct words of all shards and write two kinds of rows to ``path``: dictionary and listing.

    The word lists are dealt out by word and sorted by a 64-bit hash, which takes no comparisons
    of words, so a word's rows lie together and equal words get one number: (part, rank). Words
    that share a hash are told apart by themselves. Dictionary rows have word, part and rank;
    listing rows have, for a shard, the places (at) in its word list that this part numbered
    and their ranks. A word is there once for a shard, so the most frequent one has no more
    rows than there are shards.
    """
    spark = local.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = ["part", "word", "rank", "shard", "at", "ranks"]

    def number(batches):
        part, held, size = TaskContext.get().partitionId(), [], 0
        # The hash that came last, the words with it and their numbers; how many words are numbered.
        last, same, total = None, {}, 0

        def table(word=None, rank=None, shard=None, at=None, ranks=None):
            n = len(word if shard is None else shard)
            columns = [pa.array([part] * n, pa.int32()), *(pa.nulls(n, t) if c is None else c for c, t in ((word, pa.string()), (rank, pa.int64()), (shard, pa.int64()), (at, pa.binary()), (ranks, pa.binary())))]
            return pa.RecordBatch.from_arrays(columns, names=names)

        def listing():
            shard, at, rank = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(shard, kind="stable")
            shard, at, rank = shard[order], at[order], rank[order]
            cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            packed = [pa.array([x[i:j].astype("<u4").tobytes() for i, j in zip(cuts, [*cuts[1:], len(x)])], pa.binary()) for x in (at, rank)]
            return table(shard=pa.array(shard[cuts]), at=packed[0], ranks=packed[1])

        for batch in batches:
            if not batch.num_rows:
                continue
            word, key = batch.column("word"), batch.column("hash").to_numpy()
            new = np.concatenate([[key[0] != last], key[1:] != key[:-1]])
            mixed = bool(pc.any(pc.and_(pc.not_equal(word.slice(1), word.slice(0, len(word) - 1)), pa.array(~new[1:]))).as_py())
            if mixed or not new[0] and list(same) != [word[0].as_py()]:
                rank = np.zeros(len(key), np.int64)
                for i, (k, w) in enumerate(zip(key.tolist(), word.to_pylist())):
                    last, same = k, same if k == last else {}
                    new[i] = w not in same
                    total += new[i]
                    rank[i] = same.setdefault(w, total - 1)
            else:
                rank = total + np.cumsum(new) - 1
                last, same, total = key[-1], {word[-1].as_py(): rank[-1]}, int(rank[-1]) + 1
            yield table(word=word.filter(pa.array(new)), rank=pa.array(rank[new]))
            held.append((batch.column("shard").to_numpy(), batch.column("at").to_numpy(), rank))
            size += batch.num_rows
            if size >= HELD_ROWS:
                yield listing()
                held, size = [], 0
        if held:
            yield listing()

    dealt = local.select("shard", F.posexplode("words").alias("at", "word")).repartition(parts, "word").withColumn("hash", hashed("word")).sortWithinPartitions("hash")
    dealt.mapInArrow(number, "part int, word string, rank long, shard long, at binary, ranks binary").write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def matrix(docs: DataFrame, folder: str, text="text", keep=()):
    """The sparse document-term matrix of all whole texts as CSR shards with global columns, and its dictionary (word, code).

    Words are runs of anything but ASCII white space, as they are; codes run from 0 without
    gaps. Shards are written to ``folder`` and have shard, rows (see ``shards``), starts,
    gaps (of sorted codes, 64-bit; ``columns_of``) and counts.
    """
    spark = docs.sparkSession
    local = shards(docs, f"{folder}/local", text, keep)
    found = encoded(local, f"{folder}/words")
    # One offset for each part that the words were dealt to.
    sizes = found.filter("word IS NOT NULL").groupBy("part").agg((F.max("rank") + 1).alias("n")).collect()
    offsets, total = {}, 0
    for part, n in sorted((r["part"], r["n"]) for r in sizes):
        offsets[part] = total
        total += n
    names = ["shard", "rows", "starts", "gaps", "counts"]

    def encode(mine: pa.Table, listed: pa.Table) -> pa.Table:
        starts, gaps, counts = (np.frombuffer(mine[c][0].as_buffer(), "<u4").astype(np.int64) for c in ("starts", "gaps", "counts"))
        pieces = [[np.frombuffer(x.as_buffer(), "<u4").astype(np.int64) for x in listed[c]] for c in ("at", "ranks")]
        codes = np.zeros(sum(map(len, pieces[0])), np.int64)
        for part, at, ranks in zip(listed["part"].to_pylist(), *pieces):
            codes[at] = offsets[part] + ranks
        columns = codes[columns_of(gaps, starts)]
        order = np.lexsort((columns, text_numbers(starts)))
        made = gaps_of(columns[order], starts).astype("<i8"), counts[order].astype("<u4")
        packed = dict(zip(("gaps", "counts"), (pa.array([x.tobytes()], pa.binary()) for x in made)))
        return pa.table([packed.get(c, mine[c]) for c in names], names=names)

    listing = found.filter("shard IS NOT NULL").select("shard", "part", "at", "ranks")
    bare = local.select(names)
    # A shard is a block of texts, and so are its columns and words.
    bare.groupBy("shard").cogroup(listing.groupBy("shard")).applyInArrow(encode, bare.schema).write.option("compression", "zstd").parquet(f"{folder}/global")
    table = F.broadcast(spark.createDataFrame(list(offsets.items()), "part int, offset long"))
    dictionary = found.filter("word IS NOT NULL").join(table, "part").select("word", (F.col("offset") + F.col("rank")).alias("code"))
    return spark.read.parquet(f"{folder}/global"), dictionary


def flagged(docs: DataFrame, folder: str, text="text", keep=()) -> DataFrame:
    """One row per document: the ``keep`` columns, digest of its text, mask (bits of the filters A to D that it fails), words, distinct."""
    found, _ = matrix(docs, folder, text, keep)
    rows = found.schema["rows"].dataType.elementType
    names = rows.names
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.fields[:-2])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.column("rows")[i].values
                starts = np.frombuffer(batch.column("starts")[i].as_buffer(), "<u4").astype(np.int64)
                counts = np.frombuffer(batch.column("counts")[i].as_buffer(), "<u4").astype(np.int64)
                total, distinct = count_rows(counts, starts), np.diff(starts)
                mask = 1 * (total < MIN_WORDS) + 2 * (100 * distinct < DISTINCT_PERCENT * total) + part.field(len(names) - 1).to_numpy()
                yield pa.RecordBatch.from_arrays([*(part.field(k) for k in range(len(names) - 1)), pa.array(mask, pa.int32()), pa.array(total), pa.array(distinct)], names=[*names[:-2], "_digest", "_mask", "_words", "_distinct"])

    return found.select("rows", "starts", "counts").mapInArrow(run, (kinds + ", " if kinds else "") + "_digest binary, _mask int, _words long, _distinct long")


def with_copies(rows: DataFrame, id_col: str) -> DataFrame:
    """Set the bit of E where a smaller id has the same digest; a null id is neither smaller nor larger.

    Digests with at least a 512th of all rows are joined by broadcast (at most 512 of them).
    """
    seen = rows.groupBy("_digest").agg(F.min(id_col).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    seen = checkpointed(seen)
    hot = hot_keys(seen, "_digest").select("_digest", F.col("_first").alias("_hot"), F.lit(True).alias("_known"))
    marked = rows.join(F.broadcast(hot), "_digest", "left")
    rest = marked.filter("_known IS NULL").drop("_hot", "_known").join(seen.drop("_n"), "_digest", "left")
    both = marked.filter("_known").drop("_known").withColumnRenamed("_hot", "_first").unionByName(rest)
    later = F.coalesce(F.col(id_col) > F.col("_first"), F.lit(False))
    return both.withColumn("_mask", F.col("_mask") + F.when(later, 16).otherwise(0)).drop("_first")


def flag_counts(docs: DataFrame, labels: DataFrame, folder: str, id_col="doc_id", text="text", part="lang") -> DataFrame:
    """(part, mask, good, toxic, n): documents by part, bits of the filters they fail, and labels."""
    kept = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    rows = checkpointed(flagged(kept, folder, "text", ("id", "part")).select("id", "part", "_digest", "_mask"))
    rows = with_copies(rows, "id")
    is_one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    out = rows.join(known.filter("good + toxic > 0"), "id", "left").fillna(0, ["good", "toxic"])
    return out.groupBy("part", F.col("_mask").alias("mask"), "good", "toxic").agg(F.count(F.lit(1)).alias("n"))


def audit(docs: DataFrame, labels: DataFrame, folder: str, id_col="doc_id", text="text", part="lang") -> DataFrame:
    """What five filters remove in every order, for each ``part`` value.

    A document fails A with fewer than 100 words, B if distinct words are under 80 % of its
    words, C if A-Z are over 10 % of its code points, D if it holds any of ``#$%&*|``, and E if
    a smaller id has the same text, whether that one is removed or not.

    One row per part (null is the empty string), filter_order (all 120) and step (1 to 5):
    counts of documents kept after the step, removed by it, redundant (failing its filter but
    removed before), unique_fails (failing its filter only), good_lost and toxic_lost (removed
    here with quality or toxic 1) and shapley (removed by its filter over all orders).

    A null text is empty; rows with a null id have no labels, are never copies of a smaller id
    nor smaller than another; repeated rows count as often as they are there; several labels
    of an id count as 1 if any is. Without documents there are no rows. Other columns are
    ignored. Spark writes the matrix below ``folder``, a new one that all executors reach.
    """
    spark = docs.sparkSession
    counts = checkpointed(flag_counts(docs, labels, folder, id_col, text, part))
    # A step's counts follow from its filter and the set of those before it: 5 x 16 pairs.
    pairs = [(1 << f, before) for f in range(5) for before in range(32) if not before & 1 << f]
    orders = lambda before: math.factorial(before.bit_count()) * math.factorial(4 - before.bit_count())
    cases = F.array(*[F.struct(F.lit(own).alias("own"), F.lit(before).alias("before"), F.lit(orders(before)).alias("orders")) for own, before in pairs])
    fails, gone = F.col("mask").bitwiseAND(F.col("own")) > 0, F.col("mask").bitwiseAND(F.col("before")) > 0
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    cells = counts.select("*", F.inline(cases)).groupBy("part", "own", "before", "orders").agg(
        total(~gone & ~fails).alias("kept"), total(~gone & fails).alias("removed"), total(gone & fails).alias("redundant"), total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(~gone & fails & (F.col("good") > 0)).alias("good_lost"), total(~gone & fails & (F.col("toxic") > 0)).alias("toxic_lost"),
    )
    cells = checkpointed(cells)
    shapley = cells.groupBy("part", "own").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    steps = [("".join(o), k + 1, 1 << FILTERS.index(o[k]), sum(1 << FILTERS.index(x) for x in o[:k])) for o in permutations(FILTERS) for k in range(5)]
    steps = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, own int, before int"))
    return cells.join(shapley, ["part", "own"]).join(steps, ["own", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
