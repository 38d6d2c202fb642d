"""Best-fit packing of tokenised documents into sequences by exact-complement hashing.

How sequences are filled depends on the number of pieces of each length only, at most
``capacity`` counts whatever the size of the corpus. The plan is made from these counts
and every piece then finds its place by its length and its rank among equal lengths.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blocklens.functions.scale import checkpointed
from blocklens.llm.pieces import WordTokenizer
from blocklens.llm.words import lean, slices

CAPACITY = 2048
#: Text bytes worked on at a time.
BLOCK = 4 << 20
SLOT_ROWS = 50_000

_TOKENIZERS = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each worker and file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def cut_pieces(df: DataFrame, path: str, id_col="doc_id", text="text", capacity=CAPACITY, end_id=0, ids=False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: id, piece, start, length, ids_crc32 and, if asked for, the ids.

    Each document's ids are followed by ``end_id``; a null text is an empty one, a null id
    stays null. Only longer documents are cut.
    """
    kind = df.schema[id_col].dataType.simpleString()
    ddl = f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids

    def run(batches):
        encoder = tokenizer(path)
        for batch in batches:
            for part in slices(batch, "_text", BLOCK, tidy=True):
                flat, first = encoder.encode(part.column("_text"))
                row, piece, start, length, crc, lists = [], [], [], [], [], []
                for i in range(part.num_rows):
                    own = np.append(flat[first[i] : first[i + 1]], end_id).astype("<u4")
                    for k, at in enumerate(range(0, len(own), capacity)):
                        chunk = own[at : at + capacity]
                        row.append(i), piece.append(k), start.append(at), length.append(len(chunk))
                        crc.append(zlib.crc32(chunk.tobytes()))
                        if ids:
                            lists.append(chunk.astype(np.int32))
                made = [part.column("_id").take(pa.array(row, pa.int32())), pa.array(piece, pa.int32())]
                made += [pa.array(x, pa.int64()) for x in (start, length, crc)] + [pa.array(lists, pa.list_(pa.int32()))] * ids
                names = [id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * ids
                yield pa.RecordBatch.from_arrays(made, names=names)

    return df.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).mapInArrow(lean(run), ddl)


def _fill(gap: int, left: np.ndarray):
    """Lengths that add up to ``gap`` exactly: one, else a pair, else a triple, long ones first; None without."""
    if left[gap]:
        return [gap]
    low = np.arange(1, gap // 2 + 1)
    if len(low):
        pair = (left[low] > 0) & (left[gap - low] > (low == gap - low))
        hit = np.flatnonzero(pair)
        if len(hit):
            a = int(low[hit[0]])
            return [gap - a, a]
    for c in np.flatnonzero(left[: gap - 1])[::-1]:
        c, rest = int(c), gap - int(c)
        # c is the longest of the three, so the other two sum to rest with neither above c
        if 3 * c < gap:
            break
        a = np.arange(max(1, rest - c), rest // 2 + 1)
        if not len(a):
            continue
        b = rest - a
        ok = (left[a] > (a == c)) & (left[b] > (b == c).astype(int) + (a == b))
        hit = np.flatnonzero(ok)
        if len(hit):
            a0 = int(a[hit[0]])
            return [c, rest - a0, a0]
    return None


def plan(counts: np.ndarray, capacity: int = CAPACITY):
    """Patterns [(lengths, times)] that use up ``counts`` (index: length).

    First, from the longest length down, sums that fill the gap exactly are consumed as
    often as their counts allow; what is left goes best-fit, all sequences with equal
    room at once. Each step uses up a length or a group of sequences, so there are few.
    """
    left, patterns = counts.astype(np.int64).copy(), []
    left[0] = 0
    if left[capacity]:
        patterns.append(([capacity], int(left[capacity])))
        left[capacity] = 0
    for length in range(capacity - 1, 0, -1):
        while left[length]:
            left[length] -= 1
            found = _fill(capacity - length, left)
            left[length] += 1
            if found is None:
                break
            lengths = [length, *found]
            need = {x: lengths.count(x) for x in lengths}
            times = min(int(left[x]) // k for x, k in need.items())
            for x, k in need.items():
                left[x] -= k * times
            patterns.append((lengths, times))
    open_by_room = {}
    for length in range(capacity - 1, 0, -1):
        while left[length]:
            room = min((r for r in open_by_room if r >= length), default=None)
            if room is None:
                # as many per new sequence as fit, so each step ends the length or leaves one sequence
                per = min(capacity // length, int(left[length]))
                times = int(left[length]) // per
                lengths = [length] * per
            else:
                held, n = open_by_room[room].pop()
                if not open_by_room[room]:
                    del open_by_room[room]
                per = min(room // length, int(left[length]))
                times = min(n, int(left[length]) // per)
                if n > times:
                    open_by_room.setdefault(room, []).append((held, n - times))
                lengths = held + [length] * per
            left[length] -= per * times
            rest = capacity - sum(lengths)
            if rest:
                open_by_room.setdefault(rest, []).append((lengths, times))
            else:
                patterns.append((lengths, times))
    for groups in open_by_room.values():
        patterns.extend(groups)
    return patterns


def places(patterns):
    """Arrays (length, first rank, times, first sequence, offset): where the ranks of each length go."""
    used, rows, sequence = {}, [], 0
    for lengths, times in patterns:
        at = 0
        for x in lengths:
            rows.append((x, used.get(x, 0), times, sequence, at))
            used[x] = used.get(x, 0) + times
            at += x
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, id_col="doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (id, piece, length of 1 to ``capacity``).

    Ties between equal lengths go by id and piece; repeated rows get places of their own.
    Clashing input columns are replaced. The counts are at most ``capacity`` rows and the
    plan a few places for each; ranks are counted in slots, so a length that holds most
    pieces is spread over tasks.
    """
    pieces = checkpointed(pieces.drop("sequence_id", "offset"))
    counted = pieces.groupBy("length").count().collect()
    counts = np.zeros(capacity + 1, np.int64)
    for r in counted:
        counts[r["length"]] = r["count"]
    table = places(plan(counts, capacity))
    slots = int(max(1, -(-int(counts.max()) // SLOT_ROWS))) * 4
    keyed = pieces.withColumn("_slot", F.pmod(F.xxhash64(id_col, "piece"), F.lit(slots)))
    sizes = keyed.groupBy("length", "_slot").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy("length").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")
    inside = Window.partitionBy("length", "_slot").orderBy(id_col, "piece", F.xxhash64(*pieces.columns))
    ranked = keyed.withColumn("_rank", F.row_number().over(inside)).join(sizes, ["length", "_slot"])
    ranked = ranked.withColumn("_rank", F.col("_rank") - 1 + F.col("_before")).drop("_slot", "_before")
    shift = 1 << 44
    keys = table[:, 0] * shift + table[:, 1]
    columns = [c for c in ranked.columns if c != "_rank"]
    schema = pieces.select(*columns).withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema

    def run(batches):
        for batch in batches:
            key = batch.column("length").to_numpy() * shift + batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, key, side="right") - 1
            sequence = table[at, 3] + batch.column("_rank").to_numpy() - table[at, 1]
            made = [batch.column(c) for c in columns] + [pa.array(sequence), pa.array(table[at, 4])]
            yield pa.RecordBatch.from_arrays(made, names=columns + ["sequence_id", "offset"])

    return ranked.mapInArrow(lean(run), schema)
