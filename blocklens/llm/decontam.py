"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items.

Texts are normalised byte by byte (A-Z lower-cased, everything that is no word a space), so
every place of the normalised text is a place of the original. A block of texts is scanned
once; hits are marked on words and mapped back to code points of the original text.
"""

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from blocklens.functions.scale import checkpointed
from blocklens.llm.words import free_name, per_text, slices

WIDTH = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE, BREAK = 32, 10
#: Every byte as it is scanned: words stay, with A-Z lower-cased, all else is a space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else SPACE for b in range(256))
#: Bytes of windows (with their items' ids) in one automaton, which takes some 80 times as much memory.
WINDOW_BYTES = 2 << 20
#: Text bytes scanned at a time.
BLOCK = 4 << 20
ADDED = "n_words long, n_hit long, n_items long, runs array<struct<first:long,last:long>>, items array<string>, spans array<struct<first:long,last:long>>"


def windows(items: DataFrame, id_col="item_id", text="text", width=WIDTH) -> DataFrame:
    """(window, n, item): every distinct window of every item as words joined by spaces, its number of words, the id as text.

    A window is ``width`` words in a row, or the whole item if that has fewer; items without
    words have none. A null id is the empty string.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), upper, upper.lower()), F.lit(f"({WORD})"), 1)
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words.alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (width - 1)))
    made = F.transform(starts, lambda i: F.array_join(F.slice("words", i, width), " "))
    return rows.select("item", F.least(F.size("words"), F.lit(width)).alias("n"), F.explode(F.array_distinct(made)).alias("window")).distinct()


class Windows:
    """The automaton of some windows; each is kept with a space at both ends, so it matches whole words only."""

    def __init__(self, rows):
        import ahocorasick

        number, owners, sizes = {}, [], []
        for window, n, item in rows:
            k = number.setdefault(window, len(number))
            if k == len(owners):
                owners.append([]), sizes.append(n)
            owners[k].append(item)
        self.items, self.size = owners, np.array(sizes, np.int64)
        self.automaton = ahocorasick.Automaton()
        for window, k in number.items():
            # One character for each byte: places in the scanned text are bytes.
            self.automaton.add_word(f" {window} ".encode().decode("latin-1"), k)
        self.automaton.make_automaton()

    def hits(self, text: bytes):
        """Places where a window ends, and which."""
        found = list(self.automaton.iter(text.decode("latin-1"))) if len(self.size) else []
        ends = np.fromiter((e for e, _ in found), np.int64, len(found))
        return ends, np.fromiter((k for _, k in found), np.int64, len(found))


def scan_block(texts: pa.Array, tool: Windows, runs, items):
    """The columns of ``ADDED`` for a block of texts, on top of the ``runs`` and ``items`` found before."""
    column = pc.fill_null(texts, "").cast(pa.large_binary())
    cuts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = bytes(memoryview(column.buffers()[2] or b"")[cuts[0] : cuts[-1]])
    cuts = cuts - cuts[0]
    clean = memoryview(data.translate(NORMAL))
    # "\n text " for each text; no window holds a line break, so none reaches over two texts.
    joined = b"".join(x for a, b in zip(cuts, cuts[1:]) for x in (b"\n ", clean[a:b], b" "))
    full = np.frombuffer(joined, np.uint8)
    keep = full != SPACE
    keep[1:] |= full[:-1] != SPACE
    text = full[keep]
    begins = np.flatnonzero((text[1:] > SPACE) & (text[:-1] == SPACE)) + 1
    before = np.cumsum(np.bincount(begins, minlength=len(text)))  # words begun up to a place
    heads = np.flatnonzero(text == BREAK)
    starts = np.append(before[heads], len(begins)).astype(np.int64)
    ends, which = tool.hits(text.tobytes())
    stop = before[ends]
    first, doc = stop - tool.size[which], np.searchsorted(starts, stop, "left") - 1
    listed = [set(x) for x in items]
    for d, k in set(zip(doc.tolist(), which.tolist())):
        listed[d].update(tool.items[k])
    old = [(starts[d] + r["first"], starts[d] + r["last"]) for d, own in enumerate(runs) for r in own]
    old = np.array(old, np.int64).reshape(-1, 2)
    deep = np.zeros(len(begins) + 1, np.int64)
    np.add.at(deep, np.concatenate([first, old[:, 0]]), 1)
    np.add.at(deep, np.concatenate([stop, old[:, 1]]), -1)
    hit = np.cumsum(deep)[:-1] > 0
    # Runs of words that are hit, cut where a text begins.
    after = np.concatenate([[False], hit[:-1]]) if len(hit) else hit
    fresh = np.zeros(len(hit) + 1, bool)
    fresh[starts] = True
    run_first = np.flatnonzero(hit & (~after | fresh[:-1]))
    run_last = np.flatnonzero(hit & (~np.append(hit[1:], False) | fresh[1:])) + 1 if len(hit) else run_first
    run_doc = np.searchsorted(starts, run_first, "right") - 1
    per_doc = np.concatenate([[0], np.cumsum(np.bincount(run_doc, minlength=len(column)))]).astype(np.int32)
    spans = (run_first, run_last)
    if len(run_first):
        place = np.flatnonzero(keep)
        ended = np.flatnonzero((text[:-1] > SPACE) & (text[1:] == SPACE))
        points = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
        shift = 3 * run_doc + 2  # signs put in before this text's bytes
        spans = tuple(points[p - shift] - points[cuts[run_doc]] for p in (place[begins[run_first]], place[ended[run_last - 1]] + 1))

    def pairs(a, b):
        made = pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["first", "last"])
        return pa.ListArray.from_arrays(pa.array(per_doc), made)

    base = starts[run_doc]
    return [
        pa.array(np.diff(starts)), pa.array(per_text(hit.astype(np.int64), starts)), pa.array([len(x) for x in listed], pa.int64()),
        pairs(run_first - base, run_last - base), pa.array([sorted(x) for x in listed], pa.list_(pa.string())), pairs(*spans),
    ]


_BUILT = {}


def scan(docs: DataFrame, items: DataFrame, text="text", item_id="item_id", item_text="text", width=WIDTH, window_bytes=WINDOW_BYTES) -> DataFrame:
    """Append to every document what of ``items`` it holds.

    Words are runs of 0-9, a-z and anything beyond ASCII, A-Z lower-cased. A document word
    inside any occurrence of a window (``windows``) is hit. Appended are n_words, n_hit,
    n_items, items (ids of the items with occurring windows as sorted text), runs of hit words
    (numbers first to last, last not included) and the same runs as spans of code points of
    the original text; input columns of these names are replaced.

    Texts are read once and nothing is shuffled. Only where the windows measure more than
    ``window_bytes`` do several automata follow each other over the stored rows; the result is
    the same. A null or empty text has no words; repeated rows and null ids are rows like any
    other; repeated item ids are one item; no items means no hits.
    """
    spark, added = docs.sparkSession, _parse_datatype_string(ADDED)
    kept = [c for c in docs.columns if c.lower() not in added.names]
    found = checkpointed(windows(items, item_id, item_text, width))
    measured = found.agg(F.coalesce(F.sum(F.octet_length("window") + F.octet_length("item")), F.lit(0))).first()[0]
    shards = max(1, -(-measured // window_bytes))
    own = free_name("_text", docs)
    nothing = [(F.array() if f.name in ("runs", "items", "spans") else F.lit(0)).cast(f.dataType).alias(f.name) for f in added]
    rows = docs.select(*kept, F.col(text).alias(own), *nothing)
    schema = StructType([f for f in rows.schema.fields if f.name not in added.names] + added.fields)

    def scanned(rows, shard):
        # About window_bytes of windows, as measured above.
        part = found.filter(F.pmod(F.xxhash64("window", "item"), F.lit(shards)) == shard).select("window", "n", "item").collect()
        shared, token = spark.sparkContext.broadcast([tuple(r) for r in part]), uuid.uuid4().hex

        def run(batches):
            if token not in _BUILT:
                _BUILT.clear()
                _BUILT[token] = Windows(shared.value)
            for batch in batches:
                for piece in slices(batch, own, BLOCK):
                    made = scan_block(piece.column(own), _BUILT[token], piece.column("runs").to_pylist(), piece.column("items").to_pylist())
                    yield pa.RecordBatch.from_arrays([piece.column(c) for c in (*kept, own)] + made, names=schema.names)

        return rows.mapInArrow(run, schema)

    for shard in range(shards):
        rows = scanned(checkpointed(rows) if shard else rows, shard)
    return rows.drop(own)
