"""Arrow helpers: whole texts to columns of numbered words, batch by batch.

Texts of a batch are split in one Arrow call and every distinct word gets a number, so
per-word work is done once per distinct word and the rest is NumPy on the numbers.
"""

import ctypes
import gc
import os
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from blocklens.functions.scale import fits_broadcast

BLOCK_BYTES = 16 << 20
SPARE_BYTES = 16 << 20
#: Numbers mixed together: two arrays of them fit a core's cache.
MIXED_AT_ONCE = 1 << 14
_settled = []


def tidy_up() -> None:
    """Free what only cycles hold, and what Arrow keeps for later."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def lean(run):
    """``run`` over a partition's batches, giving its memory back to the system in the end.

    Workers serve one task after another and allocators keep what they once had, so without
    this every worker of an executor stays as large as its largest task. A worker that has
    grown by no more than ``SPARE_BYTES`` since it last did so goes on at once.
    """

    @wraps(run)
    def task(batches):
        yield from run(batches)
        if grown():
            give_back()
            grown(settled=True)

    return task


def resident() -> int:
    """Bytes of memory this process holds."""
    return int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE")


def grown(settled: bool = False) -> bool:
    """Whether this process is more than ``SPARE_BYTES`` larger than when it had ``settled`` last."""
    if not Path("/proc/self/statm").exists():
        return True  # its size is not told here
    if settled:
        _settled[:] = [resident()]
    return resident() > (_settled[0] if _settled else 0) + SPARE_BYTES


def give_back() -> None:
    """Tidy up and let the allocator return what is free to the system."""
    tidy_up()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def release(spark) -> None:
    """Give the driver's memory of steps that are over back: their plans, generated code and Spark's files of them.

    Many small steps one after the other otherwise let its heap grow to the limit although little of it is in use.
    """
    give_back()
    spark.sparkContext._jvm.System.gc()


def slices(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES, tidy: bool = False):
    """Cut a batch into pieces of about ``limit`` text bytes; one longer text is a piece by itself.

    With ``tidy`` a piece's memory is given back before the next one.
    """
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
        if stop > start:
            yield batch.slice(start, stop - start)
            if tidy:
                tidy_up()


def split_words(texts: pa.Array):
    """Numbers of all words, first word of each text (n + 1 offsets), distinct words.

    A word is a run of anything but ASCII white space (space, tab to carriage return).
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, starts = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(real)])
    if not real.all():
        flat = flat.filter(pa.array(real))
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), before[starts], coded.dictionary


def per_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (one for each word) by text."""
    total = np.concatenate([np.zeros((1,) + values.shape[1:], values.dtype), np.cumsum(values, axis=0)])
    return total[starts[1:]] - total[starts[:-1]]


def text_numbers(starts: np.ndarray) -> np.ndarray:
    """For every word the number of its text."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit mix of unsigned 64-bit numbers (multiply and shift, twice), a block that fits the cache at a time."""
    start = np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = np.asarray(x)
    flat, out, spare = x.reshape(-1), np.empty(x.size, np.uint64), np.empty(min(x.size, MIXED_AT_ONCE), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, x.size, MIXED_AT_ONCE):
            own = out[k : k + MIXED_AT_ONCE]
            shifted = spare[: len(own)]
            np.add(flat[k : k + MIXED_AT_ONCE], start, out=own)
            for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xC2B2AE3D27D4EB4F)):
                np.right_shift(own, np.uint64(shift), out=shifted)
                np.bitwise_xor(own, shifted, out=own)
                np.multiply(own, np.uint64(factor), out=own)
            np.right_shift(own, np.uint64(32), out=shifted)
            np.bitwise_xor(own, shifted, out=own)
    return out.reshape(x.shape)


def with_columns(df: DataFrame, text: str, ddl: str, make, block: int = BLOCK_BYTES, tidy: bool = False) -> DataFrame:
    """Append the columns ``make(texts) -> list of arrays`` returns; input columns of the same names go.

    ``make`` gets an Arrow array of whole texts (nulls included), a few megabytes at a time.
    """
    added = _parse_datatype_string(ddl)
    kept = [c for c in df.columns if c not in added.names]
    source = df.select(*kept, *([] if text in kept else [F.col(text).alias("_text")]))
    column = text if text in kept else "_text"
    schema = StructType([f for f in df.schema.fields if f.name in kept] + added.fields)
    names = schema.names

    def run(batches):
        for batch in batches:
            for piece in slices(batch, column, block, tidy):
                made = make(piece.column(column))
                yield pa.RecordBatch.from_arrays([piece.column(c) for c in kept] + [pa.array(m) for m in made], names=names)

    return source.mapInArrow(lean(run), schema)


def held_out(doc_id="doc_id"):
    """True where crc32 of the id as text is divisible by 5; such rows are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def training_sample(df: DataFrame, by: list, max_rows: int, id_col: str = "doc_id", seed: int = 7) -> DataFrame:
    """Keep about ``max_rows`` rows for each value of ``by``, those with a small hash of their id.

    The share follows from exact counts of all rows, so the sample does not grow with the
    table; its size varies by a few square roots of ``max_rows``.
    """
    share = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    keep = share * F.col("_n") < max_rows
    if not by:
        return df.crossJoin(F.broadcast(counts)).filter(keep).drop("_n")
    # One row for each value of ``by``: measured before it is broadcast.
    return df.join(F.broadcast(counts) if fits_broadcast(counts) else counts, by).filter(keep).drop("_n")


def hot_keys(counts: DataFrame, key: str, n: str = "_n", parts: int = 512) -> DataFrame:
    """Keys holding at least one ``parts``-th of all rows: at most ``parts`` of them, whatever the table's size."""
    total = counts.agg(F.sum(n).alias("_total"))
    return counts.crossJoin(F.broadcast(total)).filter(F.col(n) * parts >= F.col("_total")).drop("_total")


def spread_join(left: DataFrame, right: DataFrame, key: str, n: str = "_n") -> DataFrame:
    """Join a large ``left`` to ``right``, which has one row and the row count ``n`` for each key.

    The few keys with a large share of the rows are joined by broadcast (at most 512 rows),
    so they are never dealt to one task; all other keys are shuffled. ``n`` is dropped.
    """
    hot = hot_keys(right, key, n)
    marked = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    values = [c for c in right.columns if c not in (key, n)]
    served = marked.filter("_hot").select(*left.columns, *values)
    rest = marked.filter("_hot IS NULL").select(*left.columns)
    return served.unionByName(rest.join(right.drop(n), key))


def free_name(name: str, *frames: DataFrame) -> str:
    """``name`` with as many underscores before it as it takes to be no column of ``frames`` (case does not count)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
