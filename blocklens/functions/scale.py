"""Building blocks that keep ordered and keyed work distributed.

``running_totals``, ``global_rank`` and ``hash_split`` replace windows over a whole
table or over one hot key; ``lookup_join`` replaces unchecked broadcasts.
"""

import math
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20
SALTS = 32
HOT_PARTS = 512
SPREAD_ROWS = 250_000


def _checkpoint_folder(spark) -> str:
    """The session's checkpoint folder: the cluster's ``spark.checkpoint.dir``.

    Only a local session without one gets a temporary folder; a cluster session must name a
    shared one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="blocklens-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's checkpoint folder and cut its lineage."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a Parquet table in the checkpoint folder and read it: filters and columns reach the files."""
    path = f"{_checkpoint_folder(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame, rows: int = SPREAD_ROWS) -> DataFrame:
    """Give heavy per-row work at least one partition per core, and one for every ``rows`` rows.

    Only inputs with fewer splits (a small or well compressed file) are shuffled; others keep
    their splits. ``df`` is a stored or checkpointed table, so counting it is cheap.
    """
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / rows))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Measure ``df`` (as JSON text, near enough) against the broadcast limit."""
    width = F.octet_length(F.to_json(F.struct(*df.columns))) + 32
    return df.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0] <= limit


def lookup_join(left, right, on, how="left", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join a large ``left`` to a lookup ``right`` that has one row per key.

    The lookup is broadcast after its size was measured. A larger one is shuffled; keys with a
    ``HOT_PARTS``-th of the rows of ``left`` or more are salted, so one holding a third of them is
    spread over ``SALTS`` tasks and only the rows of such keys (at most ``HOT_PARTS``) are repeated.
    """
    if fits_broadcast(right, limit):
        return left.join(F.broadcast(right), on, how)
    on = [on] if isinstance(on, str) else list(on)
    salt = F.pmod(F.xxhash64(*left.columns), F.lit(SALTS))
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")
    # Keys of a stream cannot be counted first, so there each is salted.
    if not left.isStreaming:
        counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
        total = counts.agg(F.sum("_rows").alias("_total"))
        hot = counts.crossJoin(F.broadcast(total)).filter(F.col("_rows") * HOT_PARTS >= F.col("_total"))
        hot = F.broadcast(hot.select(*on, F.lit(True).alias("_hot")))
        left, right = left.join(hot, on, "left"), right.join(hot, on, "left")
        # Rows without a key meet nothing and may lie anywhere.
        bare = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
        salt = F.when(bare | F.coalesce("_hot", F.lit(False)), salt).otherwise(0)
        salts = F.when(F.col("_hot"), salts).otherwise(F.array(F.lit(0).cast("long")))
    salted_left = left.withColumn("_salt", salt).drop("_hot")
    salted_right = right.withColumn("_salt", F.explode(salts)).drop("_hot")
    return salted_left.join(salted_right, on + ["_salt"], how).drop("_salt")


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running_totals(df: DataFrame, order, sums: dict, by=()) -> DataFrame:
    """Add inclusive running sums of ``sums`` (new name -> column) along ``order``.

    Rows are range partitioned on (by, order), each partition is summed by itself and
    the totals of earlier partitions are added, so neither the whole table nor a hot
    ``by`` key ends up in one task. The partition number is stored before it is used
    twice: a second sampling of the ranges could differ.
    """
    by = list(by)
    order = [order] if isinstance(order, (str, Column)) else list(order)
    values = {f"_v_{name}": col for name, col in sums.items()}
    staged = checkpointed(
        df.withColumns(values)
        .repartitionByRange(_partitions(df), *by, *order)
        .withColumn("_part", F.spark_partition_id())
    )
    part_totals = staged.groupBy(*by, "_part").agg(*[F.sum(v).alias(f"_t{v}") for v in values])
    earlier = (
        Window.partitionBy(*(by or [F.lit(0)]))
        .orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = part_totals.select(
        *by, "_part", F.count(F.lit(1)).over(earlier).alias("_before"), *[F.sum(f"_t{v}").over(earlier).alias(f"_o{v}") for v in values]
    )
    # Ranges are cut along (by, order): only the first group of a range can go on from an
    # earlier one, so there is at most one such row for each partition.
    offsets = offsets.filter("_before > 0").select(*[F.col(c).alias(f"_same_{c}") for c in (*by, "_part")], *[f"_o{v}" for v in values])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_same_{c}")) for c in (*by, "_part")])
    joined = staged.join(F.broadcast(offsets), same, "left")
    inside = (
        Window.partitionBy(*by, "_part")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    for name in sums:
        joined = joined.withColumn(name, F.sum(f"_v_{name}").over(inside) + F.coalesce(F.col(f"_o_v_{name}"), F.lit(0)))
    return joined.select(*df.columns, *sums)


def global_rank(df: DataFrame, order, by=(), name: str = "rank") -> DataFrame:
    """Number rows 1..n along a unique ``order``, within ``by`` when given."""
    return running_totals(df, order, {name: F.lit(1).cast("long")}, by)


def split_hash(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))


def hash_split(df, id_col, ratio, seed, stratum=None, name="selected", digits=4) -> DataFrame:
    """Flag exactly ``floor(ratio * n)`` rows (per stratum), those with the smallest hash of their id.

    Rows are counted by hash prefix, which tells the prefix where the cut falls; only rows
    with that prefix are ordered to find the last selected one. The flag then is a
    comparison of each row with its stratum's cut, from a table of one row per stratum,
    which is broadcast where its measured size allows.
    """
    keyed = df.withColumn("_hash", split_hash(id_col, seed)).withColumn("_prefix", F.substring("_hash", 1, digits))
    group = F.col(stratum) if stratum else F.lit(None).cast("string")
    keyed = keyed.withColumn("_stratum", group)
    counts = keyed.groupBy("_stratum", "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    # At most 16^digits rows per stratum.
    whole = Window.partitionBy("_stratum")
    before = whole.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    at_cut = (
        counts.withColumn("_k", F.floor(F.lit(ratio) * F.sum("_n").over(whole)))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .filter((F.col("_before") < F.col("_k")) & (F.col("_k") <= F.col("_before") + F.col("_n")))
        .select(F.col("_stratum").alias("_s"), F.col("_prefix").alias("_p"), (F.col("_k") - F.col("_before")).alias("_need"))
    )
    # One row per stratum: measured, and broadcast where it is small.
    order = Window.partitionBy("_stratum").orderBy("_hash", id_col)
    same = F.col("_stratum").eqNullSafe(F.col("_s"))
    at_cut = checkpointed(at_cut)
    small = (lambda t: F.broadcast(t)) if fits_broadcast(at_cut) else (lambda t: t)
    near = keyed.join(small(at_cut), same & (F.col("_prefix") == F.col("_p")))
    last = near.withColumn("_row", F.row_number().over(order)).filter(F.col("_row") == F.col("_need"))
    cuts = checkpointed(last.select("_s", F.col("_hash").alias("_last"), F.col(id_col).alias("_last_id")))
    upto = (F.col("_hash") < F.col("_last")) | ((F.col("_hash") == F.col("_last")) & (F.col(id_col) <= F.col("_last_id")))
    flagged = keyed.join(small(cuts), same, "left").withColumn(name, F.coalesce(upto, F.lit(False)))
    return flagged.drop("_hash", "_prefix", "_stratum", "_s", "_last", "_last_id")


def percentiles(df: DataFrame, column: str, fractions) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per fraction.

    Works on value counts and their running total, so no task holds all values.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("_x")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    ranked = running_totals(counts, "_x", {"_upto": F.col("_n")})
    total = ranked.agg(F.max("_upto").alias("_total"))
    ranked = ranked.crossJoin(F.broadcast(total))
    rows = []
    for q in fractions:
        place = F.lit(float(q)) * (F.col("_total") - 1)
        low = F.min(F.when(F.col("_upto") > F.floor(place), F.col("_x")))
        high = F.min(F.when(F.col("_upto") > F.ceil(place), F.col("_x")))
        part = F.max(place - F.floor(place))
        rows.append(F.struct(F.lit(float(q)).alias("fraction"), (low + (high - low) * part).alias("value")))
    return ranked.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")
