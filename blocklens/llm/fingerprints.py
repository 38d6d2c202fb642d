"""Document fingerprints: a homomorphic multiset hash of paragraphs, in built-in functions only.

Every paragraph is hashed to a wide vector and a document is the sum of its vectors, each
lane modulo a power of two. The sum does not depend on the order of the paragraphs, and
adding or subtracting a paragraph's vector inserts or deletes it.

A fingerprint is a struct: ``paragraphs`` and ``sentences`` (counts), ``wide`` (16 lanes
modulo 2**32 from two SHA-256 of the paragraph, for equality) and ``thin`` (lanes modulo 2**8
for likeness, four to a number with room for carries between them). For ``thin`` paragraphs
are cut at sentence ends. A sentence falls into one of 64 lanes at level 0; a quarter of the
sentences does so at level 1 too, a quarter of these at level 2, and so on. Two documents'
lanes differ where a sentence of one is missing in the other, and how many lanes differ at
the first level that is not crowded tells how many.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType

from blocklens.llm.words import free_name

WIDE = 16
LANES, LEVELS = 64, 6
SLOTS = LANES // 4
#: The four lanes of a number, and the bits a carry or borrow goes to.
MASK, GUARD = 0x00FF00FF00FF00FF, 0x0100010001000100
#: Of a level's lanes, the most that may differ for the level to be used.
CROWDED = 56
#: Sentences that differ, by the number of differing lanes (occupancy of the lanes inverted).
ESTIMATE = [round(LANES * math.log(LANES / (LANES - d))) for d in range(LANES)] + [round(LANES * math.log(2 * LANES))]


def paragraphs(text: Column) -> Column:
    """Lines that are not empty; null is an empty text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda p: p != "")


def sentences(found: Column) -> Column:
    """Paragraphs cut after a full stop, exclamation or question mark that a space follows."""
    return F.flatten(F.transform(found, lambda p: F.filter(F.split(F.regexp_replace(p, "([.!?]) ", "$1\n"), "\n", -1), lambda s: s != "")))


def hex_number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


def summed(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda total, x: total + value(x))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; equal texts have equal ones, and so has any order of the paragraphs."""
    # Each step is bound once by a one-element transform, so nothing is worked out again.
    def placed(r):
        """From the 60 bits of a sentence's hash: its highest level, slot, and value in place."""
        low, lane = r.bitwiseAND(F.lit((1 << 40) - 1)), F.shiftright(r, 40).bitwiseAND(F.lit(LANES - 1))
        level = F.lit(0)
        for k in range(1, LEVELS):
            level = level + (low % 4**k == 0).cast("int")
        value = 1 + F.shiftright(r, 46) % 255
        field = lane.bitwiseAND(F.lit(3))
        shifted = F.when(field == 0, value).when(field == 1, F.shiftleft(value, 16)).when(field == 2, F.shiftleft(value, 32)).otherwise(F.shiftleft(value, 48))
        return F.struct(level.alias("level"), F.shiftright(lane, 2).cast("int").alias("slot"), shifted.alias("value"))

    def wide_lane(hashes, k):
        return F.pmod(summed(hashes, lambda h: hex_number(F.substring(h, 1 + 8 * k, 8))), F.lit(1 << 32))

    def thin_slots(rs):
        one = lambda slot: F.aggregate(rs, F.lit(0).cast("long"), lambda t, r: (t + F.when(r["slot"] == slot, r["value"]).otherwise(F.lit(0).cast("long"))).bitwiseAND(F.lit(MASK)))
        return F.array(*[one(slot) for slot in range(SLOTS)])

    def thin_level(rs, level):
        inside = F.filter(rs, lambda r: r["level"] >= level) if level else rs
        return F.transform(F.array(inside), thin_slots)[0]

    def of_hashes(x):
        wide = [wide_lane(x["wide"], k) for k in range(WIDE)]
        thin = [thin_level(x["thin"], level) for level in range(LEVELS)]
        return F.struct(
            F.size(x["wide"]).cast("long").alias("paragraphs"),
            F.size(x["thin"]).cast("long").alias("sentences"),
            F.array(*wide).alias("wide"),
            F.flatten(F.array(*thin)).alias("thin"),
        )

    found = F.array(paragraphs(text))
    hashes = F.transform(
        found,
        lambda ps: F.struct(
            F.transform(ps, lambda p: F.concat(F.sha2(F.concat(F.lit("0"), p), 256), F.sha2(F.concat(F.lit("1"), p), 256))).alias("wide"),
            F.transform(F.transform(sentences(ps), lambda s: hex_number(F.substring(F.md5(s), 1, 15))), placed).alias("thin"),
        ),
    )
    return F.transform(hashes, of_hashes)[0]


def added(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of both texts' paragraphs together (modulo the powers); with ``sign`` -1, of ``a`` without those of ``b``."""
    wide = F.zip_with(a["wide"], b["wide"], lambda x, y: F.pmod(x + sign * y, F.lit(1 << 32)))
    thin = F.zip_with(a["thin"], b["thin"], lambda x, y: (x + F.lit(GUARD) + sign * y).bitwiseAND(F.lit(MASK)))
    return F.struct(
        (a["paragraphs"] + sign * b["paragraphs"]).alias("paragraphs"),
        (a["sentences"] + sign * b["sentences"]).alias("sentences"),
        wide.alias("wide"),
        thin.alias("thin"),
    )


def written(f: Column) -> Column:
    """Hexadecimal text: counts (8 digits each), wide lanes (8), thin lanes (2; those of two numbers take turns)."""
    digits = lambda lanes, n: F.array_join(F.transform(lanes, lambda v: F.lower(F.lpad(F.hex(v), n, "0"))), "")
    twos = F.zip_with(halves(f["thin"], 0), halves(f["thin"], 1), lambda x, y: x.bitwiseOR(F.shiftleft(y, 8)))
    return F.concat(digits(F.array(f["paragraphs"], f["sentences"]), 8), digits(f["wide"], 8), digits(twos, 16))


def halves(items: Column, rest: int) -> Column:
    return F.filter(items, lambda x, i: i % 2 == rest)


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common sentences, 2 common / all, from 0 to 1; 1 exactly if the fingerprints are equal."""
    apart = F.zip_with(a["thin"], b["thin"], lambda x, y: F.bit_count((x.bitwiseXOR(y) + F.lit(MASK)).bitwiseAND(F.lit(GUARD))))
    counts = lambda d: F.array(*[F.aggregate(F.slice(d, 1 + SLOTS * k, SLOTS), F.lit(0), lambda t, x: t + x) for k in range(LEVELS)])

    def guess(d):
        first = F.array_position(F.transform(d, lambda n: n <= CROWDED), True)
        level = F.when(first > 0, first).otherwise(LEVELS).cast("int")
        table, times = F.array(*[F.lit(v) for v in ESTIMATE]), F.array(*[F.lit(4**k) for k in range(LEVELS)])
        return F.element_at(table, F.element_at(d, level) + 1).cast("long") * F.element_at(times, level)

    missing = F.transform(F.transform(F.array(apart), counts), guess)[0]
    total = a["sentences"] + b["sentences"]
    equal = (a["wide"] == b["wide"]) & (a["paragraphs"] == b["paragraphs"])
    # Fingerprints that differ are never called equal, however large the texts.
    some = F.greatest(missing, F.abs(a["sentences"] - b["sentences"]), F.lit(1).cast("long"))
    return F.when(equal, 1.0).when(some >= total, 0.0).otherwise(1.0 - some / total)


def with_fingerprint(df: DataFrame, text="text", out="fingerprint") -> DataFrame:
    """Append the fingerprint struct of every whole text; an input column of that name is replaced.

    It is appended as the one element of an exploded array, so that later uses of its parts
    do not work it out again.
    """
    kept = [c for c in df.columns if c != out]
    return df.select(*kept, F.explode(F.array(fingerprint(F.col(text)))).alias(out))


def with_next(df: DataFrame, id_col="doc_id", values=("text",), ties=("text",), per_part: int = 4, make=None) -> DataFrame:
    """Append next_<value>: each value of the next row in ascending id (after the last: the first).

    ``make`` may add values (DataFrame to DataFrame) once the rows are dealt out, so that these
    are not shuffled.

    Ids are cut into ranges by their exact-valued quantiles (``per_part`` for each shuffle
    partition), and the first row of a range is also dealt to the range before it. So each
    row is shuffled once and no task sees the whole table. Null ids come first; rows with
    equal ids follow each other by ``ties``. A lone row is its own next. Ids may be of any type
    that has an order, other columns may have any names; input columns next_<value> go.
    """
    parts = per_part * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.struct(F.col(id_col).isNotNull(), id_col)
    shares = [i / parts for i in range(1, parts)]
    kind = df.schema[id_col].dataType
    number = isinstance(kind, NumericType)
    cuts = F.percentile_approx(id_col, shares, 100 * parts) if number else F.lit(None).cast("array<string>")
    found = df.agg(cuts.alias("cuts"), F.min(order).alias("least")).first()
    if found["least"] is None:
        df = make(df) if make else df
        return df.withColumns({f"next_{v}": F.lit(None).cast(df.schema[v].dataType) for v in values})
    cuts = sorted({c for c in found["cuts"] or [] if c is not None})
    if not number:
        # Of ids that are no numbers, those with the smallest hashes stand for all: 20 for each range.
        some = df.filter(F.col(id_col).isNotNull()).select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(20 * parts)
        cuts = sorted(r[0] for r in some.collect())[20::20]
    first = found["least"][1]
    if not found["least"][0] or cuts[:1] != [first]:
        low = None if not found["least"][0] else first
    else:
        cuts, low = cuts[1:], first
    # The range of an id: how many cuts are not above it; two steps, so wide lists stay cheap.
    step = max(1, math.isqrt(len(cuts)))
    coarse, all_cuts = F.array(*[F.lit(c) for c in cuts[::step]]).cast(ArrayType(kind)), F.array(*[F.lit(c) for c in cuts]).cast(ArrayType(kind))
    upper = F.size(F.filter(coarse, lambda c: c <= F.col(id_col)))
    near = F.slice(all_cuts, F.greatest((upper - 1) * step + 1, F.lit(1)), F.lit(step))
    at = F.when(F.col(id_col).isNull() | (upper == 0), 0).otherwise((upper - 1) * step + F.size(F.filter(near, lambda c: c <= F.col(id_col))))
    last = len(cuts)
    starts = F.array_contains(all_cuts, F.col(id_col)) if cuts else F.lit(False)
    lowest = F.col(id_col).isNull() if low is None else F.col(id_col) == low
    place, guest, both = (free_name(n, df) for n in ("_at", "_guest", "_dealt"))
    rows = df.withColumn(place, at.cast("int"))
    own = F.struct(F.col(place).alias("at"), F.lit(False).alias("guest"))
    before = F.when(F.coalesce(lowest, F.lit(False)), F.struct(F.lit(last).alias("at"), F.lit(True).alias("guest")))
    before = before.when(F.coalesce(starts, F.lit(False)), F.struct((F.col(place) - 1).alias("at"), F.lit(True).alias("guest")))
    dealt = rows.withColumn(both, F.explode(F.filter(F.array(own, before), lambda x: x.isNotNull())))
    # Plain columns, so that the window finds the rows dealt out as it needs them.
    dealt = dealt.select(*df.columns, F.col(both)["at"].alias(place), F.col(both)["guest"].alias(guest)).repartition(place)
    dealt = make(dealt) if make else dealt
    by = Window.partitionBy(place).orderBy(guest, F.col(id_col).asc_nulls_first(), *ties)
    return dealt.withColumns({f"next_{v}": F.lead(v).over(by) for v in values}).filter(~F.col(guest)).drop(place, guest)
