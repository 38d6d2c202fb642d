"""Line dedup by overlapping three-line windows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocklens.functions.scale import checkpointed
from blocklens.llm.words import free_name, spread_join

WINDOW = 3


def lines_of(text: Column) -> Column:
    """Lines with something but white space, trimmed: array of (at: place among all lines, line)."""
    parts = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    placed = F.transform(parts, lambda line, i: F.struct(i.alias("at"), F.regexp_replace(line, r"^[ \t-\r]+|[ \t-\r]+$", "").alias("line")))
    return F.filter(placed, lambda x: x["line"] != "")


def windows(df: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """(id, at, h): a hash of ``size`` lines in a row, blank lines left out; at counts the lines with text."""
    lines = df.select(F.col(id_col).alias("id"), F.transform(lines_of(F.col(text)), lambda x: x["line"]).alias("lines"))
    # Documents with fewer lines have no window.
    lines = lines.filter((F.size("lines") >= size) & F.col("id").isNotNull())
    starts = F.sequence(F.lit(1), F.size("lines") - (size - 1))
    made = F.transform(starts, lambda i: F.struct((i - 1).alias("at"), F.unhex(F.md5(F.array_join(F.slice("lines", i, size), "\n"))).alias("h")))
    return lines.select("id", F.explode(made).alias("w")).select("id", "w.at", "w.h")


def covered(df: DataFrame, id_col="doc_id", text="text", size: int = WINDOW) -> DataFrame:
    """(id, drop): for every document with repeated windows the places of the lines to remove, sorted.

    A window counts as seen if an equal one starts earlier, by (id, place). Positions covered
    by several windows are merged. Rows without an id take no part.
    """
    found = checkpointed(windows(df, id_col, text, size))
    seen = found.groupBy("h").agg(F.min(F.struct("id", "at")).alias("first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    seen = checkpointed(seen)
    repeated = spread_join(found, seen, "h")
    later = repeated.filter((F.col("id") != F.col("first.id")) | (F.col("at") != F.col("first.at")))
    return later.groupBy("id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.sequence("at", F.col("at") + size - 1))))).alias("drop"))


def dedup(df: DataFrame, id_col="doc_id", text="text", size: int = WINDOW) -> DataFrame:
    """Remove every later occurrence of ``size`` lines in a row that occur earlier in the corpus.

    Lines are compared without surrounding ASCII white space; blank lines count for nothing
    and stay. All input columns are kept, ``text`` is what is left, and n_lines (lines with
    text) and n_removed are appended (they replace columns of these names). A null text stays
    null; texts of fewer than ``size`` such lines and rows without an id stay as they are.
    Rows that share an id share its removed places. Other columns may have any names.
    """
    kept = [c for c in df.columns if c.lower() not in ("n_lines", "n_removed")]
    own, drop, at, gone = (free_name(n, df) for n in ("_own", "_drop", "_at", "_gone"))
    drops = covered(df, id_col, text, size).select(F.col("id").alias(own), F.col("drop").alias(drop))
    rows = df.select(*kept).join(drops, F.col(id_col) == F.col(own), "left").drop(own)
    parts = F.split(F.col(text), "\n", -1)
    rows = rows.withColumn(at, F.transform(lines_of(F.col(text)), lambda x: x["at"]))
    places = F.transform(F.col(drop), lambda place: F.get(at, place))
    rows = rows.withColumn(gone, F.filter(F.coalesce(places, F.array()), lambda place: place.isNotNull()))
    rows = rows.withColumns({"n_lines": F.size(at).cast("long"), "n_removed": F.size(gone).cast("long")})
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    bound = F.transform(F.array(F.struct(parts.alias("parts"), stay.alias("stay"))), lambda x: F.array_join(F.transform(x["stay"], lambda i: F.get(x["parts"], i)), "\n"))
    rest = F.when(F.size(gone) > 0, bound[0]).otherwise(F.col(text))
    return rows.withColumn(text, rest).select(*kept, "n_lines", "n_removed")
