"""Block features as sparse vectors: one column whatever the number of templates.

A vector is ``cells``, an array of (i, v) sorted by i, for the values that are not 0; what i
stands for is a table (feature, i). Neither feature names nor pairs of features ever reach
the driver.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocklens import config as C
from blocklens.functions.scale import checkpointed, global_rank, lookup_join
from blocklens.operators.features import base_features, partial_counts, template_column, template_counts_long


def feature_index(dictionary: DataFrame) -> DataFrame:
    """(feature, i, event_id): the base features from 0 on, then one count for each template in text order."""
    spark = dictionary.sparkSession
    base = spark.createDataFrame([(f, i, None) for i, f in enumerate(C.BASE_FEATURES)], "feature string, i long, event_id string")
    ranked = global_rank(dictionary.select("event_id").distinct(), "event_id", name="i")
    before, after = template_column("|").split("|")
    name = F.concat(F.lit(before), "event_id", F.lit(after))
    return base.unionByName(ranked.select(name.alias("feature"), (F.col("i") + len(C.BASE_FEATURES) - 1).alias("i"), "event_id"))


def _packed(cells: DataFrame) -> DataFrame:
    """(block_id, cells) from (block_id, i, v); a block has at most a cell for each feature."""
    kept = F.filter(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c["v"] != 0)
    return cells.groupBy("block_id").agg(kept.alias("cells"))


def block_vectors(events: DataFrame, index: DataFrame) -> DataFrame:
    """(block_id, cells) of every block: base features and template counts, from pre-aggregated lines."""
    partial = checkpointed(partial_counts(events))
    values = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.col(f).cast("double").alias("v")) for i, f in enumerate(C.BASE_FEATURES)])
    base = base_features(partial).select("block_id", F.inline(values))
    templates = index.filter("event_id IS NOT NULL").select("event_id", "i")
    counts = lookup_join(template_counts_long(partial), templates, "event_id", "inner")
    return _packed(base.unionByName(counts.select("block_id", "i", F.col("n").cast("double").alias("v"))))


def from_matrix(matrix: DataFrame, columns) -> DataFrame:
    """(block_id, cells) of a table with one column for each feature; missing values are 0."""
    values = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias("v")) for i, c in enumerate(columns)])
    return matrix.select("block_id", F.filter(values, lambda c: c["v"] != 0).alias("cells"))


def moments(vectors: DataFrame, index: DataFrame) -> DataFrame:
    """(i, n, lo, hi, total, squares) of every feature over all blocks, those without a cell included."""
    cells = vectors.select(F.inline("cells"))
    own = cells.groupBy("i").agg(F.count(F.lit(1)).alias("held"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("v").alias("total"), F.sum(F.col("v") * F.col("v")).alias("squares"))
    blocks = F.broadcast(vectors.agg(F.count(F.lit(1)).alias("n")))  # one row
    table = index.select("i").join(own, "i", "left").crossJoin(blocks)
    zeros = F.coalesce("held", F.lit(0)) < F.col("n")
    low, high = F.coalesce("lo", F.lit(0.0)), F.coalesce("hi", F.lit(0.0))
    return table.select(
        "i", "n", F.when(zeros, F.least(low, F.lit(0.0))).otherwise(low).alias("lo"), F.when(zeros, F.greatest(high, F.lit(0.0))).otherwise(high).alias("hi"),
        F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("squares", F.lit(0.0)).alias("squares"),
    )


def scale_min_max(vectors: DataFrame, scaler: DataFrame) -> DataFrame:
    """Scale every cell by ``scaler`` (i, lo, hi); constant features become 0 and drop out.

    A value that is not there stays 0, which is what it scales to as long as no value is
    negative; a scaler with a negative bound is an error.
    """
    checked = F.when(F.col("lo") < 0, F.raise_error(F.lit("sparse scaling needs values of 0 and more"))).otherwise(F.col("lo"))
    # A feature that every block has may start above 0; cells missing later are 0 all the same.
    cells = lookup_join(vectors.select("block_id", F.inline("cells")), scaler.select("i", checked.alias("lo"), "hi"), "i", "inner")
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    packed = _packed(cells.select("block_id", "i", scaled.alias("v")))
    empty = F.array().cast(packed.schema["cells"].dataType)
    return vectors.select("block_id").join(packed, "block_id", "left").withColumn("cells", F.coalesce("cells", empty))


def products(vectors: DataFrame) -> DataFrame:
    """(i, j, product) for i < j: sums over all blocks of the products of two cells.

    Pairs are made block by block and summed up where they are made, so only pairs that occur
    together are ever there, and no block's pairs are held at once.
    """
    one = vectors.select("cells", F.posexplode("cells").alias("k", "a"))
    two = one.select("a", F.explode(F.slice("cells", F.col("k") + 2, F.size("cells"))).alias("b"))
    return two.groupBy(F.col("a.i").alias("i"), F.col("b.i").alias("j")).agg(F.sum(F.col("a.v") * F.col("b.v")).alias("product"))


def _pearson(pairs: DataFrame) -> DataFrame:
    """r from moments (x_..., y_...) and product; NULL where either is constant."""
    n = F.col("x_n")
    spread = lambda k: n * F.col(f"{k}_squares") - F.col(f"{k}_total") * F.col(f"{k}_total")
    r = (n * F.coalesce("product", F.lit(0.0)) - F.col("x_total") * F.col("y_total")) / F.sqrt(spread("x") * spread("y"))
    varies = (F.col("x_hi") > F.col("x_lo")) & (F.col("y_hi") > F.col("y_lo"))
    return pairs.select("i", "j", F.when(varies, F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))).alias("r"))


def _side(table: DataFrame, name: str, key: str) -> DataFrame:
    return table.select(F.col("i").alias(key), *[F.col(c).alias(f"{name}_{c}") for c in ("n", "lo", "hi", "total", "squares")])


def correlations(vectors: DataFrame, index: DataFrame) -> DataFrame:
    """(i, j, r) of every pair i < j of features; as many rows as there are pairs."""
    table = checkpointed(moments(vectors, index))
    pairs = _side(table, "x", "i").join(_side(table, "y", "j"), F.col("i") < F.col("j"))
    return _pearson(pairs.join(products(vectors), ["i", "j"], "left"))


def strong_pairs(vectors: DataFrame, index: DataFrame, limit=C.CORRELATION_LIMIT) -> DataFrame:
    """(i, j, r) of the pairs with ``|r|`` beyond ``limit``, without looking at all pairs.

    Pairs that occur together come from ``products``. Two features that never do have
    r = -(mean/deviation of one) x (mean/deviation of the other), so one of these ratios has to
    be at least the root of the limit: few features are that frequent, and only they are held
    against all others.
    """
    table = checkpointed(moments(vectors, index).filter("hi > lo"))
    met = checkpointed(products(vectors))
    together = met.join(_side(table, "x", "i"), "i").join(_side(table, "y", "j"), "j")
    ratio = F.col("total") / F.sqrt(F.col("n") * F.col("squares") - F.col("total") * F.col("total"))
    rated = table.withColumn("ratio", ratio)
    often = rated.filter(F.col("ratio") >= float(np.sqrt(limit)) * 0.999).select(F.col("i").alias("f"), F.col("ratio").alias("f_ratio"))
    apart = rated.select(F.col("i").alias("g"), F.col("ratio").alias("g_ratio")).join(often, (F.col("f") != F.col("g")) & (F.col("f_ratio") * F.col("g_ratio") >= limit * 0.999))
    apart = apart.select(F.least("f", "g").alias("i"), F.greatest("f", "g").alias("j")).distinct().join(met.select("i", "j"), ["i", "j"], "left_anti")
    apart = apart.join(_side(table, "x", "i"), "i").join(_side(table, "y", "j"), "j").withColumn("product", F.lit(0.0))
    return _pearson(together.unionByName(apart)).filter(F.abs("r") > limit)


def selection(vectors: DataFrame, index: DataFrame, limit=C.CORRELATION_LIMIT, floor=C.VARIANCE_FLOOR) -> DataFrame:
    """(i, variance, n_correlated, selected): as ``selection.selection``, for any number of features."""
    table = moments(vectors, index)
    variance = (F.col("squares") - F.col("total") * F.col("total") / F.col("n")) / (F.col("n") - 1)
    variance = F.when(F.col("n") > 1, F.when(F.col("hi") > F.col("lo"), variance).otherwise(0.0))
    strong = strong_pairs(vectors, index, limit).groupBy(F.col("j").alias("i")).agg(F.count(F.lit(1)).alias("n_correlated"))
    out = table.select("i", variance.alias("variance")).join(strong, "i", "left").withColumn("n_correlated", F.coalesce("n_correlated", F.lit(0)))
    return out.withColumn("selected", (F.col("n_correlated") == 0) & (F.coalesce("variance", F.lit(0.0)) >= floor))


def kept_only(vectors: DataFrame, chosen: DataFrame, index: DataFrame):
    """Vectors and index of the features in ``chosen`` (i) only, renumbered without gaps."""
    renumbered = checkpointed(global_rank(chosen.select("i"), "i", name="to").withColumn("to", F.col("to") - 1))
    cells = lookup_join(vectors.select("block_id", F.inline("cells")), renumbered, "i", "inner")
    packed = _packed(cells.select("block_id", F.col("to").alias("i"), "v"))
    empty = F.array().cast(packed.schema["cells"].dataType)
    rows = vectors.select("block_id").join(packed, "block_id", "left").withColumn("cells", F.coalesce("cells", empty))
    return rows, index.join(renumbered, "i").drop("i").withColumnRenamed("to", "i")


def dense_rows(cells: pa.Array, width: int) -> np.ndarray:
    """A batch of ``cells`` as rows of ``width`` numbers, for models inside a task."""
    flat, size = cells.flatten(), np.diff(cells.offsets.to_numpy())
    out = np.zeros((len(cells), width))
    out[np.repeat(np.arange(len(cells)), size), flat.field("i").to_numpy()] = flat.field("v").to_numpy()
    return out
