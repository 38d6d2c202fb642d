"""Leakage-free splits that depend only on (id, label, seed), never on row order."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocklens import config as C
from blocklens.functions.scale import checkpointed, hash_split
from blocklens.sources.logs import InputError


class LeakageError(ValueError):
    """Splits overlap or hold an id twice."""


def training_ids(blocks: DataFrame, ratio: float = C.TRAIN_RATIO, seed: int = C.SEED) -> DataFrame:
    """Ids of the Normal training blocks; with fewer than two Normal blocks, all of them."""
    normal = blocks.filter(F.col("label") == C.NORMAL).select("block_id")
    n = normal.limit(2).count()
    if n == 0:
        raise InputError("no Normal block to train on")
    if n < 2:
        return normal
    return hash_split(normal, "block_id", ratio, seed).filter("selected").select("block_id")


def holdout(scored: DataFrame, training: DataFrame) -> DataFrame:
    """Scored blocks that were not trained on."""
    return scored.join(training.select("block_id"), "block_id", "left_anti")


def validation_test(blocks: DataFrame, ratio: float = C.VALIDATION_RATIO, seed: int = C.SEED) -> DataFrame:
    """Add ``split`` (validation or test), stratified by label; tiny inputs are all test."""
    if blocks.limit(4).count() < 4:
        return blocks.withColumn("split", F.lit("test"))
    flagged = hash_split(blocks, "block_id", ratio, seed, "label")
    split = F.when(F.col("selected"), "validation").otherwise("test")
    return flagged.withColumn("split", split).drop("selected")


def assign_splits(blocks: DataFrame, seed: int = C.SEED) -> DataFrame:
    """block_id, label, split for every labelled block: train, validation or test."""
    blocks = checkpointed(blocks.select("block_id", "label").filter(F.col("label").isNotNull()))
    normal = F.col("label") == C.NORMAL
    n = blocks.filter(normal).limit(2).count()
    if n == 0:
        raise InputError("no Normal block to train on")
    # The same cut as ``training_ids``, taken as a flag: no join takes the training blocks out again.
    flagged = hash_split(blocks, "block_id", C.TRAIN_RATIO, seed, "label", name="_train")
    train = normal & (F.col("_train") if n > 1 else F.lit(True))
    rest = flagged.filter(~train).drop("_train")
    return flagged.filter(train).select("block_id", "label", F.lit("train").alias("split")).unionByName(validation_test(rest, seed=seed))


def leakage(splits: DataFrame) -> DataFrame:
    """Pairwise overlaps and duplicate ids, from one aggregation by id."""
    names = ("train", "validation", "test")
    per_id = splits.groupBy("block_id").agg(
        *[F.count_if(F.col("split") == s).alias(s) for s in names]
    )
    both = lambda a, b: F.count_if((F.col(a) > 0) & (F.col(b) > 0))
    extra = lambda s: F.coalesce(F.sum(F.greatest(F.col(s) - 1, F.lit(0))), F.lit(0))
    return per_id.agg(
        both("train", "validation").alias("train_validation_overlap"),
        both("train", "test").alias("train_test_overlap"),
        both("validation", "test").alias("validation_test_overlap"),
        *[extra(s).alias(f"{s}_duplicates") for s in names],
    )


def require_no_leakage(splits: DataFrame) -> DataFrame:
    found = leakage(splits).first().asDict()
    bad = {k: v for k, v in found.items() if v}
    if bad:
        raise LeakageError(f"splits leak: {bad}")
    return splits


def population(splits: DataFrame) -> DataFrame:
    """Blocks per split and label."""
    return splits.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n_blocks"))


def population_report(scored: DataFrame, splits: DataFrame) -> DataFrame:
    """One row: scored blocks, training and validation excluded, evaluated by label."""
    rows = scored.select("block_id").join(splits, "block_id")
    test = F.col("split") == "test"
    return rows.agg(
        F.count(F.lit(1)).alias("total_blocks"),
        F.count_if(F.col("split") == "train").alias("training_excluded"),
        F.count_if(F.col("split") == "validation").alias("validation_excluded"),
        F.count_if(test).alias("evaluated_blocks"),
        F.count_if(test & (F.col("label") == C.NORMAL)).alias("evaluated_normal"),
        F.count_if(test & (F.col("label") == C.ANOMALY)).alias("evaluated_anomaly"),
    )
