import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from blocklens.functions import scale


def hot_rows(spark, n=6000):
    """A third of all rows share one key."""
    return spark.range(n).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("key"),
        F.pmod(F.xxhash64("id"), F.lit(1000)).alias("v"),
    )


def test_running_totals_match_pandas(spark):
    rows = hot_rows(spark)
    got = scale.running_totals(rows, ["v", "id"], {"total": F.col("v")}, ["key"]).toPandas()
    want = got.sort_values(["v", "id"]).groupby("key")["v"].cumsum()
    assert (got["total"] == want.reindex(got.index)).all()


def test_running_totals_without_key(spark):
    got = scale.running_totals(hot_rows(spark), F.desc("id"), {"total": F.col("v")}).toPandas()
    got = got.sort_values("id", ascending=False)
    assert (got["total"] == got["v"].cumsum()).all()


def test_hot_key_is_spread_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = scale.global_rank(hot_rows(spark), ["v", "id"], ["key"])
        sizes = ranked.filter("key = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().toPandas()["count"]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sizes.sum() == 2000
    assert len(sizes) > 1 and sizes.max() < 2000


def test_rank_does_not_depend_on_partitions(spark):
    one = scale.global_rank(hot_rows(spark).repartition(1), ["v", "id"]).toPandas()
    many = scale.global_rank(hot_rows(spark).repartition(13), ["v", "id"]).toPandas()
    assert dict(zip(one["id"], one["rank"])) == dict(zip(many["id"], many["rank"]))
    assert sorted(one["rank"]) == list(range(1, 6001))


def test_salted_lookup_equals_broadcast(spark):
    left, right = hot_rows(spark), hot_rows(spark).select("key").distinct().withColumn("label", F.upper("key"))
    right = right.filter("key <> 'k7'")
    for how in ("left", "inner"):
        wide = scale.lookup_join(left, right, "key", how, limit=0)
        small = scale.lookup_join(left, right, "key", how)
        assert sorted(map(str, wide.select(*small.columns).collect())) == sorted(map(str, small.collect()))
    plan = scale.lookup_join(left, right, "key", limit=0)._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


def test_hash_split_takes_exact_share(spark):
    rows = hot_rows(spark).withColumn("name", F.concat(F.lit("b"), F.col("id").cast("string")))
    got = scale.hash_split(rows, "name", 0.37, 7, "key", digits=1).toPandas()
    n = got.groupby("key")["selected"].agg(["sum", "count"])
    assert (n["sum"] == np.floor(0.37 * n["count"])).all()
    fine = scale.hash_split(rows.repartition(5), "name", 0.37, 7, "key").toPandas()
    assert dict(zip(got["name"], got["selected"])) == dict(zip(fine["name"], fine["selected"]))


def test_hash_split_of_nothing_and_all(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "name string")
    assert scale.hash_split(rows, "name", 0.2, 1).filter("selected").count() == 0
    assert scale.hash_split(rows, "name", 1.0, 1).filter("selected").count() == 2


def test_percentiles_match_numpy(spark):
    values = np.random.default_rng(3).normal(size=997).round(2)
    rows = spark.createDataFrame(pd.DataFrame({"x": values}))
    got = {r.fraction: r.value for r in scale.percentiles(rows, "x", [0.0, 0.5, 0.97, 1.0]).collect()}
    for q, v in got.items():
        assert abs(v - np.percentile(values, 100 * q)) < 1e-12


def test_split_of_many_strata(spark):
    """Hundreds of strata, each cut exactly."""
    rows = spark.range(3000).select(F.concat(F.lit("b"), "id").alias("block_id"), (F.col("id") % 300).cast("string").alias("label"))
    flagged = scale.hash_split(rows, "block_id", 0.5, 1, "label")
    found = flagged.groupBy("label").agg(F.count_if("selected").alias("n"), F.count(F.lit(1)).alias("all")).collect()
    assert len(found) == 300 and all(r.n == 5 and r["all"] == 10 for r in found)


def test_running_totals_of_groups_that_span_ranges(spark):
    """Groups far larger and far smaller than a range, and a null group."""
    rows = [("a", i, 1) for i in range(900)] + [(f"s{k:03d}", i, 2) for k in range(100) for i in range(3)] + [(None, i, 3) for i in range(400)]
    table = spark.createDataFrame(rows, "g string, o int, v int").repartition(5)
    got = scale.running_totals(table, "o", {"t": F.col("v")}, ["g"]).collect()
    assert len(got) == len(rows) and all(r.t == (r.o + 1) * r.v for r in got)


def test_spread_grows_with_the_rows(spark):
    """A large table in few splits gets more tasks than there are cores."""
    few = spark.range(5000).coalesce(1)
    assert scale.spread(few, rows=100).rdd.getNumPartitions() == 50
    assert scale.spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_lookup_repeats_rows_of_hot_keys_only(spark):
    """A large lookup is not copied for every salt: only the rows of keys that hold many rows are."""
    left = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.col("id")).alias("key"), F.col("id").alias("n"))
    right = spark.range(20_000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("label"))
    joined = scale.lookup_join(left, right, "key", limit=0)
    found = {r.n: r.label for r in joined.collect()}
    assert found == {n: 14 if n % 3 == 0 else n * 2 if n % 3 == 1 else None for n in range(20_000)}
    salted = []
    explode, F.explode = F.explode, lambda salts: salted.append(salts) or explode(salts)
    try:
        scale.lookup_join(left, right, "key", limit=0)
    finally:
        F.explode = explode
    hot = F.when(F.col("key") == 7, True).alias("_hot")
    assert right.select("key", hot).select(explode(salted[0])).count() == 20_000 + scale.SALTS - 1
