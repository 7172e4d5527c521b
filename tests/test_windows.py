"""Spread windows against plain ones, with a hot key, gaps and small spans."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.windows import previous_rows, running


def _log(spark):
    rng = random.Random(5)
    rows = []
    for key, n in (("hot", 400), ("a", 3), ("b", 57), ("c", 1)):
        for at in sorted(rng.sample(range(0, 5000), n)):
            rows.append((key, at, rng.choice([None, *range(10)]), f"{key}{at}"))
    return spark.createDataFrame(rows, "k string, at int, v int, name string").repartition(5)


def test_running_equals_plain_window(spark):
    log = _log(spark)
    last = F.when(F.col("v").isNotNull(), F.struct("at", "v"))
    got = running(
        log,
        ["k"],
        "at",
        {
            "total": ("sum", F.col("v"), True),
            "before": ("sum", F.col("v"), False),
            "top": ("max", F.col("v"), True),
            "seen": ("max", last, False),
        },
        span=100,
    )
    w = Window.partitionBy("k").orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    expected = log.select(
        "*",
        F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("total"),
        F.coalesce(F.sum("v").over(before), F.lit(0)).alias("before"),
        F.max("v").over(upto).alias("top"),
        F.last("v", ignorenulls=True).over(before).alias("seen"),
    )
    shown = got.withColumn("seen", F.col("seen.v"))
    assert sorted(map(str, shown.collect())) == sorted(map(str, expected.collect()))


def test_hot_key_is_spread(spark):
    hot = spark.range(20000).selectExpr("if(id >= 0, 'hot', 'x') AS k", "cast(id AS int) AS at", "1 AS v")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = running(hot, ["k"], "at", {"n": ("sum", F.col("v"), True)}, span=100)
        assert got.filter("n <> at + 1").count() == 0
        sizes = got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(r["n"] for r in sizes) < 20000 * 0.3


def test_previous_rows_equal_plain_window(spark):
    log = _log(spark)
    w = Window.partitionBy("k").orderBy("at").rowsBetween(-5, -1)
    expected = log.select("k", "at", F.collect_list("name").over(w).alias("h"))
    for span in (7, 100, 10000):
        got = previous_rows(log, ["k"], "at", F.col("name"), "h", 5, span=span).select("k", "at", "h")
        assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
