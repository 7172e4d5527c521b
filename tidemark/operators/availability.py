"""Availability measured on recorded workloads (A1-A5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scores import ratio
from tidemark.functions.windows import running


def downtime_by_step(workload: DataFrame, keys: Sequence[str] = ("episode_id", "step")) -> DataFrame:
    """Background queries, failures and their share per step; 0 when there were no queries.

    ``workload`` has one row per query with ``failed``; a step without load is one row with a NULL
    ``failed``.
    """
    counts = workload.groupBy(*keys).agg(
        F.count("failed").alias("queries_total"), F.count_if("failed").alias("queries_failed")
    )
    return counts.withColumn("downtime_pct", ratio(F.col("queries_failed"), F.col("queries_total")))


def cumulative_downtime(steps: DataFrame, episode: str = "episode_id", step: str = "step") -> DataFrame:
    """Failed share of all queries up to and including each step."""
    summed = running(
        steps,
        [episode],
        step,
        {
            "total_to_date": ("sum", F.col("queries_total").cast("bigint"), True),
            "failed_to_date": ("sum", F.col("queries_failed").cast("bigint"), True),
        },
    )
    return summed.withColumn("cumulative_downtime_pct", ratio(F.col("failed_to_date"), F.col("total_to_date")))


def availability(steps: DataFrame, episode: str = "episode_id") -> DataFrame:
    """Share of queries that did not fail per episode; 1.0 when there were none."""
    counts = steps.groupBy(episode).agg(
        F.sum("queries_total").alias("queries_total"), F.sum("queries_failed").alias("queries_failed")
    )
    return counts.withColumn("availability", 1 - ratio(F.col("queries_failed"), F.col("queries_total")))


def lock_impact(
    workload: DataFrame, locks: DataFrame, on: str = "shard", span_micros: int = 60_000_000
) -> DataFrame:
    """Queries and failures inside each lock window [start, end), against the rest of its shard.

    Instead of pairing queries with windows, the bounds of the windows are placed on the shard's
    time line and read off running counts: inside = count before end - count before start. The
    cost does not depend on the overlap. Queries at the same instant are counted together on the
    map side, and a hot shard is spread over its time spans.
    """

    def point(ts: str):
        return F.unix_micros(F.col(ts).cast("timestamp"))

    placed = workload.filter(F.col(on).isNotNull() & F.col("ts").isNotNull())
    counted = placed.groupBy(on, point("ts").alias("at")).agg(
        F.count(F.lit(1)).alias("q"), F.count_if("failed").alias("f")
    )
    queries = counted.select(
        on,
        "at",
        "q",
        "f",
        F.lit(None).cast("bigint").alias("lock_id"),
        F.lit(0).alias("sign"),
        F.lit(1).alias("rank"),
    )
    # a bound counts what lies strictly before it, so it sorts ahead of queries at the same instant
    bounds = locks.select(
        on,
        "lock_id",
        F.inline(
            F.array(
                F.struct(point("start_ts").alias("at"), F.lit(-1).alias("sign")),
                F.struct(point("end_ts").alias("at"), F.lit(1).alias("sign")),
            )
        ),
    ).select(
        on,
        "at",
        F.lit(0).cast("bigint").alias("q"),
        F.lit(0).cast("bigint").alias("f"),
        F.col("lock_id").cast("bigint").alias("lock_id"),
        "sign",
        F.lit(0).alias("rank"),
    )
    line = running(
        queries.unionByName(bounds),
        [on],
        "at",
        {"q_before": ("sum", F.col("q"), False), "f_before": ("sum", F.col("f"), False)},
        span=span_micros,
        tiebreak=["rank"],
    )
    inside = (
        line.filter(F.col("lock_id").isNotNull())
        .groupBy(on, "lock_id")
        .agg(
            F.sum(F.col("sign") * F.col("q_before")).alias("in_total"),
            F.sum(F.col("sign") * F.col("f_before")).alias("in_failed"),
        )
    )
    shards = workload.groupBy(on).agg(
        F.count(F.lit(1)).alias("shard_total"), F.count_if("failed").alias("shard_failed")
    )
    both = inside.join(shards, on, "left").select(
        on,
        "lock_id",
        "in_total",
        "in_failed",
        (F.coalesce("shard_total", F.lit(0)) - F.col("in_total")).alias("out_total"),
        (F.coalesce("shard_failed", F.lit(0)) - F.col("in_failed")).alias("out_failed"),
    )
    return both.withColumn("in_share", ratio(F.col("in_failed"), F.col("in_total"))).withColumn(
        "out_share", ratio(F.col("out_failed"), F.col("out_total"))
    )


def expected_impact(stmts: DataFrame, tasks: DataFrame) -> DataFrame:
    """Queries a statement is expected to meet and to fail, from its lock profile and the task's load.

    ``tasks`` is the task dimension, of a few rows by definition. A statement of a task that is not listed
    stays, with unknown expectations.
    """
    load = F.broadcast(tasks.select("task_id", "load_level"))
    total = F.col("load_level") * F.greatest(F.lit(1), F.col("lock_ticks"))
    return (
        stmts.join(load, "task_id", "left")
        .withColumn("expected_queries", total)
        .withColumn("expected_failed", total * F.col("failure_rate"))
        .drop("load_level")
    )
