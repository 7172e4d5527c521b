"""The same measures on unbounded logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.digest import bucket_of
from tidemark.functions.scores import DONE_TOLERANCE, FAILURE_COST, ratio
from tidemark.operators.episodes import NOT_EXECUTED
from tidemark.operators.migrate import BUCKET


def live_availability(
    workload: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "1 day", by: tuple[str, ...] = ()
) -> DataFrame:
    """Queries, failures and availability per time window; works on streams and on tables.

    ``workload`` holds (ts, failed). On a stream, rows later than ``delay`` are dropped and a window
    is emitted once the watermark has passed it.
    """
    timed = workload.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", delay)
    frame = F.window("ts", size, slide) if slide else F.window("ts", size)
    counts = timed.groupBy(frame.alias("w"), *by).agg(
        F.count(F.lit(1)).alias("queries_total"), F.count_if("failed").alias("queries_failed")
    )
    return counts.select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        *by,
        "queries_total",
        "queries_failed",
        (1 - ratio(F.col("queries_failed"), F.col("queries_total"))).alias("availability"),
    )


def _state(step: Column, match: Column, total: Column, failed: Column, reward: Column, done: Column) -> Column:
    return F.struct(
        step.cast("int").alias("step"),
        match.cast("double").alias("schema_match"),
        total.cast("bigint").alias("queries_total"),
        failed.cast("bigint").alias("queries_failed"),
        reward.cast("double").alias("cumulative_reward"),
        done.cast("boolean").alias("done"),
    )


def _advance(state: Column, entry: Column, limit: Column) -> Column:
    """The state of an episode after one more step; a step not newer than the last is a replay."""
    step, valid, now = entry["step"], entry["valid"], entry["schema_match"]
    counted = valid & (step > 0)
    served = 1 - ratio(entry["queries_failed"], entry["queries_total"])
    kept = F.when(entry["destroys"], F.lit(0.0)).otherwise(entry["data_integrity"])
    gain = F.greatest(F.lit(0.0), now - state["schema_match"]) * served * kept
    reward = (
        F.when(step == 0, F.lit(0.0))
        .when(~valid, F.lit(-FAILURE_COST))
        .otherwise(gain - F.when(entry["result"] == "SUCCESS", F.lit(0.0)).otherwise(F.lit(FAILURE_COST)))
    )
    after = _state(
        step,
        F.when(valid, now).otherwise(state["schema_match"]),
        state["queries_total"] + F.when(counted, entry["queries_total"]).otherwise(0),
        state["queries_failed"] + F.when(counted, entry["queries_failed"]).otherwise(0),
        state["cumulative_reward"] + reward,
        (step >= limit) | (counted & (now >= 1 - DONE_TOLERANCE)),
    )
    return F.when(state["done"] | (step <= state["step"]), state).otherwise(after)


def live_episodes(steps: DataFrame, tasks: DataFrame, start_match: float = 0.0) -> DataFrame:
    """Totals, reward and done flag per episode, updated as steps arrive; works on streams and on tables.

    The stream keeps the allowed steps of each episode as its state and folds them by the same rules
    as the batch: the task of the first step is that of the episode and sets its limit, and steps of
    other or unlisted tasks are invalid actions. Steps beyond the largest limit in ``tasks`` cannot change an episode and are left out before the shuffle, and copies of a step
    collapse on the map side, so neither an endless log nor a log delivered many times can grow the
    state or burden a single task.
    """
    # one number, read when the plan is made: a stream's plan cannot ask a subquery
    most_steps = tasks.agg(F.coalesce(F.max("max_steps"), F.lit(0))).first()[0]
    dimension = tasks.select(F.col("task_id").alias("__listed"), "max_steps")
    limited = steps.join(F.broadcast(dimension), F.col("task_id") == F.col("__listed"), "left")
    given = F.coalesce(F.col("valid"), F.lit(False)) if "valid" in steps.columns else F.lit(True)
    failed = reduce(Column.__or__, [F.col("result").startswith(mark) for mark in NOT_EXECUTED])
    valid = given & F.col("__listed").isNotNull() & ~F.coalesce(failed, F.lit(False))
    destroys = F.coalesce(F.col("destroys_data"), F.lit(False)) if "destroys_data" in steps.columns else F.lit(False)
    entry = F.struct(
        F.col("step").cast("int").alias("step"),
        "task_id",
        "max_steps",
        valid.alias("valid"),
        destroys.alias("destroys"),
        "result",
        F.col("schema_match").cast("double").alias("schema_match"),
        F.col("queries_total").cast("bigint").alias("queries_total"),
        F.col("queries_failed").cast("bigint").alias("queries_failed"),
        F.col("data_integrity").cast("double").alias("data_integrity"),
    )
    kept = (
        limited.filter(F.col("step") <= most_steps)
        .groupBy("episode_id")
        .agg(F.array_sort(F.collect_set(entry)).alias("entries"))
        .withColumn("own", F.get("entries", F.lit(0)))
    )
    start = _state(F.lit(-1), F.lit(start_match), F.lit(0), F.lit(0), F.lit(0.0), F.lit(False))
    limit = F.coalesce(F.col("own.max_steps"), F.lit(most_steps))

    def of_own_task(entry: Column) -> Column:
        return entry.withField("valid", entry["valid"] & entry["task_id"].eqNullSafe(F.col("own.task_id")))

    folded = F.aggregate(
        F.transform("entries", of_own_task), start, lambda state, entry: _advance(state, entry, limit)
    )
    return kept.select("episode_id", F.col("own.task_id").alias("task_id"), folded.alias("__state")).select(
        "episode_id", "task_id", "__state.*"
    )


def catch_up(source: DataFrame, key: str, modulus: int, path: str, checkpoint: str) -> StreamingQuery:
    """Append the source's new rows to the bucketed layout, each batch exactly once.

    Every batch writes its own folder below ``path`` and overwrites it when it is run again, so a
    batch that failed half-way leaves no duplicates. Buckets are folders within the batch.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        # one task writes few buckets, and adaptive execution splits a large one
        bucketed = batch.withColumn(BUCKET, bucket_of(F.col(key), modulus)).hint("rebalance", BUCKET)
        bucketed.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/batch={batch_id}")

    return (
        source.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
