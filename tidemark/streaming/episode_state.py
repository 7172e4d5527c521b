"""Episodes as keyed state on a stream, with an end: what is held shrinks when an episode is over."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.scores import DONE_TOLERANCE, FAILURE_COST
from tidemark.operators.episodes import NOT_EXECUTED

_ENTRY = (
    "task_id string, max_steps int, valid boolean, destroys boolean, failed_sql boolean, schema_match double, "
    "queries_total bigint, queries_failed bigint, data_integrity double"
)
_TOTALS = "task_id string, step int, schema_match double, queries_total bigint, queries_failed bigint, cumulative_reward double, done boolean"


def _names(kinds: str) -> list[str]:
    return [part.split()[0] for part in kinds.split(", ")]


def _prepared(steps: DataFrame, tasks: DataFrame) -> DataFrame:
    """Steps with what the fold reads, judged by themselves alone."""
    dimension = tasks.select(F.col("task_id").alias("__listed"), "max_steps")
    limited = steps.join(F.broadcast(dimension), F.col("task_id") == F.col("__listed"), "left")
    given = F.coalesce(F.col("valid"), F.lit(False)) if "valid" in steps.columns else F.lit(True)
    refused = reduce(Column.__or__, [F.col("result").startswith(mark) for mark in NOT_EXECUTED])
    destroys = F.coalesce(F.col("destroys_data"), F.lit(False)) if "destroys_data" in steps.columns else F.lit(False)
    return limited.filter(F.col("step").isNotNull()).select(
        "episode_id",
        F.col("step").cast("int").alias("step"),
        "task_id",
        F.col("max_steps").cast("int").alias("max_steps"),
        (given & F.col("__listed").isNotNull() & ~F.coalesce(refused, F.lit(False))).alias("valid"),
        destroys.alias("destroys"),
        (~F.col("result").eqNullSafe("SUCCESS")).alias("failed_sql"),
        F.col("schema_match").cast("double").alias("schema_match"),
        F.coalesce(F.col("queries_total").cast("bigint"), F.lit(0)).alias("queries_total"),
        F.coalesce(F.col("queries_failed").cast("bigint"), F.lit(0)).alias("queries_failed"),
        F.coalesce(F.col("data_integrity").cast("double"), F.lit(1.0)).alias("data_integrity"),
    )


def live_episode_states(
    steps: DataFrame, tasks: DataFrame, start_match: float = 0.0, first_step: int = 1, lateness_ms: int = 3_600_000, keep_ms: int = 86_400_000
) -> DataFrame:
    """Totals, reward and done flag per episode of a stream, by the rules of the batch.

    Each episode holds its steps, by number, so steps may come late, out of order or again. Once it is over
    and all steps from ``first_step`` to its end have come, nothing can change it: its steps are let go and
    only its totals stay, for ``keep_ms``, so that replays are known. An end with a gap before it waits
    ``lateness_ms`` for late steps. Steps that no task allows are left out before the shuffle. The limit of an
    episode is that of the task of its first step, or of an unlisted task the largest in ``tasks``. Timers go by
    the clock, so run the query with a processing-time trigger: one that stops when no data is left would wait
    for them without end. The session's state store has to be the RocksDB one.
    """
    most = tasks.agg(F.coalesce(F.max("max_steps"), F.lit(0))).first()[0]
    entry_names, total_names = _names(_ENTRY), _names(_TOTALS)
    entry_kinds, total_kinds, tolerance, cost = _ENTRY, _TOTALS, DONE_TOLERANCE, FAILURE_COST

    class Episodes(StatefulProcessor):
        """Steps of a running episode, or the totals of one that is over."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.held = handle.getMapState("steps", "step int", entry_kinds)
            self.over = handle.getValueState("over", total_kinds, keep_ms)
            self.waits = handle.getValueState("waits", "until bigint")

        def fold(self, entries: dict[int, dict[str, Any]]) -> dict[str, Any]:
            first = entries[min(entries)]
            limit = most if first["max_steps"] is None else first["max_steps"]
            now = dict(task_id=first["task_id"], step=-1, schema_match=start_match, queries_total=0, queries_failed=0, cumulative_reward=0.0, done=False)
            for step in sorted(entries):
                if now["done"] or step > limit:
                    break
                e = entries[step]
                valid = e["valid"] and e["task_id"] == now["task_id"]
                match = e["schema_match"]
                if step > 0 and valid:
                    served = 1 - (e["queries_failed"] / e["queries_total"] if e["queries_total"] else 0.0)
                    kept = 0.0 if e["destroys"] else e["data_integrity"]
                    gain = max(0.0, match - now["schema_match"]) if match is not None else 0.0
                    now["cumulative_reward"] += gain * served * kept - (cost if e["failed_sql"] else 0.0)
                    now["queries_total"] += e["queries_total"]
                    now["queries_failed"] += e["queries_failed"]
                elif step > 0:
                    now["cumulative_reward"] -= cost
                if valid and match is not None:
                    now["schema_match"] = match
                now["step"] = step
                now["done"] = step >= limit or bool(valid and step > 0 and match is not None and match >= 1 - tolerance)
            return now

        def entries(self) -> dict[int, dict[str, Any]]:
            return {key[0]: dict(zip(entry_names, value, strict=True)) for key, value in self.held.iterator()}

        def out(self, key: tuple, now: dict[str, Any]) -> Iterator[pd.DataFrame]:
            yield pd.DataFrame({"episode_id": [key[0]]} | {n: [now[n]] for n in total_names})

        def finish(self, now: dict[str, Any]) -> None:
            self.over.update(tuple(now[n] for n in total_names))
            self.held.clear()
            if self.waits.exists():
                self.handle.deleteTimer(self.waits.get()[0])
                self.waits.clear()

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
            if self.over.exists():
                for _ in rows:
                    pass
                return
            for frame in rows:
                for row in frame.astype(object).where(frame.notna(), None).to_dict("records"):
                    at = (int(row["step"]),)
                    if not self.held.containsKey(at):
                        whole = {n: None if row[n] is None else int(row[n]) for n in ("max_steps", "queries_total", "queries_failed")}
                        self.held.updateValue(at, tuple((row | whole)[n] for n in entry_names))
            entries = self.entries()
            if not entries:
                return
            now = self.fold(entries)
            if now["done"] and all(step in entries for step in range(first_step, now["step"])):
                self.finish(now)
            elif now["done"] and not self.waits.exists():
                until = timerValues.getCurrentProcessingTimeInMs() + lateness_ms
                self.handle.registerTimer(until)
                self.waits.update((until,))
            yield from self.out(key, now)

        def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
            self.waits.clear()
            entries = self.entries()
            if not entries:
                return
            now = self.fold(entries)
            if now["done"]:
                self.finish(now)
                yield from self.out(key, now)

    rows = _prepared(steps, tasks).filter(F.col("step") <= most)
    kind = rows.schema["episode_id"].dataType.simpleString()
    return rows.groupBy("episode_id").transformWithStateInPandas(
        statefulProcessor=Episodes(), outputStructType=f"episode_id {kind}, {_TOTALS}", outputMode="Update", timeMode="ProcessingTime"
    )
