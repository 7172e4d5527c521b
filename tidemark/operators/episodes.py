"""Scores of migration runs.

An episode is one run of one task, a step is one submitted statement. A task allows a fixed number
of steps, so what an episode does is bounded, while its log may go on for ever. Windows therefore
cover the steps that any task allows; rows beyond them are spread over tasks by step and take the final
state of their episode. The task of an episode, and with it its limit, is that of its first step: a
step of another task, or of one that is not listed, is an invalid action of the episode it came in.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scores import DONE_TOLERANCE, FAILURE_COST, PASS_SCORE, bounded, feedback, ratio, unit
from tidemark.functions.text import normalize_sql
from tidemark.functions.windows import previous_rows
from tidemark.sources.logs import NO_OP_SQL
from tidemark.sources.tables import is_small

# Fixed values: (task, difficulty, load per tick, steps allowed) and step results that are no errors.
TASKS = [
    ("easy_add_column", "easy", 30, 5),
    ("medium_rename_fk", "medium", 20, 6),
    ("hard_repartition", "hard", 30, 8),
]
NO_ERROR = ("SUCCESS", "RESET", "EPISODE_DONE")
# How results begin of actions that were refused or failed before they ran.
NOT_EXECUTED = ("TASK_ID_MISMATCH", "EXECUTION_ERROR")
NO_EPISODE = "No active episode for this task"
OTHER_EPISODE = "Episode ID mismatch for this task"
# Planned statements of the create-copy-swap task.
SWAP_PLAYBOOK = [
    "CREATE TABLE events_new (id BIGSERIAL, user_id INTEGER NOT NULL, event_type VARCHAR(50), payload JSONB, "
    "created_at TIMESTAMP NOT NULL) PARTITION BY HASH (user_id);",
    "CREATE TABLE events_p0 PARTITION OF events_new FOR VALUES WITH (MODULUS 2, REMAINDER 0);",
    "CREATE TABLE events_p1 PARTITION OF events_new FOR VALUES WITH (MODULUS 2, REMAINDER 1);",
    "INSERT INTO events_new (id, user_id, event_type, payload, created_at) "
    "SELECT id, user_id, event_type, payload, created_at FROM events;",
    "ALTER TABLE events RENAME TO events_old;",
    "ALTER TABLE events_new RENAME TO events;",
    "DROP TABLE events_old CASCADE;",
]
# Planned statements of the column and foreign key tasks.
ADD_EMAIL = "ALTER TABLE users ADD COLUMN email VARCHAR(255) DEFAULT NULL;"
ADD_ACTIVE = "ALTER TABLE users ADD COLUMN is_active BOOLEAN DEFAULT TRUE;"
DROP_ORDERS_FK = "ALTER TABLE orders DROP CONSTRAINT fk_orders_users;"
RENAME_USERS_ID = "ALTER TABLE users RENAME COLUMN id TO user_id;"
ADD_ORDERS_FK = (
    "ALTER TABLE orders ADD CONSTRAINT fk_orders_users FOREIGN KEY (user_id) REFERENCES users(user_id);"
)

_TAIL_SPAN = 65536


def tasks_dim(spark: SparkSession) -> DataFrame:
    """The task dimension: one row per task."""
    return spark.createDataFrame(TASKS, "task_id string, difficulty string, load_level int, max_steps int")


def largest_limit(tasks: DataFrame) -> Column:
    """The most steps that any task allows, as a scalar subquery."""
    return tasks.select(F.max("max_steps")).scalar()


def _spread(steps: DataFrame, tasks: DataFrame) -> DataFrame:
    """Add ``__span`` (0 for steps that some task allows, other numbers beyond them), and by the episode's
    own task ``__limit``, ``__valid`` and ``__ends``. One shuffle, by episode and span."""
    dimension = tasks.select(F.col("task_id").alias("__listed"), F.col("max_steps").alias("__max"))
    most = largest_limit(tasks)
    beyond = (F.floor(F.col("step") / F.lit(_TAIL_SPAN)) + 1).cast("bigint")
    rows = steps.join(F.broadcast(dimension), F.col("task_id") == F.col("__listed"), "left").withColumn(
        "__span", F.when(F.col("step") <= most, F.lit(0)).otherwise(beyond)
    )
    upto = Window.partitionBy("episode_id", "__span").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.col("__listed").isNotNull() & (F.col("__listed") == F.col("__own"))
    failed = F.coalesce(reduce(Column.__or__, [F.col("result").startswith(mark) for mark in NOT_EXECUTED]), F.lit(False))
    given = F.coalesce(F.col("valid"), F.lit(False)) if "valid" in steps.columns else F.lit(True)
    owned = rows.withColumns(
        {"__own": F.first("task_id").over(upto), "__limit": F.coalesce(F.first("__max").over(upto), most)}
    )
    judged = owned.withColumn("__valid", given & F.coalesce(known, F.lit(False)) & ~failed)
    complete = F.col("__valid") & (F.col("step") > 0) & (F.col("schema_match") >= 1 - DONE_TOLERANCE)
    return judged.withColumn("__ends", (F.col("step") >= F.col("__limit")) | F.coalesce(complete, F.lit(False)))


def _masked(spread: DataFrame) -> DataFrame:
    before = Window.partitionBy("episode_id", "__span").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max("__ends").over(before), F.lit(False))
    return spread.withColumn("masked", (F.col("__span") > 0) | (F.col("step") > F.col("__limit")) | ended)


def mark_done(steps: DataFrame, tasks: DataFrame) -> DataFrame:
    """Add ``done`` (the episode has ended with this step) and ``masked`` (it had ended before).

    An episode ends at its last allowed step or when its schema is complete. An invalid step ends
    it only by its number. One shuffle, by episode and span.
    """
    marked = _masked(_spread(steps, tasks))
    return marked.select(*steps.columns, (F.col("__ends") | F.col("masked")).alias("done"), "masked")


def step_rewards(steps: DataFrame, tasks: DataFrame, start_match: float = 0.0) -> DataFrame:
    """Reward, done flag and running totals of each step.

    ``steps`` holds (episode_id, task_id, step, result, schema_match, queries_total, queries_failed,
    data_integrity) and optionally ``valid`` and ``destroys_data``. The reward is the gain in match, times
    the share of queries served, times integrity; a failed statement costs 0.05, and so does an
    invalid action, which adds no load: one that is marked so, was not executed, or is of another task
    than its episode. Steps after the end are ``masked``: they are worth nothing and repeat the final
    totals. One shuffle by episode, and a join of the final totals for steps that no task allows.
    """
    destroys = F.coalesce(F.col("destroys_data"), F.lit(False)) if "destroys_data" in steps.columns else F.lit(False)
    window = Window.partitionBy("episode_id").orderBy("step")
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    spread = _spread(steps, tasks).withColumn("__match", F.when(F.col("__valid"), F.col("schema_match")))
    seen = _masked(spread.filter(F.col("__span") == 0)).select(
        "*",
        F.coalesce(F.last("__match", ignorenulls=True).over(before), F.lit(start_match)).alias("previous_match"),
    )
    counted = F.col("__valid") & ~F.col("masked") & (F.col("step") > 0)
    gain = F.greatest(F.lit(0.0), F.col("schema_match") - F.col("previous_match"))
    served = 1 - ratio(F.col("queries_failed"), F.col("queries_total"))
    kept = F.when(destroys, F.lit(0.0)).otherwise(F.col("data_integrity"))
    cost = F.when(F.col("result") == "SUCCESS", F.lit(0.0)).otherwise(F.lit(FAILURE_COST))
    reward = (
        F.when(F.col("masked") | (F.col("step") == 0), F.lit(0.0))
        .when(~F.col("__valid"), F.lit(-FAILURE_COST))
        .otherwise(gain * served * kept - cost)
    )
    rewarded = seen.withColumns(
        {
            "reward": reward,
            "downtime_pct": F.when(counted, 1 - served).otherwise(F.lit(0.0)),
            "__total": F.when(counted, F.col("queries_total")).otherwise(0).cast("bigint"),
            "__failed": F.when(counted, F.col("queries_failed")).otherwise(0).cast("bigint"),
            "__seen": F.when(~F.col("masked"), F.col("__match")),
            "__kept": F.when(counted, F.col("data_integrity")),
        }
    )
    live = [
        F.sum("reward").over(upto).alias("cumulative_reward"),
        F.sum("__total").over(upto).alias("total_to_date"),
        F.sum("__failed").over(upto).alias("failed_to_date"),
        F.coalesce(F.last("__seen", ignorenulls=True).over(upto), F.lit(start_match)).alias("match_to_date"),
        F.coalesce(F.last("__kept", ignorenulls=True).over(upto), F.lit(1.0)).alias("integrity_to_date"),
    ]
    totals = ["cumulative_reward", "total_to_date", "failed_to_date", "match_to_date", "integrity_to_date"]
    result = F.when(F.col("masked"), F.lit("EPISODE_DONE")).otherwise(F.col("result")).alias("result")
    own = [c if c != "result" else result for c in steps.columns]
    done = (F.col("__ends") | F.col("masked")).alias("done")
    allowed = rewarded.select(*own, done, "masked", "downtime_pct", "reward", *live)
    beyond = steps.filter(F.col("step") > largest_limit(tasks))
    final = allowed.groupBy("episode_id").agg(F.max_by(F.struct(*totals), "step").alias("__final"))
    ended = [c if c != "result" else F.lit("EPISODE_DONE").alias("result") for c in steps.columns]
    nothing = [F.lit(0.0).alias("downtime_pct"), F.lit(0.0).alias("reward")]
    return allowed.unionByName(
        beyond.select(*ended, F.lit(True).alias("done"), F.lit(True).alias("masked"), *nothing)
        .join(final, "episode_id", "left")
        .select(*steps.columns, "done", "masked", "downtime_pct", "reward", "__final.*")
    )


def cumulative_reward(rewards: DataFrame) -> DataFrame:
    """Running reward per step, as published and raw."""
    return rewards.select(
        "episode_id",
        "step",
        "reward",
        "cumulative_reward",
        bounded(F.col("reward")).alias("public_reward"),
        bounded(F.col("cumulative_reward")).alias("public_cumulative_reward"),
    )


def final_states(rewards: DataFrame) -> DataFrame:
    """One row per episode with its final match, integrity, availability and reward."""
    last = rewards.filter(~F.col("masked")).groupBy("episode_id").agg(
        F.min_by("task_id", "step").alias("task_id"),
        F.max_by(
            F.struct(
                F.col("step").alias("steps"),
                "done",
                F.col("match_to_date").alias("schema_match"),
                F.col("integrity_to_date").alias("data_integrity"),
                F.col("total_to_date").alias("queries_total"),
                F.col("failed_to_date").alias("queries_failed"),
                "cumulative_reward",
            ),
            "step",
        ).alias("__state")
    )
    return last.select("episode_id", "task_id", "__state.*").withColumn(
        "availability", 1 - ratio(F.col("queries_failed"), F.col("queries_total"))
    )


def score(match: Column, integrity: Column, availability: Column) -> Column:
    """Bounded score of an episode."""
    return bounded(match * integrity * availability)


def episode_scores(episodes: DataFrame) -> DataFrame:
    """Add the score and the feedback label of each episode, from raw measures."""
    match, kept, served = F.col("schema_match"), F.col("data_integrity"), F.col("availability")
    return episodes.withColumn("score", score(match, kept, served)).withColumn(
        "feedback", feedback(match, bounded(served), kept)
    )


# Inputs without which a grade falls to its floor.
GRADER_KEYS = (
    "current_schema_ddl",
    "target_schema_ddl",
    "data_hash_before",
    "data_hash_after",
    "availability_pct",
)


def coerce_inputs(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Grader inputs from a JSON object: clean values, and whether all five were given.

    Missing or null texts become empty, an availability that is no number becomes 0, and it is
    clamped to [0, 1]. A given null counts as given.
    """
    names = F.json_object_keys(F.col(payload))
    complete = F.coalesce(F.size(F.array_intersect(names, F.array(*map(F.lit, GRADER_KEYS)))) == len(GRADER_KEYS), F.lit(False))
    texts = [
        F.coalesce(F.get_json_object(payload, f"$.{key}"), F.lit("")).alias(key) for key in GRADER_KEYS[:-1]
    ]
    served = F.trim(F.get_json_object(payload, f"$.{GRADER_KEYS[-1]}")).try_cast("double")
    return df.select(
        *[c for c in df.columns if c != payload],
        *texts,
        unit(F.coalesce(F.nanvl(served, F.lit(0.0)), F.lit(0.0))).alias(GRADER_KEYS[-1]),
        complete.alias("complete"),
    )


def grade_inputs(inputs: DataFrame, match: str = "schema_match") -> DataFrame:
    """Score coerced inputs whose schema match is known; incomplete inputs get the floor."""
    same = F.when(F.col("data_hash_before") == F.col("data_hash_after"), 1.0).otherwise(0.0)
    raw = F.col(match) * same * F.col("availability_pct")
    return inputs.withColumn("score", bounded(F.when(F.col("complete"), raw).otherwise(0.0)))


def step_info(rewards: DataFrame) -> DataFrame:
    """What is published about each step: bounded measures, last error, and success."""
    served = 1 - ratio(F.col("failed_to_date"), F.col("total_to_date"))
    points = score(F.col("match_to_date"), F.col("integrity_to_date"), served)
    return rewards.select(
        "episode_id",
        "task_id",
        "step",
        points.alias("score"),
        bounded(F.col("match_to_date")).alias("schema_match"),
        bounded(served).alias("availability"),
        bounded(F.col("integrity_to_date")).alias("data_integrity"),
        F.when(~F.col("result").isin(*NO_ERROR), F.col("result")).alias("last_error"),
        (points >= PASS_SCORE).alias("success"),
    )


def latest_episode(resets: DataFrame, order: str = "reset_ts", carry: Sequence[str] = ()) -> DataFrame:
    """The episode of each task that was reset last (the greater id on ties), with columns to carry along.

    One aggregate with map-side combine: each task sends one row per input partition.
    """
    last = resets.groupBy("task_id").agg(F.max(F.struct(order, "episode_id", *carry)).alias("__last"))
    return last.select("task_id", "__last.episode_id", f"__last.{order}", *[f"__last.{c}" for c in carry])


def resolve_grades(requests: DataFrame, current: DataFrame) -> DataFrame:
    """Answer grade requests from the current, scored episode of each task.

    ``requests`` holds (request_id, task_id, episode_id or NULL/''); ``current`` has one scored episode
    per task. A task without an episode, or another episode than asked for, gets the floor. The input
    runs once: adaptive execution sees how few rows ``current`` comes to and broadcasts them then.
    """
    known = current.select(
        "task_id",
        F.col("episode_id").alias("current_episode_id"),
        F.col("score").alias("__score"),
        F.col("feedback").alias("__feedback"),
    )
    joined = requests.join(known, "task_id", "left")
    asked = F.col("episode_id").cast("string")
    none = F.col("current_episode_id").isNull()
    other = (F.coalesce(asked, F.lit("")) != "") & (asked != F.col("current_episode_id").cast("string"))
    return joined.select(
        *requests.columns,
        F.when(none | other, bounded(F.lit(0.0))).otherwise(F.col("__score")).alias("score"),
        F.when(none, NO_EPISODE).when(other, OTHER_EPISODE).otherwise(F.col("__feedback")).alias("feedback"),
    )


def run_summary(rewards: DataFrame) -> DataFrame:
    """Steps, final score, success and ordered rewards of each run.

    A run takes no step after its end, so the reward list is as short as its task allows.
    """
    taken = rewards.filter(~F.col("masked") & (F.col("step") > 0))
    served = 1 - ratio(F.col("failed_to_date"), F.col("total_to_date"))
    points = score(F.col("match_to_date"), F.col("integrity_to_date"), served)
    runs = taken.select("episode_id", "task_id", "step", bounded(F.col("reward")).alias("r"), points.alias("p"))
    return runs.groupBy("episode_id").agg(
        F.min_by("task_id", "step").alias("task_id"),
        F.count(F.lit(1)).alias("steps"),
        F.max_by("p", "step").alias("score"),
        (F.max_by("p", "step") >= PASS_SCORE).alias("success"),
        F.transform(F.array_sort(F.collect_list(F.struct("step", "r"))), lambda e: e["r"]).alias("rewards"),
    )


def recent_history(steps: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` steps before each step, oldest first, as (sql, result, schema_match)."""
    item = F.struct(normalize_sql(F.col("sql")).alias("sql"), "result", "schema_match")
    return previous_rows(steps, ["episode_id"], "step", item, "history", n)


def playbook(spark: SparkSession, task_id: str, statements: Sequence[str]) -> DataFrame:
    """Planned statements of a task as (task_id, ordinal, sql)."""
    rows = [(task_id, at, sql) for at, sql in enumerate(statements, start=1)]
    return spark.createDataFrame(rows, "task_id string, ordinal int, sql string")


def next_pending(plan: DataFrame, history: DataFrame) -> DataFrame:
    """The first planned statement that an episode has not yet executed, or a no-op.

    Executed statements become their ordinals in the plan, which are combined per episode into a
    set no longer than the plan. The plan is broadcast when it is measured to be small; the history
    is shuffled once.
    """
    fits = is_small(plan)
    keyed = plan.select("task_id", "ordinal", normalize_sql(F.col("sql")).alias("__sql"))
    keyed = F.broadcast(keyed) if fits else keyed
    done = history.withColumn("__sql", F.when(F.col("result") == "SUCCESS", normalize_sql(F.col("sql")))).join(
        keyed, ["task_id", "__sql"], "left"
    )
    sets = done.groupBy("episode_id", "task_id").agg(F.collect_set("ordinal").alias("__done"))
    whole = plan.groupBy("task_id").agg(
        F.collect_list("ordinal").alias("__all"), F.map_from_entries(F.collect_list(F.struct("ordinal", "sql"))).alias("__map")
    )
    # an episode of a task without a plan has nothing pending
    pending = sets.join(F.broadcast(whole) if fits else whole, "task_id", "left").withColumn(
        "next_ordinal", F.array_min(F.array_except("__all", "__done"))
    )
    return pending.select(
        "episode_id",
        "task_id",
        "next_ordinal",
        F.coalesce(F.try_element_at("__map", F.col("next_ordinal")), F.lit(NO_OP_SQL)).alias("next_sql"),
    )


def next_by_schema(columns: DataFrame, fks: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """The next statement for the column and foreign key tasks, from which features a schema has.

    ``columns`` and ``fks`` carry (snapshot_id, task_id); both are reduced to flags in one shuffle.
    ``snapshots`` lists all schemas, so that those without any column and key have a row as well.
    """

    def flags(df: DataFrame, **found: Column) -> DataFrame:
        names = ("email", "active", "key", "fk", "fk_old", "fk_new")
        return df.select("snapshot_id", "task_id", *[found.get(n, F.lit(False)).alias(n) for n in names])

    name = F.lower("col_name")
    of_columns = flags(
        columns,
        email=name == "email",
        active=name == "is_active",
        key=(name == "user_id") & (F.lower("col_type") == "serial") & F.col("is_primary"),
    )
    to_users = F.lower("ref_table") == "users"
    of_fks = flags(
        fks,
        fk=F.lower("fk_name") == "fk_orders_users",
        fk_old=to_users & (F.lower("ref_column") == "id"),
        fk_new=to_users & (F.lower("ref_column") == "user_id"),
    )
    parts = [of_columns, of_fks] + ([] if snapshots is None else [flags(snapshots)])
    has = reduce(DataFrame.unionByName, parts).groupBy("snapshot_id", "task_id").agg(
        *[F.bool_or(n).alias(n) for n in ("email", "active", "key", "fk", "fk_old", "fk_new")]
    )
    easy = F.when(~F.col("email"), ADD_EMAIL).when(~F.col("active"), ADD_ACTIVE).otherwise(NO_OP_SQL)
    medium = (
        F.when(F.col("fk_new"), NO_OP_SQL)
        .when(F.col("fk") & F.col("fk_old"), DROP_ORDERS_FK)
        .when(~F.col("key"), RENAME_USERS_ID)
        .otherwise(ADD_ORDERS_FK)
    )
    return has.select(
        "snapshot_id",
        "task_id",
        F.when(F.col("task_id") == "easy_add_column", easy)
        .when(F.col("task_id") == "medium_rename_fk", medium)
        .otherwise(NO_OP_SQL)
        .alias("next_sql"),
    )


def leaderboard(scored: DataFrame) -> DataFrame:
    """Runs, mean and best score, and success rate per task and over all; tasks ranked by mean score.

    The rank is taken over one row per task.
    """
    totals = scored.rollup("task_id").agg(
        F.grouping("task_id").alias("__all"),
        F.count(F.lit(1)).alias("runs"),
        F.avg("score").alias("mean_score"),
        F.max("score").alias("best_score"),
        F.avg(F.when(F.col("score") >= PASS_SCORE, 1.0).otherwise(0.0)).alias("success_rate"),
    )
    rounded = totals.withColumn("mean_score", F.round("mean_score", 6))
    place = F.rank().over(Window.partitionBy("__all").orderBy(F.col("mean_score").desc()))
    return rounded.select(
        F.when(F.col("__all") == 1, "*").otherwise(F.col("task_id")).alias("task_id"),
        "runs",
        "mean_score",
        "best_score",
        F.round("success_rate", 6).alias("success_rate"),
        F.when(F.col("__all") == 0, place).alias("place"),
    )
