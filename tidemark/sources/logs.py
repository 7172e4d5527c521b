"""Typed rows from run logs and from logged JSON payloads.

All decoders are narrow projections over the log, except the last-payload search, which is one
aggregate with map-side combine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scores import bounded
from tidemark.functions.text import cut, strip

# Statements and modes that stand in for missing ones.
NO_OP_SQL = "SELECT 1;"
DEFAULT_MODE = "transaction"
MODES = ("transaction", "autocommit")
TASK_IDS = ("easy_add_column", "medium_rename_fk", "hard_repartition")


# The format of a step line.
_STEP_LINE = r"^\[STEP\] step=(\d+) action=(.*) reward=(\S+) done=(true|false) error=(.*)$"


def _field(line: Column, name: str, value: str = r"\S+") -> Column:
    found = F.regexp_extract(line, rf"(?:^|\s){name}=({value})", 1)
    return F.when(found != "", found)


def parse_run_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """``[START]``, ``[STEP]`` and ``[END]`` lines as typed columns; other lines are dropped.

    The action of a step line is JSON that may hold blanks and ``key=`` texts of its own, and the
    error is free text to the end of the line, so the fields of a step are read from one pattern
    that is anchored at both ends.
    """
    text = strip(F.col(line))
    tagged = lines.withColumn("__text", text).withColumn(
        "kind", F.regexp_extract("__text", r"^\[(START|STEP|END)\]", 1)
    )
    parts = tagged.filter(F.col("kind") != "").withColumn(
        "__step", F.when(F.col("kind") == "STEP", cut(F.col("__text"), _STEP_LINE, 5))
    )

    def of_step(at: int) -> Column:
        return F.get("__step", at)

    def of_other(name: str) -> Column:
        return F.when(F.col("kind") != "STEP", _field(F.col("__text"), name))

    # a step line that does not fit the pattern stays one part
    action, error = of_step(1), of_step(4)
    rewards = F.transform(F.split(of_other("rewards"), ","), lambda part: part.try_cast("double"))
    return parts.select(
        *[c for c in lines.columns if c != line],
        "kind",
        of_other("task").alias("task_id"),
        of_other("model").alias("model"),
        F.when(F.size("__step") == 5, of_step(0)).try_cast("int").alias("step"),
        F.when(action != "", action).alias("action"),
        of_step(2).try_cast("double").alias("reward"),
        of_step(3).try_cast("boolean").alias("done"),
        F.when((error != "") & (error != "null"), error).alias("error"),
        of_other("success").try_cast("boolean").alias("success"),
        of_other("steps").try_cast("int").alias("steps"),
        of_other("score").try_cast("double").alias("score"),
        rewards.alias("rewards"),
    )


def _number_text(value: Column) -> Column:
    """Text of a JSON value; true and false are the numbers 1 and 0, a text that says so is not."""
    truth = F.when(F.schema_of_variant(value) == "BOOLEAN", value.try_cast("boolean").cast("int").cast("string"))
    return F.coalesce(truth, value.try_cast("string"))


def last_score_payload(
    lines: DataFrame, run: str, line_no: str, line: str = "line", keys: Sequence[str] = TASK_IDS
) -> DataFrame:
    """The last well-formed JSON object line of each run, when it is a score payload.

    The last object decides: if it does not have exactly the expected keys, all numeric, the run
    has no scores and ``valid`` is false.
    """
    text = strip(F.col(line))
    fields = F.try_parse_json(text).try_cast("map<string,variant>")
    objects = lines.filter(text.startswith("{") & text.endswith("}")).select(
        F.col(run), F.col(line_no), F.transform_values(fields, lambda _, v: _number_text(v)).alias("fields")
    )
    objects = objects.filter(F.col("fields").isNotNull())
    last = objects.groupBy(run).agg(
        F.max(F.col(line_no)).alias("line_no"),
        F.max_by(F.to_json("fields"), F.col(line_no)).alias("payload"),
    )
    found = F.from_json("payload", "map<string,string>")
    scores = {key: F.try_element_at(found, F.lit(key)).try_cast("double") for key in keys}
    same_keys = F.array_sort(F.map_keys(found)) == F.array(*[F.lit(key) for key in sorted(keys)])
    valid = same_keys
    for score in scores.values():
        valid = valid & score.isNotNull()
    return last.select(
        run,
        "line_no",
        valid.alias("valid"),
        *[F.when(valid, bounded(score)).alias(key) for key, score in scores.items()],
    )


def decode_actions(actions: DataFrame, payload: str = "payload", active_task: str = "active_task_id") -> DataFrame:
    """SQL and mode of each logged action.

    An action is an object with ``sql``, a bare SQL text, or an object with ``commands``, of which
    the first counts. A wait, or a command without a statement, becomes a no-op. The task is always
    that of the active episode. ``valid`` is false where the payload is neither object nor text, has a
    null for its statement, or names an unknown mode.
    """
    raw = F.try_parse_json(F.col(payload))
    outer = F.coalesce(F.try_variant_get(raw, "$.action", "variant"), raw)
    kind = F.schema_of_variant(outer)
    is_text = kind == "STRING"
    is_object = kind.startswith("OBJECT")

    def text(path: str) -> Column:
        return F.try_variant_get(outer, path, "string")

    def given(path: str) -> Column:
        value = text(path)
        return F.when(value != "", value)

    names = F.json_object_keys(F.to_json(F.when(is_object, outer)))
    has_commands = F.coalesce(F.array_contains(names, "commands"), F.lit(False))
    first = "$.commands[0]"
    action_type = F.lower(F.coalesce(text(f"{first}.action_type"), F.lit("wait")))
    command_sql = F.when(action_type == "wait", F.lit(NO_OP_SQL)).otherwise(
        F.coalesce(given(f"{first}.sql"), given(f"{first}.statement"), given(f"{first}.query"), F.lit(NO_OP_SQL))
    )
    sql = (
        F.when(is_text, outer.try_cast("string"))
        .when(has_commands, command_sql)
        .otherwise(F.coalesce(text("$.sql"), F.lit(NO_OP_SQL)))
    )
    mode = (
        F.when(is_text, F.lit(DEFAULT_MODE))
        .when(has_commands, F.coalesce(text(f"{first}.execute_mode"), F.lit(DEFAULT_MODE)))
        .otherwise(
            F.when(text("$.sql").isNull(), F.lit(DEFAULT_MODE)).otherwise(
                F.coalesce(text("$.execute_mode"), F.lit(DEFAULT_MODE))
            )
        )
    )
    null_sql = ~has_commands & F.coalesce(F.array_contains(names, "sql"), F.lit(False)) & text("$.sql").isNull()
    valid = F.coalesce((is_text | (is_object & ~null_sql)) & mode.isin(*MODES), F.lit(False))
    return actions.select(
        *[c for c in actions.columns if c not in (payload, active_task)],
        F.when(valid, sql).alias("sql"),
        F.when(valid, mode).alias("execute_mode"),
        F.col(active_task).alias("task_id"),
        valid.alias("valid"),
    )


_OBSERVATION = (
    "current_schema_ddl string, target_schema_ddl string, last_sql_result string, downtime_pct double, "
    "step_count int, cumulative_downtime_pct double, task_id string, schema_match_pct double, episode_id string"
)


def decode_steps(steps: DataFrame, payload: str = "payload") -> DataFrame:
    """Observation fields, reward, done flag and metadata of each logged step result.

    The observation may be nested or flat; done defaults to false and metadata to ``{}``.
    """
    text = F.col(payload)
    nested = F.get_json_object(text, "$.observation")
    observation = F.from_json(F.coalesce(nested, text), _OBSERVATION)
    outer = F.from_json(text, "reward double, done boolean")
    return steps.select(
        *[c for c in steps.columns if c != payload],
        observation.alias("__o"),
        outer["reward"].alias("reward"),
        F.coalesce(outer["done"], F.lit(False)).alias("done"),
        F.coalesce(F.get_json_object(text, "$.metadata"), F.lit("{}")).alias("metadata"),
    ).select(*[c for c in steps.columns if c != payload], "__o.*", "reward", "done", "metadata")
