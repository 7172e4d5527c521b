"""Schemas as they were at each moment of an episode (D8), and statements judged against them.

An episode is folded once, in one shuffle by episode. The fold hands on what is asked for at each step, so
neither the log nor the schemas are joined with themselves. An episode has as many steps as its task
allows, which bounds what one row holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.schema import CHANGE, Schema, apply_change, empty_schema, listed_changes
from tidemark.operators.statements import (
    DUPLICATE_CONSTRAINT,
    MISSING_COLUMN,
    MISSING_CONSTRAINT,
    MISSING_REFERENCE,
)

# Fixed value: why a column may not be renamed.
REFERENCED_COLUMN = "foreign key constraint still references %s(%s); drop referencing constraint(s) first: %s"


def _with(value: Column, body) -> Column:
    """``body`` of ``value``, worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _with_quiet_steps(changes: DataFrame, steps: DataFrame, episode: str) -> DataFrame:
    """Changes, and an entry without a change for each logged step."""
    kinds = dict(changes.dtypes)
    quiet = {"pos": F.lit(-1)} | {c: F.lit(None) for c in CHANGE if c not in ("step", "pos")}
    marks = steps.select(
        episode, "task_id", F.col("step").cast(kinds["step"]).alias("step"), *[v.cast(kinds[c]).alias(c) for c, v in quiet.items()]
    )
    return changes.select(episode, "task_id", *CHANGE).unionByName(marks)


def schema_by_step(changes: DataFrame, steps: DataFrame, tasks: DataFrame, episode: str = "episode_id") -> DataFrame:
    """The schema of each episode after each of its steps: (episode, step, schema).

    ``changes`` comes from ``schema_changes`` for statements that succeeded, with the starting schema as
    step 0; ``steps`` lists (episode, task_id, step) of all steps, so that those which change nothing have
    their row too. Steps beyond the limit of the episode's task are not executed and have none.
    """
    listed = listed_changes(_with_quiet_steps(changes, steps, episode), tasks, episode)
    state = "struct<schema:{0},done:array<struct<step:int,schema:{0}>>>"

    def entry(step: Column, schema: Column) -> Column:
        return F.array(F.struct(step.cast("int").alias("step"), schema.alias("schema")))

    def take(held: Column, change: Column) -> Column:
        before = F.slice(held["done"], 1, F.size(held["done"]) - 1)
        again = (F.size(held["done"]) > 0) & (F.element_at(held["done"], -1)["step"] == change["step"])
        kept = F.when(again, before).otherwise(held["done"])
        # a step that changes nothing hands on what there is
        after = F.when(change["op"].isNull(), held["schema"]).otherwise(apply_change(held["schema"], change))
        return _with(after, lambda s: F.struct(s.alias("schema"), F.concat(kept, entry(change["step"], s)).alias("done")))

    kind = listed.select(F.aggregate("changes", empty_schema(), apply_change).alias("s")).schema["s"].dataType.simpleString()
    start = F.struct(empty_schema().alias("schema"), F.array().alias("done")).cast(state.format(kind))
    folded = F.aggregate("changes", start, take, lambda held: held["done"])
    return listed.select(episode, F.inline(folded))


def features(by_step: DataFrame) -> DataFrame:
    """One row per feature of each schema, spelled out with bars: columns, keys, modes and children."""
    schema = F.col("schema")

    def spelled(kind: str, rows: Column, fields: str) -> Column:
        cell = lambda r, f: F.coalesce(F.array_join(r[f], ",") if f == "names" else r[f].cast("string"), F.lit(""))
        return F.transform(rows, lambda r: F.concat_ws("|", F.lit(kind), *[cell(r, f) for f in fields.split()]))

    modes = F.transform(schema["modes"], lambda m: F.struct(m["table_name"].alias("table_name"), m["mode"].alias("mode"), m["columns"].alias("names")))
    listed = F.concat(
        spelled("column", schema["columns"], "table_name col_name col_type col_default not_null is_primary"),
        spelled("fk", schema["fks"], "table_name fk_name col_name ref_table ref_column"),
        spelled("mode", modes, "table_name mode names"),
        spelled("child", schema["children"], "parent child bounds"),
    )
    return by_step.select(*[c for c in by_step.columns if c != "schema"], F.explode(listed).alias("feature"))


def as_snapshots(by_step: DataFrame, target: Column, episode: str = "episode_id") -> tuple[DataFrame, Schema]:
    """Snapshots (snapshot_id = (episode, step), target_id) and their schemas, to be matched with targets."""
    keyed = by_step.select(F.struct(episode, "step").alias("snapshot_id"), target.alias("target_id"), "schema")
    keys = ["snapshot_id", "target_id"]
    columns = keyed.select(*keys, F.posexplode("schema.columns").alias("at", "c"))
    children = keyed.select(*keys, F.explode("schema.children").alias("c")).select(*keys, "c.*")
    tables = keyed.select(*keys, F.explode(F.array_distinct(F.transform("schema.columns", lambda c: c["table_name"]))).alias("table_name"))
    return keyed.select(*keys), Schema(
        tables.unionByName(children.select(*keys, F.col("child").alias("table_name"))),
        columns.select(*keys, (F.col("at") + 1).alias("ordinal"), "c.*"),
        keyed.select(*keys, F.explode("schema.fks").alias("c")).select(*keys, "c.*"),
        keyed.select(*keys, F.explode("schema.modes").alias("c")).select(*keys, "c.*"),
        children,
    )


def _problem(schema: Column, change: Column) -> Column:
    """Why a change may not be made to this schema, or null."""
    op, table, name = change["op"], change["table_name"], change["a"]
    same = lambda left, right: F.lower(left) == F.lower(right)
    key = F.get(change["fks"], F.lit(0))
    blockers = F.transform(
        F.filter(schema["fks"], lambda f: same(f["ref_table"], table) & same(f["ref_column"], name)),
        lambda f: F.concat_ws(".", f["table_name"], f["fk_name"]),
    )
    has_key = lambda fk: F.exists(schema["fks"], lambda f: same(f["table_name"], table) & same(f["fk_name"], fk))
    has_column = lambda of, column: F.exists(schema["columns"], lambda c: same(c["table_name"], of) & same(c["col_name"], column))
    says = F.format_string
    rename = _with(
        F.array_join(F.array_sort(F.array_distinct(blockers)), ", "), lambda b: F.when(b != "", says(REFERENCED_COLUMN, table, name, b))
    )
    drop = F.when(~change["if_exists"] & ~has_key(name), says(MISSING_CONSTRAINT, name, table))
    add = (
        F.when(has_key(key["fk_name"]), says(DUPLICATE_CONSTRAINT, key["fk_name"], table))
        .when(~has_column(table, key["col_name"]), says(MISSING_COLUMN, table, key["col_name"]))
        .when(~has_column(key["ref_table"], key["ref_column"]), says(MISSING_REFERENCE, key["ref_table"], key["ref_column"]))
    )
    return F.when(op == "rename_column", rename).when(op == "drop_constraint", drop).when((op == "add_constraint") & key.isNotNull(), add)


#: Changes that a preflight looks at.
CHECKED = ["rename_column", "drop_constraint", "add_constraint"]


def preflight(changes: DataFrame, tasks: DataFrame, episode: str = "episode_id") -> DataFrame:
    """Column renames and constraint changes, each judged against the schema at its own moment.

    ``changes`` comes from ``schema_changes`` over all statements, with the starting schema as step 0 and a
    column ``ran`` (whether the statement was executed and succeeded). A change is made if it ran and
    nothing forbids it; the next one meets the schema as it is then. Returned are episode, step, pos, op,
    table_name, name (of the column or constraint), problem (null if there is none) and made.
    """
    listed = listed_changes(changes, tasks, episode, "ran")
    name = lambda c: F.when(c["op"] == "add_constraint", F.get(c["fks"], F.lit(0))["fk_name"]).otherwise(c["a"])
    fields = "step:int,pos:int,op:string,table_name:string,name:string,problem:string,made:boolean"

    def take(held: Column, change: Column) -> Column:
        def judged(problem: Column) -> Column:
            made = F.coalesce(change["ran"], F.lit(False)) & problem.isNull()
            row = F.struct(
                change["step"].cast("int").alias("step"), change["pos"].cast("int").alias("pos"), change["op"].alias("op"),
                change["table_name"].alias("table_name"), name(change).alias("name"), problem.alias("problem"), made.alias("made"),
            )
            looked = reduce(Column.__or__, [change["op"] == op for op in CHECKED])
            return F.struct(
                F.when(made, apply_change(held["schema"], change)).otherwise(held["schema"]).alias("schema"),
                F.when(looked, F.concat(held["done"], F.array(row))).otherwise(held["done"]).alias("done"),
            )

        return _with(_problem(held["schema"], change), judged)

    kind = listed.select(F.aggregate("changes", empty_schema(), apply_change).alias("s")).schema["s"].dataType.simpleString()
    start = F.struct(empty_schema().alias("schema"), F.array().alias("done")).cast(f"struct<schema:{kind},done:array<struct<{fields}>>>")
    return listed.select(episode, F.inline(F.aggregate("changes", start, take, lambda held: held["done"])))
