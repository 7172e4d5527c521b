"""Queries over derived schema snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import child_name
from tidemark.operators import evolution as V
from tidemark.operators import schema as D
from tidemark.operators.episodes import tasks_dim
from tidemark.plans.derived import DDL, SNAPSHOT_COLUMNS, SNAPSHOT_COLUMNS_TWIN, START_OF_TASK, STMTS, cte, derive, targets
from tidemark.plans.registry import query

_K = "k AS (SELECT o_orderkey AS k FROM orders)"


def _ddl(spark: SparkSession, d: str) -> DataFrame:
    return derive(spark, d, DDL, heavy=True)


def _corpus(spark: SparkSession, d: str) -> tuple[DataFrame, D.Schema, D.Schema]:
    """Snapshots, their schemas, and the targets."""
    ddl = _ddl(spark, d)
    return ddl.select("snapshot_id", "target_id"), D.ddl_to_schema(ddl), D.ddl_to_schema(targets(spark))


def _perturbed(spark: SparkSession, d: str) -> tuple[DataFrame, D.Schema, D.Schema]:
    """Snapshots that come as a table of columns, one per order; only their columns are known."""
    columns = derive(spark, d, SNAPSHOT_COLUMNS)
    orders = spark.read.parquet(f"{d.rstrip('/')}/orders.parquet")
    snapshots = orders.select(F.col("o_orderkey").alias("snapshot_id"), F.lit("easy_add_column").alias("target_id"))
    tables = snapshots.withColumn("table_name", F.lit("users"))
    target = D.ddl_to_schema(targets(spark))
    none = "snapshot_id long, target_id string, "
    fks = spark.createDataFrame([], none + "table_name string, fk_name string, col_name string, ref_table string, ref_column string")
    modes = spark.createDataFrame([], none + "table_name string, mode string, columns array<string>")
    children = spark.createDataFrame([], none + "parent string, child string, bounds string")
    return snapshots, D.Schema(tables, columns, fks, modes, children), target


@query(
    "d1_ddl_to_columns",
    f"""WITH {_K}
    SELECT k AS snapshot_id, 'shop' AS target_id, 'users' AS table_name, 1 AS ordinal, 'id' AS col_name, 'serial' AS col_type, '' AS col_default, false AS not_null, true AS is_primary FROM k
    UNION ALL SELECT k, 'shop', 'users', 2, 'username', 'varchar(' || (50 + (k % 3) * 50) || ')', '', true, false FROM k
    UNION ALL SELECT k, 'shop', 'users', 3, 'email', 'varchar(255)', 'null', false, false FROM k WHERE k % 2 = 0
    UNION ALL SELECT k, 'shop', 'users', CASE WHEN k % 2 = 0 THEN 4 ELSE 3 END, 'debug_notes', 'text', '', false, false FROM k WHERE k % 7 = 0
    UNION ALL SELECT k, 'shop', 'orders', 1, 'id', 'serial', '', false, true FROM k
    UNION ALL SELECT k, 'shop', 'orders', 2, 'user_id', 'integer', '', true, false FROM k
    UNION ALL SELECT k, 'shop', 'orders', 3, 'amount', 'decimal(10,2)', '', false, false FROM k""",
)
def d1_ddl_to_columns(spark: SparkSession, d: str) -> DataFrame:
    return D.ddl_to_columns(_ddl(spark, d))


@query(
    "d2_ddl_to_fks",
    f"""WITH {_K} SELECT k AS snapshot_id, 'shop' AS target_id, 'orders' AS table_name, CASE k % 3 WHEN 0 THEN 'fk_orders_users' ELSE 'fk_orders_self' END AS fk_name,
      'user_id' AS col_name, CASE k % 3 WHEN 0 THEN 'users' ELSE 'orders' END AS ref_table, 'id' AS ref_column FROM k WHERE k % 3 < 2""",
)
def d2_ddl_to_fks(spark: SparkSession, d: str) -> DataFrame:
    return D.ddl_to_fks(_ddl(spark, d))


@query(
    "d3_ddl_to_partitions",
    f"""WITH {_K} SELECT k AS snapshot_id, 'orders' AS table_name, 'HASH' AS detail, CASE k % 5 WHEN 0 THEN 'user_id' ELSE 'id' END AS "value" FROM k WHERE k % 5 < 2
    UNION ALL SELECT k, 'orders', 'orders_p0', 'for values with (modulus 2, remainder 0)' FROM k WHERE k % 5 = 0
    UNION ALL SELECT k, 'orders', 'orders_new_p1', 'for values with (modulus 4, remainder 1)' FROM k WHERE k % 5 = 1
    UNION ALL SELECT k, 'orders', 'orders_p9', 'for values with (modulus 10, remainder 9)' FROM k WHERE k % 5 = 1""",
)
def d3_ddl_to_partitions(spark: SparkSession, d: str) -> DataFrame:
    specs, children = D.ddl_to_partitions(_ddl(spark, d))
    listed = specs.select("snapshot_id", "table_name", F.col("mode").alias("detail"), F.concat_ws(",", "columns").alias("value"))
    return listed.unionByName(
        children.select("snapshot_id", F.col("parent").alias("table_name"), F.col("child").alias("detail"), F.col("bounds").alias("value"))
    )


# points of the corpus against the shop target, worked out from the order key alone
_SHOP = f"""{_K}, p AS (SELECT k,
    200 + 100 + (50 + CASE WHEN k % 3 = 1 THEN 20 ELSE 0 END + 30) + CASE WHEN k % 2 = 0 THEN 100 ELSE 0 END + 300
    + CASE WHEN k % 3 = 0 THEN 100 ELSE 0 END
    + CASE k % 5 WHEN 0 THEN 100 WHEN 1 THEN 60 ELSE 0 END
    + CASE k % 5 WHEN 0 THEN 50 WHEN 1 THEN 25 ELSE 0 END AS points,
    CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS c, CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END AS f, CASE WHEN k % 5 = 1 THEN 1 ELSE 0 END AS h, CASE WHEN k % 5 = 1 THEN 1 ELSE 0 END AS m FROM k),
  q AS (SELECT *, least(20, 3 * c + 4 * f + 2 * h + 5 * m) / 100.0::double AS penalty FROM p)"""


@query(
    "d4_schema_match",
    f"""WITH {_SHOP} SELECT k AS snapshot_id, 'shop' AS target_id, round(greatest(0, least(1, least(1, points / 1100.0::double) - penalty)), 6) AS schema_match FROM q""",
)
def d4_schema_match(spark: SparkSession, d: str) -> DataFrame:
    matched = D.schema_match(*_corpus(spark, d))
    return matched.withColumn("schema_match", F.round("schema_match", 6))


_TARGET = """tgt AS (SELECT * FROM (VALUES ('id','serial','',false,true), ('username','varchar(100)','',true,false),
    ('created_at','timestamp','''2024-01-01 00:00:00''',false,false), ('email','varchar(255)','null',false,false), ('is_active','boolean','true',false,false))
    AS t(col_name, t_type, t_default, t_nn, t_pk))"""


@query(
    "d4_schema_match_columns",
    f"""WITH c AS ({SNAPSHOT_COLUMNS_TWIN}), {_TARGET}, j AS (SELECT snapshot_id, t_type IS NULL AS extra,
      CASE WHEN t_type IS NULL THEN 0 ELSE 50 + CASE WHEN col_type = t_type THEN 20 ELSE 0 END + CASE WHEN col_default = t_default THEN 10 ELSE 0 END
        + CASE WHEN not_null = t_nn THEN 10 ELSE 0 END + CASE WHEN is_primary = t_pk THEN 10 ELSE 0 END END AS p FROM c LEFT JOIN tgt USING (col_name))
    SELECT snapshot_id, 'easy_add_column' AS target_id, round(greatest(0, least(1, (100 + sum(p)) / 600.0::double) - least(0.2, 0.03 * count(*) FILTER (extra))), 6)::double AS schema_match FROM j GROUP BY 1""",
)
def d4_schema_match_columns(spark: SparkSession, d: str) -> DataFrame:
    matched = D.schema_match(*_perturbed(spark, d))
    return matched.withColumn("schema_match", F.round("schema_match", 6))


@query(
    "d5_schema_extras",
    f"""WITH {_SHOP} SELECT k AS snapshot_id, 'shop' AS target_id, c::bigint AS extra_columns, f::bigint AS extra_fks, h::bigint AS extra_children, m::bigint AS changed_modes, penalty FROM q""",
)
def d5_schema_extras(spark: SparkSession, d: str) -> DataFrame:
    return D.schema_extras(*_corpus(spark, d))


@query(
    "d6_schema_diff",
    f"""WITH c AS ({SNAPSHOT_COLUMNS_TWIN}), {_TARGET}, e AS (SELECT o_orderkey AS snapshot_id, tgt.* FROM orders, tgt),
    j AS (SELECT coalesce(c.snapshot_id, e.snapshot_id) AS snapshot_id, coalesce(c.col_name, e.col_name) AS col_name, c.col_name IS NULL AS missing, e.col_name IS NULL AS extra,
      concat_ws(',', CASE WHEN col_type <> t_type THEN 'col_type' END, CASE WHEN col_default <> t_default THEN 'col_default' END, CASE WHEN not_null <> t_nn THEN 'not_null' END,
        CASE WHEN is_primary <> t_pk THEN 'is_primary' END) AS a FROM c FULL JOIN e ON c.snapshot_id = e.snapshot_id AND c.col_name = e.col_name)
    SELECT snapshot_id, 'easy_add_column' AS target_id, 'users' AS table_name, col_name, CASE WHEN missing THEN 'missing' WHEN extra THEN 'extra' ELSE 'changed' END AS difference,
      CASE WHEN missing OR extra THEN '' ELSE a END AS attributes FROM j WHERE missing OR extra OR a <> ''""",
)
def d6_schema_diff(spark: SparkSession, d: str) -> DataFrame:
    return D.schema_diff(*_perturbed(spark, d))


@query(
    "d7_child_name",
    f"""WITH {_K} SELECT k AS snapshot_id, CASE k % 5 WHEN 0 THEN 'p' || k WHEN 1 THEN 'orders_p1x' WHEN 2 THEN 'orders' ELSE 'p7' END AS child FROM k""",
)
def d7_child_name(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d.rstrip('/')}/orders.parquet")
    child = F.expr(
        "CASE o_orderkey % 5 WHEN 0 THEN 'Orders_P' || o_orderkey WHEN 1 THEN 'orders_p1x' WHEN 2 THEN 'ORDERS' ELSE 'orders_new_p7' END"
    )
    return orders.select(F.col("o_orderkey").alias("snapshot_id"), child_name(child).alias("child"))


def _change_log(spark: SparkSession, d: str) -> DataFrame:
    """Starting schemas as step 0, and the statements that succeeded."""
    stmts = derive(spark, d, STMTS, heavy=True)
    start = F.lit(None).cast("string")
    for task, ddl in START_OF_TASK.items():
        start = F.when(F.col("task_id") == task, F.lit(ddl)).otherwise(start)
    first = stmts.filter("step = 1").select("episode_id", "task_id", F.lit(0).alias("step"), start.alias("sql"))
    return first.unionByName(stmts.filter("result = 'SUCCESS'").select("episode_id", "task_id", "step", "sql"))


_HAS = "len(list_filter(cols, lambda x: starts_with(x, '{0}.'))) > 0"
_MOVE = "list_transform(cols, lambda x: CASE WHEN starts_with(x, '{0}.') THEN '{1}.' || split_part(x, '.', 2) ELSE x END)"
_GONE = "list_filter(cols, lambda x: NOT starts_with(x, '{0}.'))"
_ADDS = "list_concat({0}, CASE WHEN " + _HAS.format("users") + " AND NOT list_contains(cols, 'users.{1}') THEN ['users.{1}'] ELSE []::varchar[] END)"


@query(
    "d8_replay_schema",
    f"""WITH RECURSIVE s AS ({cte(STMTS)}),
    ops AS (SELECT episode_id, row_number() OVER (PARTITION BY episode_id ORDER BY step) AS n, stmt_id % 16 AS op FROM s
      WHERE result = 'SUCCESS' AND stmt_id % 16 IN (0, 1, 2, 5, 9, 10, 11) AND step <= CASE task_id WHEN 'easy_add_column' THEN 5 WHEN 'medium_rename_fk' THEN 6 ELSE 8 END),
    st AS (SELECT episode_id, 0::bigint AS n, CASE task_id WHEN 'easy_add_column' THEN ['users.id', 'users.username', 'users.created_at']
        WHEN 'medium_rename_fk' THEN ['users.id', 'users.username', 'orders.id', 'orders.user_id', 'orders.amount']
        ELSE ['events.id', 'events.user_id', 'events.event_type', 'events.payload', 'events.created_at'] END AS cols FROM s WHERE step = 1
      UNION ALL SELECT st.episode_id, st.n + 1, CASE op
        WHEN 0 THEN {_ADDS.format('cols', 'email')}
        WHEN 1 THEN {_ADDS.format(_ADDS.format('cols', 'note'), 'is_active')}
        WHEN 2 THEN list_transform(cols, lambda x: CASE WHEN x = 'users.id' THEN 'users.user_id' ELSE x END)
        WHEN 5 THEN CASE WHEN {_HAS.format('events_new')} THEN cols ELSE list_concat(cols, list_transform(list_filter(cols, lambda x: starts_with(x, 'events.')), lambda x: 'events_new.' || split_part(x, '.', 2))) END
        WHEN 9 THEN {_MOVE.format('events', 'events_old')}
        WHEN 10 THEN {_GONE.format('events_old')}
        ELSE {_GONE.format('users')} END
      FROM st JOIN ops ON ops.episode_id = st.episode_id AND ops.n = st.n + 1),
    f AS (SELECT episode_id, arg_max(cols, n) AS cols FROM st GROUP BY 1),
    u AS (SELECT episode_id, unnest(cols) AS c FROM f)
    SELECT episode_id, split_part(c, '.', 1) AS table_name, split_part(c, '.', 2) AS col_name FROM u""",
)
def d8_replay_schema(spark: SparkSession, d: str) -> DataFrame:
    changes = D.schema_changes(_change_log(spark, d))
    schemas = D.replay_schema(changes, tasks_dim(spark))
    return schemas.select("episode_id", F.inline("schema.columns")).select("episode_id", "table_name", "col_name")


def _cells(rows: list[str]) -> str:
    return "[" + ", ".join(f"'{r}'" for r in rows) + "]"


_STARTS = {
    "easy_add_column": ["column|users|id|serial||false|true", "column|users|username|varchar(100)||true|false",
        "column|users|created_at|timestamp|''2024-01-01 00:00:00''|false|false"],
    "medium_rename_fk": ["column|users|id|serial||false|true", "column|users|username|varchar(100)||true|false", "column|orders|id|serial||false|true",
        "column|orders|user_id|integer||true|false", "column|orders|amount|decimal(10,2)||false|false", "fk|orders|fk_orders_users|user_id|users|id"],
    "hard_repartition": ["column|events|id|bigserial||false|false", "column|events|user_id|integer||true|false", "column|events|event_type|varchar(50)||false|false",
        "column|events|payload|jsonb||false|false", "column|events|created_at|timestamp||true|false"],
}
_START_CELLS = "CASE task_id " + " ".join(f"WHEN '{task}' THEN {_cells(rows)}" for task, rows in _STARTS.items()) + " END"


def _starts(text: str) -> str:
    """Whether a schema ``f`` has a feature that begins so."""
    return f"len(list_filter(f, lambda x: starts_with(x, '{text}'))) > 0"


def _add(held: str, name: str, feature: str) -> str:
    return f"list_concat({held}, CASE WHEN {_starts('column|users|')} AND NOT {_starts(f'column|users|{name}|')} THEN ['{feature}'] ELSE []::varchar[] END)"


def _rename(old: str, new: str) -> str:
    """Features with a table's name replaced, also where a key refers to it."""
    own = f"CASE WHEN split_part(x, '|', 2) = '{old}' THEN split_part(x, '|', 1) || '|{new}|' || substr(x, length(split_part(x, '|', 1)) + length('{old}') + 3) ELSE x END"
    return f"list_transform(f, lambda x: {own})"


def _drop(table: str) -> str:
    return f"list_filter(f, lambda x: split_part(x, '|', 2) <> '{table}')"


# what each of the sixteen statements does to the features of a schema
_DOES = f"""CASE op
    WHEN 0 THEN {_add('f', 'email', 'column|users|email|varchar(255)|null|false|false')}
    WHEN 1 THEN {_add(_add('f', 'note', 'column|users|note|text||false|false'), 'is_active', 'column|users|is_active|boolean|true|false|false')}
    WHEN 2 THEN list_transform(f, lambda x: CASE WHEN starts_with(x, 'column|users|id|') THEN replace(x, 'column|users|id|', 'column|users|user_id|') ELSE x END)
    WHEN 3 THEN list_filter(f, lambda x: NOT starts_with(x, 'fk|orders|fk_orders_users|'))
    WHEN 4 THEN CASE WHEN {_starts('column|orders|')} THEN list_concat(f, ['fk|orders|fk_orders_users|user_id|users|user_id']) ELSE f END
    WHEN 5 THEN CASE WHEN {_starts('column|events_new|')} THEN f ELSE list_concat(list_concat(f,
      list_transform(list_filter(f, lambda x: starts_with(x, 'column|events|')), lambda x: replace(x, 'column|events|', 'column|events_new|'))), ['mode|events_new|HASH|user_id']) END
    WHEN 9 THEN {_rename('events', 'events_old')}
    WHEN 10 THEN {_drop('events_old')}
    WHEN 11 THEN {_drop('users')}
    ELSE f END"""
_LIMITED = f"""s AS (SELECT *, stmt_id % 16 AS op FROM ({cte(STMTS)}) WHERE step <= CASE task_id WHEN 'easy_add_column' THEN 5 WHEN 'medium_rename_fk' THEN 6 ELSE 8 END)"""


@query(
    "d8_schema_by_step",
    f"""WITH RECURSIVE {_LIMITED},
    st AS (SELECT episode_id, 0 AS step, {_START_CELLS} AS f FROM s WHERE step = 1
      UNION ALL SELECT st.episode_id, s.step, CASE WHEN result <> 'SUCCESS' THEN f ELSE {_DOES} END
      FROM st JOIN s ON s.episode_id = st.episode_id AND s.step = st.step + 1)
    SELECT episode_id, step, unnest(f) AS feature FROM st""",
)
def d8_schema_by_step(spark: SparkSession, d: str) -> DataFrame:
    """Columns, keys, modes and children after every step."""
    log = _change_log(spark, d)
    steps = derive(spark, d, STMTS).select("episode_id", "task_id", "step")
    by_step = V.schema_by_step(D.schema_changes(log), steps, tasks_dim(spark))
    return V.features(by_step)


_REASON = f"""CASE op
    WHEN 2 THEN CASE WHEN len(list_filter(f, lambda x: starts_with(x, 'fk|') AND ends_with(x, '|users|id'))) > 0
      THEN 'foreign key constraint still references users(id); drop referencing constraint(s) first: orders.fk_orders_users' END
    WHEN 3 THEN CASE WHEN NOT {_starts('fk|orders|fk_orders_users|')} THEN 'constraint fk_orders_users does not exist on orders' END
    WHEN 4 THEN CASE WHEN {_starts('fk|orders|fk_orders_users|')} THEN 'constraint fk_orders_users already exists on orders'
      WHEN NOT {_starts('column|orders|user_id|')} THEN 'column orders.user_id does not exist for foreign key'
      WHEN NOT {_starts('column|users|user_id|')} THEN 'referenced column users.user_id does not exist' END END"""


@query(
    "l9_l10_preflight_by_step",
    f"""WITH RECURSIVE {_LIMITED},
    st AS (SELECT episode_id, 0 AS step, {_START_CELLS} AS f, -1::bigint AS was, NULL::varchar AS problem, false AS made FROM s WHERE step = 1
      UNION ALL SELECT episode_id, step, CASE WHEN ran AND p IS NULL THEN {_DOES} ELSE f END, op, p, ran AND p IS NULL
      FROM (SELECT st.episode_id, s.step, st.f, s.op, {_REASON} AS p, result = 'SUCCESS' AS ran
        FROM st JOIN s ON s.episode_id = st.episode_id AND s.step = st.step + 1))
    SELECT episode_id, step, CASE was WHEN 2 THEN 'rename_column' WHEN 3 THEN 'drop_constraint' ELSE 'add_constraint' END AS op,
      CASE was WHEN 2 THEN 'users' ELSE 'orders' END AS table_name, CASE was WHEN 2 THEN 'id' ELSE 'fk_orders_users' END AS name, problem, made
    FROM st WHERE was IN (2, 3, 4)""",
)
def l9_l10_preflight_by_step(spark: SparkSession, d: str) -> DataFrame:
    """Renames and constraint changes, each against the keys and columns of its own moment."""
    stmts = derive(spark, d, STMTS, heavy=True)
    start = _change_log(spark, d).filter("step = 0").withColumn("ran", F.lit(True))
    log = start.unionByName(stmts.select("episode_id", "task_id", "step", "sql", (F.col("result") == "SUCCESS").alias("ran")))
    return V.preflight(D.schema_changes(log), tasks_dim(spark)).drop("pos")
