"""Queries over derived logs: ingestion, statements, availability, episodes and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scores
from tidemark.operators import availability as A
from tidemark.operators import episodes as E
from tidemark.operators import statements as L
from tidemark.operators.schema import schema_progress
from tidemark.plans.derived import LOCKS, STEPS, STMTS, TASK_OF_EPISODE, WORKLOAD, cte, derive
from tidemark.plans.registry import query
from tidemark.plans.table_queries import _bucket
from tidemark.sources import logs
from tidemark.sources.tables import load_table
from tidemark.sources.workspace import fresh_path
from tidemark.streaming import live

_S = f"s AS ({cte(STMTS)})"
_T = f"t AS ({cte(STEPS)})"
_MAX = "CASE task_id WHEN 'easy_add_column' THEN 5 WHEN 'medium_rename_fk' THEN 6 ELSE 8 END"
_LOAD = "CASE task_id WHEN 'medium_rename_fk' THEN 20 ELSE 30 END"


def _bounded(text: str) -> str:
    return f"round(least(greatest({text}, 0.001::double), 0.998::double), 3)"


def _stmts(spark: SparkSession, d: str) -> DataFrame:
    return derive(spark, d, STMTS, heavy=True)


def _steps(spark: SparkSession, d: str) -> DataFrame:
    return derive(spark, d, STEPS)


# ---------------------------------------------------------------- ingestion

# one step line per event, a start line with every first and an end line with every last step of a run;
# all lines of an event come out of its own row
_RUN_LINES = f"""
SELECT event_id * 10 + k AS line_no, run_id, line
FROM (SELECT event_id, run_id, posexplode(array(
    CASE WHEN event_id % 9 = 0 THEN '[START] task=' || task_id || ' env=warehouse model=planner-1' END,
    '[STEP] step=' || cast(event_id % 9 + 1 AS string) || ' action={{{{"commands":[{{{{"action_type":"execute_sql","sql":"SELECT done=true FROM t' || cast(event_id AS string) || ';"}}}}]}}}} reward=0.' ||
      lpad(cast(event_id % 998 + 1 AS string), 3, '0') || ' done=' || CASE WHEN event_id % 9 = 8 THEN 'true' ELSE 'false' END ||
      ' error=' || CASE WHEN event_type = 'error' THEN 'relation t' || cast(event_id AS string) || ' does not exist reward=9' ELSE 'null' END,
    CASE WHEN event_id % 9 = 8 THEN '[END] task=' || task_id || ' success=' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || ' steps=9 score=0.' ||
      lpad(cast(event_id % 998 + 1 AS string), 3, '0') || ' rewards=0.001,0.25,0.' || lpad(cast(event_id % 998 + 1 AS string), 3, '0') END
  )) AS (k, line)
  FROM (SELECT *, {TASK_OF_EPISODE} AS task_id, cast(floor(event_id / 9) AS bigint) AS run_id FROM {{events}}) e) x
WHERE line IS NOT NULL
"""


@query(
    "s6_parse_run_log",
    f"""WITH e AS (SELECT *, {TASK_OF_EPISODE} AS task_id, cast(floor(event_id / 9) AS bigint) AS run_id,
      lpad(cast(event_id % 998 + 1 AS varchar), 3, '0') AS r FROM events)
    SELECT event_id * 10 AS line_no, run_id, 'START' AS kind, task_id, 'planner-1' AS model, NULL::int AS step, NULL AS action, NULL::double AS reward,
      NULL::boolean AS done, NULL AS error, NULL::boolean AS success, NULL::int AS steps, NULL::double AS score, '' AS rewards FROM e WHERE event_id % 9 = 0
    UNION ALL SELECT event_id * 10 + 1, run_id, 'STEP', NULL, NULL, cast(event_id % 9 + 1 AS int),
      '{{"commands":[{{"action_type":"execute_sql","sql":"SELECT done=true FROM t' || event_id || ';"}}]}}', cast('0.' || r AS double), event_id % 9 = 8,
      CASE WHEN event_type = 'error' THEN 'relation t' || event_id || ' does not exist reward=9' END, NULL, NULL, NULL, '' FROM e
    UNION ALL SELECT event_id * 10 + 2, run_id, 'END', task_id, NULL, NULL, NULL, NULL, NULL, NULL, event_id % 2 = 0, 9, cast('0.' || r AS double),
      '0.001,0.25,' || cast(cast('0.' || r AS double) AS varchar) FROM e WHERE event_id % 9 = 8""",
)
def s6_parse_run_log(spark: SparkSession, d: str) -> DataFrame:
    parsed = logs.parse_run_log(derive(spark, d, _RUN_LINES, heavy=True))
    return parsed.withColumn("rewards", F.concat_ws(",", F.col("rewards").cast("array<string>")))


_SCORE_LINES = """
SELECT event_id AS line_no, cast(floor(event_id / 9) AS bigint) AS run_id,
  CASE event_id % 5
    WHEN 0 THEN '{{"easy_add_column": 0.' || cast(event_id % 7 + 1 AS string) || ', "medium_rename_fk": "0.5", "hard_repartition": 1.5}}'
    WHEN 1 THEN CASE WHEN event_id % 3 = 0 THEN '{{"easy_add_column": 0.4}}' ELSE '{{"easy_add_column": 0.4' END
    WHEN 2 THEN '  [STEP] step=1 {{}}'
    WHEN 3 THEN CASE WHEN event_id % 2 = 0 THEN '{{"easy_add_column": "x", "medium_rename_fk": 1, "hard_repartition": 1}}' ELSE '{{broken}}' END
    ELSE 'done' END AS line
FROM {events}
"""


@query(
    "s7_last_score_payload",
    """WITH e AS (SELECT *, cast(floor(event_id / 9) AS bigint) AS run_id FROM events),
    o AS (SELECT run_id, event_id, event_id % 5 = 0 AS good FROM e
          WHERE event_id % 5 = 0 OR (event_id % 5 = 1 AND event_id % 3 = 0) OR (event_id % 5 = 3 AND event_id % 2 = 0)),
    l AS (SELECT run_id, max(event_id) AS line_no, arg_max(good, event_id) AS valid FROM o GROUP BY 1)
    SELECT run_id, line_no, valid, CASE WHEN valid THEN round((line_no % 7 + 1) / 10.0, 3)::double END AS easy_add_column,
      CASE WHEN valid THEN 0.5::double END AS medium_rename_fk, CASE WHEN valid THEN 0.998::double END AS hard_repartition FROM l""",
)
def s7_last_score_payload(spark: SparkSession, d: str) -> DataFrame:
    return logs.last_score_payload(derive(spark, d, _SCORE_LINES, heavy=True), "run_id", "line_no")


_ACTIONS = f"""
SELECT event_id, CASE event_id % 10
    WHEN 0 THEN '{{{{"sql": "SELECT ' || cast(event_id AS string) || ';", "execute_mode": "autocommit"}}}}'
    WHEN 1 THEN '"SELECT ' || cast(event_id AS string) || ';"'
    WHEN 2 THEN '{{{{"action": {{{{"sql": "SELECT 2;"}}}}}}}}'
    WHEN 3 THEN '{{{{"commands": [{{{{"action_type": "execute_sql", "statement": "DROP TABLE t' || cast(event_id AS string) || ';"}}}}, {{{{"sql": "x"}}}}]}}}}'
    WHEN 4 THEN '{{{{"commands": [{{{{"action_type": "wait", "sql": "SELECT 9;"}}}}]}}}}'
    WHEN 5 THEN '{{{{"commands": []}}}}'
    WHEN 6 THEN '{{{{"commands": [{{{{"action_type": "run", "sql": "", "query": "SELECT q;", "execute_mode": "autocommit"}}}}]}}}}'
    WHEN 7 THEN '{{{{"note": "nothing"}}}}'
    WHEN 8 THEN '{{{{"sql": "SELECT 8;", "execute_mode": "never"}}}}'
    ELSE '[1, 2]' END AS payload, {TASK_OF_EPISODE} AS active_task_id
FROM {{events}}
"""


@query(
    "s8_decode_actions",
    f"""SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'SELECT ' || event_id || ';' WHEN 1 THEN 'SELECT ' || event_id || ';' WHEN 2 THEN 'SELECT 2;'
      WHEN 3 THEN 'DROP TABLE t' || event_id || ';' WHEN 4 THEN 'SELECT 1;' WHEN 5 THEN 'SELECT 1;' WHEN 6 THEN 'SELECT q;' WHEN 7 THEN 'SELECT 1;' END AS sql,
    CASE WHEN event_id % 10 IN (0, 6) THEN 'autocommit' WHEN event_id % 10 < 8 THEN 'transaction' END AS execute_mode,
    {TASK_OF_EPISODE} AS task_id, event_id % 10 < 8 AS valid FROM events""",
)
def s8_decode_actions(spark: SparkSession, d: str) -> DataFrame:
    return logs.decode_actions(derive(spark, d, _ACTIONS, heavy=True))


_OBSERVED = """
SELECT event_id, CASE event_id % 3
    WHEN 0 THEN '{{"observation": {{"last_sql_result": "SUCCESS", "step_count": ' || cast(event_id % 9 AS string) || ', "schema_match_pct": 0.5, "episode_id": "e' ||
      cast(event_id AS string) || '"}}, "reward": 0.25, "done": true, "metadata": {{"score":0.5}}}}'
    WHEN 1 THEN '{{"last_sql_result": "RESET", "step_count": 0, "downtime_pct": 0.001, "episode_id": "e' || cast(event_id AS string) || '"}}'
    ELSE '{{"observation": {{"step_count": 2, "task_id": "easy_add_column"}}, "reward": null}}' END AS payload
FROM {events}
"""


@query(
    "s9_decode_steps",
    """SELECT event_id, cast(NULL AS varchar) AS current_schema_ddl, cast(NULL AS varchar) AS target_schema_ddl,
      CASE event_id % 3 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'RESET' END AS last_sql_result, CASE WHEN event_id % 3 = 1 THEN 0.001::double END AS downtime_pct,
      cast(CASE event_id % 3 WHEN 0 THEN event_id % 9 WHEN 1 THEN 0 ELSE 2 END AS int) AS step_count, NULL::double AS cumulative_downtime_pct,
      CASE WHEN event_id % 3 = 2 THEN 'easy_add_column' END AS task_id, CASE WHEN event_id % 3 = 0 THEN 0.5::double END AS schema_match_pct,
      CASE WHEN event_id % 3 < 2 THEN 'e' || event_id END AS episode_id, CASE WHEN event_id % 3 = 0 THEN 0.25::double END AS reward,
      event_id % 3 = 0 AS done, CASE WHEN event_id % 3 = 0 THEN '{"score":0.5}' ELSE '{}' END AS metadata FROM events""",
)
def s9_decode_steps(spark: SparkSession, d: str) -> DataFrame:
    return logs.decode_steps(derive(spark, d, _OBSERVED, heavy=True))


# ---------------------------------------------------------------- statements

_SCRIPTS = f"""
SELECT stmt_id, sql || ' ; ' || CASE stmt_id % 4 WHEN 0 THEN 'DROP TABLE events_old;' WHEN 1 THEN 'SELECT 2; ;' WHEN 2 THEN 'DELETE FROM users;'
  ELSE 'INSERT INTO users VALUES (1);' END AS sql FROM ({STMTS}) s
"""


@query(
    "l1_split_statements",
    f"""WITH p AS (SELECT stmt_id, string_split(sql, ';') AS parts, sql FROM ({cte(_SCRIPTS)}) x),
    f AS (SELECT stmt_id, sql, list_filter(list_transform(parts, lambda q: trim(q)), lambda q: q <> '') AS kept FROM p)
    SELECT stmt_id, sql, unnest(kept) AS statement, cast(unnest(range(1, len(kept) + 1)) AS int) AS pos FROM f""",
)
def l1_split_statements(spark: SparkSession, d: str) -> DataFrame:
    return L.split_statements(derive(spark, d, _SCRIPTS, heavy=True))


@query(
    "l2_expand_add_columns",
    f"""WITH {_S}, b AS (SELECT stmt_id, rtrim(sql, ';') AS statement, stmt_id % 16 = 1 AS two FROM s WHERE stmt_id % 16 <> 13)
    SELECT stmt_id, statement, 0 AS part, CASE WHEN two THEN 'ALTER TABLE users ADD COLUMN note TEXT' ELSE statement END AS expanded FROM b
    UNION ALL SELECT stmt_id, statement, 1, 'ALTER TABLE users ADD COLUMN is_active BOOLEAN DEFAULT TRUE' FROM b WHERE two
    UNION ALL SELECT stmt_id, 'ALTER TABLE orders ALTER COLUMN amount TYPE TEXT', 0, 'ALTER TABLE orders ALTER COLUMN amount TYPE TEXT' FROM s WHERE stmt_id % 16 = 13
    UNION ALL SELECT stmt_id, 'SELECT 1', 0, 'SELECT 1' FROM s WHERE stmt_id % 16 = 13""",
)
def l2_expand_add_columns(spark: SparkSession, d: str) -> DataFrame:
    each = L.split_statements(_stmts(spark, d).select("stmt_id", "sql"))
    return L.expand_add_columns(each.select("stmt_id", "statement"))


_FENCE = "chr(96) || chr(96) || chr(96)"
_FENCED = f"""
SELECT stmt_id, CASE stmt_id % 4
    WHEN 0 THEN {_FENCE} || 'sql' || chr(10) || sql || chr(10) || {_FENCE}
    WHEN 1 THEN '  ' || rtrim(sql, ';') || '   ' || chr(10) || chr(10) || '  '
    WHEN 2 THEN replace(sql, ' ', '  ' || chr(10))
    ELSE CASE WHEN stmt_id % 8 = 3 THEN '  ' ELSE sql END END AS raw, sql
FROM ({STMTS}) s
"""


@query(
    "l3_normalize_sql",
    f"""WITH {_S} SELECT stmt_id, CASE stmt_id % 4 WHEN 0 THEN sql WHEN 1 THEN sql WHEN 2 THEN replace(sql, ' ', chr(10))
      ELSE CASE WHEN stmt_id % 8 = 3 THEN '' ELSE sql END END AS normalized FROM s""",
)
def l3_normalize_sql(spark: SparkSession, d: str) -> DataFrame:
    fenced = derive(spark, d, _FENCED.replace("rtrim(sql, ';')", "rtrim(';', sql)"), heavy=True)
    return fenced.select("stmt_id", L.normalize_sql(F.col("raw")).alias("normalized"))


def _insert_ticks(rows: str) -> str:
    return f"cast(greatest(1, ceil({rows} / 1000.0) * 15) AS bigint)"


# expected profile by kind of statement: (type, ticks, rate, destroys)
_PROFILES = f"""(SELECT *, stmt_id % 16 AS k,
  CASE WHEN stmt_id % 16 IN (0, 12) THEN 'SHARE_UPDATE_EXCLUSIVE' WHEN stmt_id % 16 = 4 THEN 'SHARE_ROW_EXCLUSIVE'
    WHEN stmt_id % 16 IN (6, 7, 8) THEN 'ROW_EXCLUSIVE' WHEN stmt_id % 16 = 14 THEN 'UNKNOWN' WHEN stmt_id % 16 = 15 THEN 'NONE'
    WHEN stmt_id % 16 = 1 THEN 'SHARE_UPDATE_EXCLUSIVE' ELSE 'ACCESS_EXCLUSIVE' END AS lock_type,
  cast(CASE stmt_id % 16 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 4 WHEN 5 THEN 0
    WHEN 6 THEN {_insert_ticks('(stmt_id % 4000 + 1)')} WHEN 7 THEN {_insert_ticks('(stmt_id % 5000 + 1)')} WHEN 8 THEN 15
    WHEN 9 THEN 1 WHEN 10 THEN 5 WHEN 11 THEN 20 WHEN 12 THEN 0 WHEN 13 THEN 12 WHEN 14 THEN 1 ELSE 0 END AS bigint) AS lock_ticks,
  cast(CASE stmt_id % 16 WHEN 2 THEN 0.25 WHEN 3 THEN 0.2 WHEN 4 THEN 0.3 WHEN 6 THEN 0.15 WHEN 7 THEN 0.15 WHEN 8 THEN 0.6
    WHEN 9 THEN 0.05 WHEN 10 THEN 0.25 WHEN 11 THEN 1.0 WHEN 13 THEN 0.9 WHEN 14 THEN 0.5 ELSE 0 END AS double) AS failure_rate,
  stmt_id % 16 = 11 AS destroys_data FROM s)"""


# every statement of each text: those of the one shape with two of them have a second, free of locks
_EACH = f"""(SELECT stmt_id, task_id, 1 AS pos, split_part(sql, ';', 1) AS statement, lock_type, lock_ticks, failure_rate, destroys_data FROM {_PROFILES} p
  UNION ALL SELECT stmt_id, task_id, 2, 'SELECT 1', 'NONE', 0, 0.0::double, false FROM s WHERE stmt_id % 16 = 13)"""


def _each(spark: SparkSession, d: str, *keys: str) -> DataFrame:
    return L.split_statements(_stmts(spark, d).select("stmt_id", *keys, "sql")).drop("sql")


@query(
    "l4_classify_locks",
    f"WITH {_S}, p AS {_EACH} SELECT stmt_id, pos, statement, lock_type, lock_ticks, failure_rate, destroys_data FROM p",
)
def l4_classify_locks(spark: SparkSession, d: str) -> DataFrame:
    return L.classify_locks(_each(spark, d))


@query(
    "l5_script_profile",
    f"""WITH {_S}, p AS {_PROFILES},
    x AS (SELECT stmt_id, 0 AS pos, lock_type, lock_ticks, failure_rate, destroys_data FROM p
      UNION ALL SELECT stmt_id, 1, 'NONE', 0, 0.0::double, false FROM p WHERE stmt_id % 4 = 1
      UNION ALL SELECT stmt_id, 1, 'ACCESS_EXCLUSIVE', 5, 0.25::double, false FROM p WHERE stmt_id % 4 = 0
      UNION ALL SELECT stmt_id, 1, 'ACCESS_EXCLUSIVE', 20, 1.0::double, true FROM p WHERE stmt_id % 4 = 2
      UNION ALL SELECT stmt_id, 1, 'ROW_EXCLUSIVE', 1, 0.02::double, false FROM p WHERE stmt_id % 4 = 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY stmt_id ORDER BY destroys_data DESC, lock_ticks DESC, failure_rate DESC, pos) AS rn,
      bool_or(lock_type = 'UNKNOWN') OVER (PARTITION BY stmt_id) AS unknown FROM x)
    SELECT stmt_id, CASE WHEN unknown THEN 'UNKNOWN' WHEN lock_ticks = 0 AND failure_rate = 0 AND NOT destroys_data THEN 'NONE' ELSE lock_type END AS lock_type,
      CASE WHEN unknown THEN 1 ELSE lock_ticks END AS lock_ticks, CASE WHEN unknown THEN 0.5::double ELSE failure_rate END AS failure_rate,
      NOT unknown AND destroys_data AS destroys_data FROM r WHERE rn = 1""",
)
def l5_script_profile(spark: SparkSession, d: str) -> DataFrame:
    return L.script_profile(derive(spark, d, _SCRIPTS, heavy=True)).drop("sql")


_COPIES = f"""
SELECT stmt_id, 'INSERT INTO events_new SELECT * FROM events' || CASE stmt_id % 4
    WHEN 0 THEN ' WHERE id BETWEEN ' || cast(stmt_id AS string) || ' AND ' || cast(stmt_id * 2 AS string)
    WHEN 1 THEN ' LIMIT ' || cast(stmt_id AS string)
    WHEN 2 THEN ' WHERE user_id = ' || cast(stmt_id AS string) ELSE '' END AS sql FROM ({STMTS}) s
"""


@query(
    "l6_copy_cost",
    f"""WITH {_S} SELECT stmt_id, 'ROW_EXCLUSIVE' AS lock_type, CASE stmt_id % 4 WHEN 0 THEN {_insert_ticks('greatest(1, stmt_id + 1)')}
      WHEN 1 THEN {_insert_ticks('greatest(1, stmt_id)')} ELSE 15 END AS lock_ticks,
      CASE WHEN stmt_id % 4 = 3 THEN 0.6::double ELSE 0.15::double END AS failure_rate, false AS destroys_data FROM s""",
)
def l6_copy_cost(spark: SparkSession, d: str) -> DataFrame:
    return derive(spark, d, _COPIES, heavy=True).select("stmt_id", L.copy_cost(F.col("sql")).alias("p")).select("stmt_id", "p.*")


_RISKY = f"""
SELECT stmt_id, CASE stmt_id % 5 WHEN 0 THEN sql WHEN 1 THEN 'drop table if  exists events_old cascade' WHEN 2 THEN 'truncate users'
  WHEN 3 THEN '' ELSE 'drop schema public cascade; ' || sql END AS sql FROM ({STMTS}) s
"""


@query(
    "l7_flag_unsafe",
    f"WITH {_S} SELECT stmt_id, CASE stmt_id % 5 WHEN 0 THEN stmt_id % 16 = 11 WHEN 1 THEN false ELSE true END AS unsafe FROM s",
)
def l7_flag_unsafe(spark: SparkSession, d: str) -> DataFrame:
    return derive(spark, d, _RISKY, heavy=True).select("stmt_id", L.flag_unsafe(F.col("sql"), ["events_old"]).alias("unsafe"))


_RETRIES = f"""
SELECT stmt_id, episode_id, step, CASE WHEN stmt_id % 3 = 0 THEN sql ELSE 'SELECT 1;' END AS sql, result FROM ({STMTS}) s
"""


@query(
    "l8_flag_repeats",
    f"""WITH r AS ({cte(_RETRIES)}) SELECT stmt_id, episode_id, step, sql, result,
      coalesce(lag(result) OVER w <> 'SUCCESS' AND lag(sql) OVER w = sql, false) AS repeats_failed FROM r WINDOW w AS (PARTITION BY episode_id ORDER BY step)""",
)
def l8_flag_repeats(spark: SparkSession, d: str) -> DataFrame:
    return L.flag_repeats(derive(spark, d, _RETRIES))


# references known to each episode: some episodes have two, some one, some none
_FKS = f"""
SELECT episode_id, 'orders' AS table_name, 'fk_orders_users' AS fk_name, 'users' AS ref_table, 'id' AS ref_column FROM ({STMTS}) s WHERE step = 1 AND episode_id % 2 = 0
UNION ALL
SELECT episode_id, 'audits', 'fk_audits_users', 'USERS', 'ID' FROM ({STMTS}) s WHERE step = 2 AND episode_id % 4 = 0
"""
_LOCAL_COLUMNS = f"""
SELECT episode_id, 'orders' AS table_name, 'user_id' AS col_name FROM ({STMTS}) s WHERE step = 1 AND episode_id % 3 <> 0
UNION ALL
SELECT episode_id, 'users', 'user_id' FROM ({STMTS}) s WHERE step = 1 AND episode_id % 5 <> 0
"""


@query(
    "l9_preflight_rename",
    f"""WITH {_S} SELECT stmt_id, episode_id, 1 AS pos, split_part(sql, ';', 1) AS statement, 'users' AS table_name, 'id' AS old_name, 'user_id' AS new_name,
      CASE WHEN episode_id % 4 = 0 THEN 'audits.fk_audits_users, orders.fk_orders_users' WHEN episode_id % 2 = 0 THEN 'orders.fk_orders_users' ELSE '' END AS blockers,
      episode_id % 2 = 0 AS blocked FROM s
      WHERE stmt_id % 16 = 2""",
)
def l9_preflight_rename(spark: SparkSession, d: str) -> DataFrame:
    return L.preflight_rename(_each(spark, d, "episode_id"), derive(spark, d, _FKS), ["episode_id"])


@query(
    "l10_preflight_constraints",
    f"""WITH {_S}, c AS (SELECT stmt_id, episode_id, split_part(sql, ';', 1) AS statement, stmt_id % 16 = 4 AS adds,
        episode_id IN (SELECT episode_id FROM s WHERE step = 1 AND episode_id % 2 = 0) AS has,
        episode_id IN (SELECT episode_id FROM s WHERE step = 1 AND episode_id % 3 <> 0) AS loc,
        episode_id IN (SELECT episode_id FROM s WHERE step = 1 AND episode_id % 5 <> 0) AS ref FROM s WHERE stmt_id % 16 IN (3, 4))
    SELECT stmt_id, episode_id, 1 AS pos, statement, CASE WHEN adds THEN 'ADD' ELSE 'DROP' END AS action, 'orders' AS table_name, 'fk_orders_users' AS constraint_name,
      CASE WHEN NOT adds AND NOT has THEN 'constraint fk_orders_users does not exist on orders' WHEN adds AND has THEN 'constraint fk_orders_users already exists on orders'
        WHEN adds AND NOT loc THEN 'column orders.user_id does not exist for foreign key' WHEN adds AND NOT ref THEN 'referenced column users.user_id does not exist' END AS problem FROM c""",
)
def l10_preflight_constraints(spark: SparkSession, d: str) -> DataFrame:
    return L.preflight_constraints(_each(spark, d, "episode_id"), derive(spark, d, _LOCAL_COLUMNS), derive(spark, d, _FKS), ["episode_id"])


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return L.classify_locks(_each(spark, d, "task_id"))


@query(
    "l11_lock_summary",
    f"""WITH {_S}, p AS {_EACH} SELECT coalesce(task_id, '*') AS task_id, coalesce(lock_type, '*') AS lock_type, count(*) AS statements,
      cast(sum(lock_ticks) AS bigint) AS ticks, max(failure_rate) AS worst_rate, count(*) FILTER (destroys_data) AS destructive
      FROM p GROUP BY ROLLUP (task_id, lock_type)""",
)
def l11_lock_summary(spark: SparkSession, d: str) -> DataFrame:
    return L.lock_summary(_classified(spark, d), ["task_id", "lock_type"], rollup=True).na.fill("*", ["task_id", "lock_type"])


# ---------------------------------------------------------------- availability


@query(
    "a1_downtime_by_step",
    f"""SELECT episode_id, step, count(*) AS queries_total, count(*) FILTER (failed) AS queries_failed,
      count(*) FILTER (failed) / count(*)::double AS downtime_pct FROM ({cte(WORKLOAD)}) w GROUP BY 1, 2""",
)
def a1_downtime_by_step(spark: SparkSession, d: str) -> DataFrame:
    return A.downtime_by_step(derive(spark, d, WORKLOAD))


@query(
    "a2_cumulative_downtime",
    f"""WITH {_T} SELECT episode_id, step, cast(sum(queries_total) OVER w AS bigint) AS total_to_date, cast(sum(queries_failed) OVER w AS bigint) AS failed_to_date,
      sum(queries_failed) OVER w / (sum(queries_total) OVER w)::double AS cumulative_downtime_pct FROM t WINDOW w AS (PARTITION BY episode_id ORDER BY step)""",
)
def a2_cumulative_downtime(spark: SparkSession, d: str) -> DataFrame:
    return A.cumulative_downtime(_steps(spark, d).select("episode_id", "step", "queries_total", "queries_failed")).drop(
        "queries_total", "queries_failed"
    )


@query(
    "a3_availability",
    f"""WITH {_T} SELECT episode_id, cast(sum(queries_total) AS bigint) AS queries_total, cast(sum(queries_failed) AS bigint) AS queries_failed,
      1 - sum(queries_failed) / sum(queries_total)::double AS availability FROM t GROUP BY 1""",
)
def a3_availability(spark: SparkSession, d: str) -> DataFrame:
    return A.availability(_steps(spark, d))


@query(
    "a4_lock_impact",
    f"""WITH w AS ({cte(WORKLOAD)}), l AS ({cte(LOCKS)}), sh AS (SELECT shard, count(*) AS n, count(*) FILTER (failed) AS f FROM w GROUP BY 1),
    i AS (SELECT l.shard, l.lock_id, count(w.query_id) AS n, count(w.query_id) FILTER (w.failed) AS f
          FROM l LEFT JOIN w ON w.shard = l.shard AND w.ts >= l.start_ts AND w.ts < l.end_ts GROUP BY 1, 2)
    SELECT i.shard, lock_id, i.n AS in_total, i.f AS in_failed, sh.n - i.n AS out_total, sh.f - i.f AS out_failed,
      CASE WHEN i.n > 0 THEN i.f / i.n::double ELSE 0 END AS in_share, CASE WHEN sh.n > i.n THEN (sh.f - i.f) / (sh.n - i.n)::double ELSE 0 END AS out_share
    FROM i JOIN sh USING (shard)""",
)
def a4_lock_impact(spark: SparkSession, d: str) -> DataFrame:
    return A.lock_impact(derive(spark, d, WORKLOAD), derive(spark, d, LOCKS), span_micros=24 * 3600 * 1_000_000)


@query(
    "a5_expected_impact",
    f"""WITH {_S}, p AS {_EACH} SELECT stmt_id, pos, task_id, lock_type, cast({_LOAD} * greatest(1, lock_ticks) AS bigint) AS expected_queries,
      round({_LOAD} * greatest(1, lock_ticks) * failure_rate, 6) AS expected_failed FROM p""",
)
def a5_expected_impact(spark: SparkSession, d: str) -> DataFrame:
    impact = A.expected_impact(_classified(spark, d), E.tasks_dim(spark))
    return impact.select(
        "stmt_id", "pos", "task_id", "lock_type", "expected_queries", F.round("expected_failed", 6).alias("expected_failed")
    )


# ---------------------------------------------------------------- episodes

# the same rules as windows over whole episodes
_RUNS = f"""{_T}, a AS (SELECT *, {_MAX} AS max_steps, CASE WHEN valid THEN schema_match END AS m FROM t),
 b AS (SELECT *, step >= max_steps OR (valid AND schema_match >= 1 - 1e-9) AS ends,
   coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM a),
 c AS (SELECT *, coalesce(bool_or(ends) OVER (PARTITION BY episode_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS masked FROM b),
 r AS (SELECT *, masked OR ends AS done, valid AND NOT masked AS counted,
   CASE WHEN masked THEN 0 WHEN NOT valid THEN -0.05::double
     ELSE greatest(0, schema_match - prev) * (1 - queries_failed / queries_total::double) * data_integrity - CASE WHEN result = 'SUCCESS' THEN 0 ELSE 0.05::double END END AS reward FROM c),
 z AS (SELECT *, sum(reward) OVER w AS cum, sum(CASE WHEN counted THEN queries_total ELSE 0 END) OVER w AS tot, sum(CASE WHEN counted THEN queries_failed ELSE 0 END) OVER w AS bad,
   coalesce(last_value(CASE WHEN counted THEN schema_match END IGNORE NULLS) OVER w, 0) AS now,
   coalesce(last_value(CASE WHEN counted THEN data_integrity END IGNORE NULLS) OVER w, 1) AS kept
   FROM r WINDOW w AS (PARTITION BY episode_id ORDER BY step)),
 y AS (SELECT *, CASE WHEN tot > 0 THEN 1 - bad / tot::double ELSE 1 END AS avail, CASE WHEN masked THEN 'EPISODE_DONE' ELSE result END AS shown FROM z)"""
_FINAL = f"""{_RUNS}, f AS (SELECT * FROM y WHERE NOT masked QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY step DESC) = 1),
 g AS (SELECT *, {_bounded('now * kept * avail')} AS score,
   CASE WHEN kept = 0 THEN '{scores.FAIL_INTEGRITY}' WHEN now >= 0.999 AND {_bounded('avail')} >= 0.9 THEN '{scores.PASS_PERFECT}'
     WHEN now >= 0.999 THEN '{scores.PARTIAL_AVAILABILITY}' ELSE '{scores.PARTIAL_SCHEMA}' END AS label FROM f)"""


def _rewards(spark: SparkSession, d: str) -> DataFrame:
    return E.step_rewards(_steps(spark, d), E.tasks_dim(spark))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return E.episode_scores(E.final_states(_rewards(spark, d)))


@query(
    "d9_schema_progress",
    f"""WITH {_T}, a AS (SELECT *, CASE WHEN valid THEN schema_match END AS m FROM t),
    b AS (SELECT *, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM a)
    SELECT stmt_id, episode_id, step, round(prev, 6) AS previous_match, round(CASE WHEN valid THEN greatest(0, schema_match - prev) ELSE 0 END, 6) AS match_gain FROM b""",
)
def d9_schema_progress(spark: SparkSession, d: str) -> DataFrame:
    progress = schema_progress(_steps(spark, d))
    return progress.select(
        "stmt_id",
        "episode_id",
        "step",
        F.round("previous_match", 6).alias("previous_match"),
        F.round("match_gain", 6).alias("match_gain"),
    )


@query(
    "e1_step_rewards",
    f"""WITH {_RUNS} SELECT episode_id, step, shown AS result, round(reward, 6) AS reward,
      round(CASE WHEN counted THEN queries_failed / queries_total::double ELSE 0 END, 6) AS downtime_pct,
      cast(tot AS bigint) AS total_to_date, cast(bad AS bigint) AS failed_to_date, round(now, 6) AS match_to_date FROM y""",
)
def e1_step_rewards(spark: SparkSession, d: str) -> DataFrame:
    return _rewards(spark, d).select(
        "episode_id",
        "step",
        "result",
        F.round("reward", 6).alias("reward"),
        F.round("downtime_pct", 6).alias("downtime_pct"),
        "total_to_date",
        "failed_to_date",
        F.round("match_to_date", 6).alias("match_to_date"),
    )


@query(
    "e2_invalid_actions",
    f"""WITH {_RUNS} SELECT task_id, count(*) AS invalid_steps, count(*) FILTER (done) AS ended, round(sum(reward), 6) AS reward,
      cast(sum(CASE WHEN counted THEN queries_total ELSE 0 END) AS bigint) AS load FROM y WHERE NOT valid AND NOT masked GROUP BY 1""",
)
def e2_invalid_actions(spark: SparkSession, d: str) -> DataFrame:
    invalid = _rewards(spark, d).filter(~F.col("valid") & ~F.col("masked"))
    counted = F.when(F.col("valid"), F.col("queries_total")).otherwise(0)
    return invalid.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("invalid_steps"),
        F.count_if("done").alias("ended"),
        F.round(F.sum("reward"), 6).alias("reward"),
        F.sum(counted).alias("load"),
    )


@query("e3_mark_done", f"WITH {_RUNS} SELECT stmt_id, episode_id, step, done, masked FROM y")
def e3_mark_done(spark: SparkSession, d: str) -> DataFrame:
    return E.mark_done(_steps(spark, d), E.tasks_dim(spark)).select("stmt_id", "episode_id", "step", "done", "masked")


@query(
    "e4_cumulative_reward",
    f"""WITH {_RUNS} SELECT episode_id, step, round(reward, 6) AS reward, round(cum, 6) AS cumulative_reward,
      {_bounded('round(reward, 9)')} AS public_reward, {_bounded('round(cum, 9)')} AS public_cumulative_reward FROM y""",
)
def e4_cumulative_reward(spark: SparkSession, d: str) -> DataFrame:
    rounded = _rewards(spark, d).withColumns(
        {"reward": F.round("reward", 9), "cumulative_reward": F.round("cumulative_reward", 9)}
    )
    public = E.cumulative_reward(rounded)
    return public.withColumns({c: F.round(c, 6) for c in ("reward", "cumulative_reward")})


@query(
    "e5_episode_scores",
    f"""WITH {_FINAL} SELECT episode_id, task_id, step AS steps, done, round(now, 6) AS schema_match, kept::double AS data_integrity, cast(tot AS bigint) AS queries_total,
      cast(bad AS bigint) AS queries_failed, round(cum, 6) AS cumulative_reward, round(avail, 6) AS availability, score FROM g""",
)
def e5_episode_scores(spark: SparkSession, d: str) -> DataFrame:
    scored = _scored(spark, d).drop("feedback")
    return scored.withColumns({c: F.round(c, 6) for c in ("schema_match", "cumulative_reward", "availability")})


@query(
    "e6_bounded",
    f"SELECT l_orderkey, l_linenumber, {_bounded('l_discount * l_quantity')} AS score FROM lineitem",
)
def e6_bounded(spark: SparkSession, d: str) -> DataFrame:
    items = load_table(spark, d, "lineitem")
    return items.select("l_orderkey", "l_linenumber", scores.bounded(F.col("l_discount") * F.col("l_quantity")).alias("score"))


_GRADES = """
SELECT event_id, CASE event_id % 5
    WHEN 0 THEN '{{"current_schema_ddl": "a", "target_schema_ddl": "b", "data_hash_before": "h", "data_hash_after": "h", "availability_pct": 0.' || cast(event_id % 10 AS string) || '}}'
    WHEN 1 THEN '{{"current_schema_ddl": null, "target_schema_ddl": "b", "data_hash_before": "h", "data_hash_after": "i", "availability_pct": 1.5}}'
    WHEN 2 THEN '{{"current_schema_ddl": "a", "availability_pct": "0.5"}}'
    WHEN 3 THEN '{{"current_schema_ddl": "a", "target_schema_ddl": "b", "data_hash_before": "h", "data_hash_after": "h", "availability_pct": "x", "note": 1}}'
    ELSE '{{}}' END AS payload, event_id % 8 / 8.0D AS schema_match
FROM {events}
"""


@query(
    "e7_coerce_inputs",
    f"""WITH p AS (SELECT event_id, event_id % 8 / 8.0 AS schema_match, event_id % 5 AS k FROM events),
    c AS (SELECT event_id, schema_match::double AS schema_match, CASE WHEN k IN (0, 2, 3) THEN 'a' ELSE '' END AS current_schema_ddl, CASE WHEN k IN (0, 1, 3) THEN 'b' ELSE '' END AS target_schema_ddl,
      CASE WHEN k IN (0, 1, 3) THEN 'h' ELSE '' END AS data_hash_before, CASE k WHEN 0 THEN 'h' WHEN 1 THEN 'i' WHEN 3 THEN 'h' ELSE '' END AS data_hash_after,
      CASE k WHEN 0 THEN cast('0.' || event_id % 10 AS double) WHEN 1 THEN 1 WHEN 2 THEN 0.5 ELSE 0 END::double AS availability_pct, k IN (0, 1, 3) AS complete FROM p)
    SELECT *, {_bounded('CASE WHEN complete AND data_hash_before = data_hash_after THEN schema_match * availability_pct ELSE 0 END')} AS score FROM c""",
)
def e7_coerce_inputs(spark: SparkSession, d: str) -> DataFrame:
    return E.grade_inputs(E.coerce_inputs(derive(spark, d, _GRADES, heavy=True)))


@query("e8_feedback", f"WITH {_FINAL} SELECT episode_id, label AS feedback FROM g")
def e8_feedback(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("episode_id", "feedback")


@query(
    "e8_direct_feedback",
    f"""WITH {_FINAL} SELECT episode_id, score, CASE WHEN score >= 0.9 THEN '{scores.DIRECT_PASS}' WHEN score <= 0.1 THEN '{scores.DIRECT_LOW}'
      ELSE '{scores.DIRECT_MID}' END AS feedback FROM g""",
)
def e8_direct_feedback(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("episode_id", "score", scores.direct_feedback(F.col("score")).alias("feedback"))


@query(
    "e9_step_info",
    f"""WITH {_RUNS} SELECT episode_id, task_id, step, {_bounded('now * kept * avail')} AS score, {_bounded('now')} AS schema_match, {_bounded('avail')} AS availability,
      {_bounded('kept')} AS data_integrity, CASE WHEN shown NOT IN ('SUCCESS', 'RESET', 'EPISODE_DONE') THEN shown END AS last_error,
      {_bounded('now * kept * avail')} >= 0.9 AS success FROM y""",
)
def e9_step_info(spark: SparkSession, d: str) -> DataFrame:
    return E.step_info(_rewards(spark, d))


# one request per customer: for the current episode, for another one, or for any
_LAST = """SELECT task_id, max(episode_id) AS episode_id FROM g GROUP BY 1"""


@query(
    "e10_resolve_grades",
    f"""WITH {_FINAL}, l AS ({_LAST}), cur AS (SELECT g.* FROM g JOIN l USING (task_id, episode_id)),
    q AS (SELECT c_custkey AS request_id, CASE c_custkey % 4 WHEN 0 THEN 'easy_add_column' WHEN 1 THEN 'medium_rename_fk' WHEN 2 THEN 'hard_repartition' ELSE 'unknown_task' END AS task_id,
      CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey END AS episode_id FROM customer)
    SELECT q.request_id, q.task_id, q.episode_id, CASE WHEN cur.episode_id IS NULL OR q.episode_id <> cur.episode_id THEN 0.001::double ELSE score END AS score,
      CASE WHEN cur.episode_id IS NULL THEN '{E.NO_EPISODE}' WHEN q.episode_id <> cur.episode_id THEN '{E.OTHER_EPISODE}' ELSE label END AS feedback FROM q LEFT JOIN cur ON q.task_id = cur.task_id""",
)
def e10_resolve_grades(spark: SparkSession, d: str) -> DataFrame:
    scored = _scored(spark, d).withColumn("reset_ts", F.col("episode_id"))
    current = E.latest_episode(scored, carry=["score", "feedback"])
    requests = load_table(spark, d, "customer").selectExpr(
        "c_custkey AS request_id",
        "CASE c_custkey % 4 WHEN 0 THEN 'easy_add_column' WHEN 1 THEN 'medium_rename_fk' WHEN 2 THEN 'hard_repartition' ELSE 'unknown_task' END AS task_id",
        "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey END AS episode_id",
    )
    return E.resolve_grades(requests, current)


@query(
    "e11_latest_episode",
    f"""SELECT {TASK_OF_EPISODE} AS task_id, arg_max(cast(floor(event_id / 9) AS bigint), ts) AS episode_id, cast(max(ts) AS varchar) AS reset_ts FROM events GROUP BY 1""",
)
def e11_latest_episode(spark: SparkSession, d: str) -> DataFrame:
    resets = load_table(spark, d, "events").selectExpr(
        f"{TASK_OF_EPISODE} AS task_id", "cast(floor(event_id / 9) AS bigint) AS episode_id", "ts AS reset_ts"
    )
    return E.latest_episode(resets).withColumn("reset_ts", F.col("reset_ts").cast("string"))


@query(
    "e12_run_summary",
    f"""WITH {_RUNS}, v AS (SELECT *, {_bounded('round(reward, 9)')} AS pr, {_bounded('now * kept * avail')} AS p FROM y WHERE NOT masked)
    SELECT episode_id, task_id, count(*) AS steps, arg_max(p, step) AS score, arg_max(p, step) >= 0.9 AS success,
      string_agg(cast(pr AS varchar), ',' ORDER BY step) AS rewards FROM v GROUP BY 1, 2""",
)
def e12_run_summary(spark: SparkSession, d: str) -> DataFrame:
    rewards = _rewards(spark, d).withColumn("reward", F.round("reward", 9))
    return E.run_summary(rewards).withColumn("rewards", F.concat_ws(",", F.col("rewards").cast("array<string>")))


@query(
    "e13_recent_history",
    f"""WITH {_T}, n AS (SELECT *, sql || '|' || result AS item FROM t)
    SELECT stmt_id, episode_id, step, coalesce(string_agg(item, ' / ') OVER (PARTITION BY episode_id ORDER BY step ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS history FROM n""",
)
def e13_recent_history(spark: SparkSession, d: str) -> DataFrame:
    history = E.recent_history(_steps(spark, d))
    text = F.array_join(F.transform("history", lambda h: F.concat_ws("|", h["sql"], h["result"])), " / ")
    return history.select("stmt_id", "episode_id", "step", text.alias("history"))


# a log of the create-copy-swap task whose episodes got to different points
_SWAP_LOG = f"""
SELECT episode_id, 'hard_repartition' AS task_id, step, result, cast((step + episode_id % 3) % 8 AS int) AS at FROM ({STMTS}) s
"""


@query(
    "e14_next_pending",
    f"""WITH l AS ({cte(_SWAP_LOG)}), p AS (SELECT unnest(range(1, 8)) AS n), ep AS (SELECT DISTINCT episode_id, task_id FROM l),
    todo AS (SELECT ep.*, n FROM ep, p WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.episode_id = ep.episode_id AND l.at = p.n AND result = 'SUCCESS'))
    SELECT ep.episode_id, ep.task_id, cast(min(n) AS int) AS next_ordinal, CASE min(n) """
    + " ".join(f"WHEN {at} THEN '{sql}'" for at, sql in enumerate(E.SWAP_PLAYBOOK, start=1))
    + " ELSE 'SELECT 1;' END AS next_sql FROM ep LEFT JOIN todo USING (episode_id, task_id) GROUP BY 1, 2",
)
def e14_next_pending(spark: SparkSession, d: str) -> DataFrame:
    plan = E.playbook(spark, "hard_repartition", E.SWAP_PLAYBOOK)
    log = derive(spark, d, _SWAP_LOG, heavy=True)
    history = log.withColumn("sql", F.when(F.col("at") > 0, F.try_element_at(F.array(*map(F.lit, E.SWAP_PLAYBOOK)), F.col("at"))))
    return E.next_pending(plan, history.drop("at", "step"))


# features of the schema that an episode has reached, one row per statement that stands for one
_FEATURES = f"""
SELECT episode_id AS snapshot_id, task_id, CASE stmt_id % 16 WHEN 0 THEN 'email' WHEN 1 THEN 'is_active' WHEN 2 THEN 'user_id' ELSE 'username' END AS col_name,
  CASE WHEN stmt_id % 16 = 2 THEN 'serial' ELSE 'text' END AS col_type, stmt_id % 16 = 2 AS is_primary FROM ({STMTS}) s
"""
_FEATURE_FKS = f"""
SELECT episode_id AS snapshot_id, task_id, 'fk_orders_users' AS fk_name, 'users' AS ref_table, CASE WHEN stmt_id % 16 = 3 THEN 'id' ELSE 'user_id' END AS ref_column
FROM ({STMTS}) s WHERE stmt_id % 16 IN (3, 4)
"""


@query(
    "e15_next_by_schema",
    f"""WITH {_S}, h AS (SELECT episode_id AS snapshot_id, task_id, bool_or(stmt_id % 16 = 0) AS email, bool_or(stmt_id % 16 = 1) AS active, bool_or(stmt_id % 16 = 2) AS key,
      bool_or(stmt_id % 16 = 3) AS old, bool_or(stmt_id % 16 = 4) AS new FROM s GROUP BY 1, 2)
    SELECT snapshot_id, task_id, CASE task_id WHEN 'easy_add_column' THEN CASE WHEN NOT email THEN '{E.ADD_EMAIL}' WHEN NOT active THEN '{E.ADD_ACTIVE}' ELSE 'SELECT 1;' END
      WHEN 'medium_rename_fk' THEN CASE WHEN new THEN 'SELECT 1;' WHEN old THEN '{E.DROP_ORDERS_FK}' WHEN NOT key THEN '{E.RENAME_USERS_ID}' ELSE '{E.ADD_ORDERS_FK}' END
      ELSE 'SELECT 1;' END AS next_sql FROM h""",
)
def e15_next_by_schema(spark: SparkSession, d: str) -> DataFrame:
    return E.next_by_schema(derive(spark, d, _FEATURES), derive(spark, d, _FEATURE_FKS))


@query(
    "e16_leaderboard",
    f"""WITH {_FINAL}, board AS (SELECT task_id, count(*) AS runs, round(avg(score), 6) AS mean_score, max(score) AS best_score, round(avg(CASE WHEN score >= 0.9 THEN 1.0 ELSE 0.0 END), 6) AS success_rate FROM g GROUP BY 1)
    SELECT task_id, runs, mean_score, best_score, success_rate, cast(rank() OVER (ORDER BY mean_score DESC) AS int) AS place FROM board
    UNION ALL SELECT '*', count(*), round(avg(score), 6), max(score), round(avg(CASE WHEN score >= 0.9 THEN 1.0 ELSE 0.0 END), 6), NULL FROM g""",
)
def e16_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    return E.leaderboard(_scored(spark, d))


@query(
    "e17_tasks_dim",
    f"""WITH {_S} SELECT task_id, CASE task_id WHEN 'easy_add_column' THEN 'easy' WHEN 'medium_rename_fk' THEN 'medium' ELSE 'hard' END AS difficulty,
      cast({_LOAD} AS int) AS load_level, cast({_MAX} AS int) AS max_steps, count(*) AS statements, count(*) FILTER (step <= {_MAX}) AS allowed FROM s GROUP BY task_id""",
)
def e17_tasks_dim(spark: SparkSession, d: str) -> DataFrame:
    joined = _stmts(spark, d).join(F.broadcast(E.tasks_dim(spark)), "task_id")
    return joined.groupBy("task_id", "difficulty", "load_level", "max_steps").agg(
        F.count(F.lit(1)).alias("statements"), F.count_if(F.col("step") <= F.col("max_steps")).alias("allowed")
    )


# ---------------------------------------------------------------- streams


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A stream over the files of one table, stored as one file or as a folder of files.

    A stream source takes a pattern for either; a plain path must be a folder.
    """
    return spark.readStream.schema(load_table(spark, d, name).schema).parquet(f"{d.rstrip('/')}/{name}.parque[t]")


@query(
    "t1_live_availability",
    """WITH w AS (SELECT date_trunc('hour', ts) AS h, event_type = 'error' AS failed FROM events),
    g AS (SELECT h, count(*) AS n, count(*) FILTER (failed) AS f FROM w GROUP BY 1)
    SELECT cast(h AS varchar) AS window_start, cast(h + INTERVAL 1 HOUR AS varchar) AS window_end, n AS queries_total, f AS queries_failed,
      round(1 - f / n::double, 6) AS availability FROM g WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""",
)
def t1_live_availability(spark: SparkSession, d: str) -> DataFrame:
    workload = _stream(spark, d, "events").select("ts", (F.col("event_type") == "error").alias("failed"))
    path, checkpoint = fresh_path(spark, "windows"), fresh_path(spark, "windows-state")
    windows = live.live_availability(workload, "1 hour", delay="1 day")
    shown = windows.select(
        F.col("window_start").cast("timestamp_ntz").cast("string").alias("window_start"),
        F.col("window_end").cast("timestamp_ntz").cast("string").alias("window_end"),
        "queries_total",
        "queries_failed",
        F.round("availability", 6).alias("availability"),
    )
    sink = shown.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    sink.trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(shown.schema).parquet(path)


@query(
    "t2_live_episodes",
    f"""WITH {_FINAL} SELECT episode_id, task_id, step, round(now, 6) AS schema_match, cast(tot AS bigint) AS queries_total, cast(bad AS bigint) AS queries_failed,
      round(cum, 6) AS cumulative_reward, done FROM g""",
)
def t2_live_episodes(spark: SparkSession, d: str) -> DataFrame:
    steps = spark.sql(STEPS, events=_stream(spark, d, "events"))
    path, checkpoint = fresh_path(spark, "episodes"), fresh_path(spark, "episodes-state")

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    states = live.live_episodes(steps, E.tasks_dim(spark))
    sink = states.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint)
    sink.trigger(availableNow=True).start().awaitTermination()
    latest = spark.read.parquet(path).groupBy("episode_id", "task_id").agg(
        F.max_by(F.struct("step", "schema_match", "queries_total", "queries_failed", "cumulative_reward", "done"), "batch").alias("__state")
    )
    rounded = latest.select("episode_id", "task_id", "__state.*")
    return rounded.withColumns({c: F.round(c, 6) for c in ("schema_match", "cumulative_reward")})


@query(
    "t3_catch_up",
    f"SELECT o_orderkey, o_custkey, o_totalprice, {_bucket('o_custkey', 8)} AS bucket FROM orders",
)
def t3_catch_up(spark: SparkSession, d: str) -> DataFrame:
    path, checkpoint = fresh_path(spark, "caught-up"), fresh_path(spark, "caught-up-state")
    source = _stream(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    live.catch_up(source, "o_custkey", 8, path, checkpoint).awaitTermination()
    return spark.read.parquet(path).drop("batch")
