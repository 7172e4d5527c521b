"""Input that logs hold now and then: nulls as keys, deep brackets, unlisted tasks, odd JSON."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions.text import without_parens
from tidemark.functions.windows import previous_rows, running
from tidemark.operators import availability, episodes, integrity, schema, statements
from tidemark.sources import logs
from tidemark.streaming import live


def test_running_values_of_a_null_key(spark):
    rows = spark.createDataFrame([(None, i) for i in range(6)] + [("a", i) for i in range(6)], "k string, n long")
    out = running(rows, ["k"], "n", {"total": ("sum", F.lit(1), True)}, span=2)
    assert sorted((r["n"], r["total"]) for r in out.collect() if r["k"] is None) == [(i, i + 1) for i in range(6)]
    last = previous_rows(rows, ["k"], "n", F.col("n"), "before", 3, span=2)
    assert {r["n"]: r["before"] for r in last.collect() if r["k"] is None}[5] == [2, 3, 4]


def test_brackets_of_any_depth(spark):
    deep = "SELECT a FROM " + "(" * 12 + "x UNION y" + ")" * 12 + " b"
    texts = [(deep,), ("a (b) c",), ("a ) b ( c",), ("((((((a)",), ("",), (None,)]
    out = [r[0] for r in spark.createDataFrame(texts, "t string").select(without_parens(F.col("t"))).collect()]
    assert "UNION" not in out[0] and out[1] == "a   c" and out[2] == "a ) b ( c" and out[3] == "((((( " and out[4:] == ["", None]
    locks = statements.classify_locks(spark.createDataFrame([(deep,)], "statement string")).first()
    assert locks["lock_type"] == "NONE"


def test_fingerprints_see_nested_microseconds(spark):
    def table(micros):
        return spark.createDataFrame([((dt.datetime(2024, 1, 1, 0, 0, 0, micros), None),)], "s struct<at: timestamp, x: int>")

    one, two = (integrity.fingerprint(table(m)).first()["digest"] for m in (1, 2))
    assert one != two


def test_scores_may_be_truth_values(spark):
    lines = spark.createDataFrame(
        [("r", 1, '{"easy_add_column": true, "medium_rename_fk": 0.5, "hard_repartition": false}'),
         ("s", 1, '{"easy_add_column": "yes", "medium_rename_fk": 0.5, "hard_repartition": 0}')],
        "run string, line_no long, line string",
    )
    found = {r["run"]: r for r in logs.last_score_payload(lines, "run", "line_no").collect()}
    assert found["r"]["valid"] and found["r"]["easy_add_column"] > 0.99 and not found["s"]["valid"]


def test_a_null_statement_is_no_action(spark):
    actions = spark.createDataFrame([('{"sql": null}', "t"), ('{"note": 1}', "t"), ('{"sql": "SELECT 2;"}', "t")], "payload string, active_task_id string")
    assert [(r["valid"], r["sql"]) for r in logs.decode_actions(actions).collect()] == [(False, None), (True, "SELECT 1;"), (True, "SELECT 2;")]


def test_added_columns_in_other_forms(spark):
    texts = [
        "ALTER TABLE public.users ADD a INT, ADD COLUMN IF NOT EXISTS b DECIMAL(1, 2), c TEXT;",
        "ALTER TABLE users ADD COLUMN a INT, DROP COLUMN b",
        "ALTER TABLE users ADD CONSTRAINT k UNIQUE (a, b)",
    ]
    rows = statements.expand_add_columns(spark.createDataFrame([(t,) for t in texts], "statement string")).collect()
    assert [r["expanded"] for r in rows] == [
        "ALTER TABLE public.users ADD COLUMN a INT",
        "ALTER TABLE public.users ADD COLUMN b DECIMAL(1, 2)",
        "ALTER TABLE public.users ADD COLUMN c TEXT",
        texts[1],
        texts[2],
    ]


def test_unlisted_tasks_stay(spark):
    tasks = episodes.tasks_dim(spark)
    stmts = spark.createDataFrame([("nowhere", 2, 0.5), ("easy_add_column", 2, 0.5)], "task_id string, lock_ticks int, failure_rate double")
    impact = {r["task_id"]: r["expected_queries"] for r in availability.expected_impact(stmts, tasks).collect()}
    assert impact == {"nowhere": None, "easy_add_column": 60}
    plan = episodes.playbook(spark, "easy_add_column", [episodes.ADD_EMAIL])
    history = spark.createDataFrame([(1, "nowhere", "SELECT 1;", "SUCCESS")], "episode_id long, task_id string, sql string, result string")
    assert [r["next_sql"] for r in episodes.next_pending(plan, history).collect()] == [logs.NO_OP_SQL]


STEP = (
    "episode_id long, task_id string, step int, result string, schema_match double, queries_total long, "
    "queries_failed long, data_integrity double"
)


def test_steps_of_other_tasks_are_invalid_and_counted(spark):
    own, other = "easy_add_column", "hard_repartition"
    tasks = [own, other, "nowhere", own, own, own, own]
    rows = [(1, task, i + 1, "SUCCESS", 0.1 * (i + 1), 10, 0, 1.0) for i, task in enumerate(tasks)]
    rows += [(2, "nowhere", 1, "SUCCESS", 0.5, 10, 0, 1.0), (3, own, 1, "EXECUTION_ERROR: no table", 0.5, 10, 0, 1.0)]
    got = {
        (r["episode_id"], r["step"]): r
        for r in episodes.step_rewards(spark.createDataFrame(rows, STEP), episodes.tasks_dim(spark)).collect()
    }
    assert len(got) == len(rows)
    assert [round(got[1, s]["reward"], 9) for s in range(1, 8)] == [0.1, -0.05, -0.05, 0.3, 0.1, 0, 0]
    # the limit is that of the episode's own task
    assert [got[1, s]["done"] for s in range(1, 8)] == [False] * 4 + [True] * 3
    assert [got[1, s]["masked"] for s in range(1, 8)] == [False] * 5 + [True] * 2
    assert got[2, 1]["reward"] == got[3, 1]["reward"] == -0.05 and got[2, 1]["total_to_date"] == 0
    final = {r["episode_id"]: (r["task_id"], r["steps"]) for r in episodes.final_states(spark.createDataFrame([r.asDict() for r in got.values()])).collect()}
    assert final == {1: (own, 5), 2: ("nowhere", 1), 3: (own, 1)}


def test_live_episodes_follow_the_batch_rules(spark):
    own, other = "easy_add_column", "hard_repartition"
    rows = [
        (1, own, 1, "SUCCESS", 0.6, 10, 0, 1.0, False), (1, own, 2, "SUCCESS", 0.9, 10, 1, 1.0, True), (1, other, 3, "SUCCESS", 1.0, 10, 0, 1.0, False),
        (2, other, 7, "SUCCESS", 0.7, 10, 5, 1.0, False), (3, "nowhere", 1, "SUCCESS", 1.0, 10, 0, 1.0, False),
    ]
    steps = spark.createDataFrame(rows, STEP + ", destroys_data boolean")
    tasks = episodes.tasks_dim(spark)
    batch = episodes.final_states(episodes.step_rewards(steps, tasks, start_match=0.5)).collect()
    streamed = {r["episode_id"]: r for r in live.live_episodes(steps, tasks, start_match=0.5).collect()}
    for r in batch:
        s = streamed[r["episode_id"]]
        assert (s["task_id"], s["step"], s["done"]) == (r["task_id"], r["steps"], r["done"])
        assert abs(s["cumulative_reward"] - r["cumulative_reward"]) < 1e-9 and s["queries_total"] == r["queries_total"]
    assert len(batch) == len(streamed) == 3 and abs(streamed[1]["cumulative_reward"] - 0.05) < 1e-9


def test_ddl_as_people_write_it(spark):
    text = """-- users; of the shop
    CREATE TEMP TABLE public."users" (
      id INTEGER PRIMARY KEY, -- the key, really
      name character varying(20) DEFAULT '--none', /* a, comment */
      paid NUMERIC(10, 2), ok BOOL, seen timestamp without time zone);
    CREATE UNLOGGED TABLE IF NOT EXISTS "shop"."orders" (
      id int4, user_id int, FOREIGN KEY (user_id) REFERENCES public.users,
      CONSTRAINT "fk" FOREIGN KEY ("user_id") REFERENCES "users" ("id") ON DELETE CASCADE);"""
    ddl = spark.createDataFrame([(1, text)], "snapshot_id long, ddl string")
    columns = [(r["table_name"], r["col_name"], r["col_type"], r["col_default"]) for r in schema.ddl_to_columns(ddl).collect()]
    assert columns == [
        ("users", "id", "integer", ""),
        ("users", "name", "varchar(20)", "'--none'"),
        ("users", "paid", "decimal(10,2)", ""),
        ("users", "ok", "boolean", ""),
        ("users", "seen", "timestamp", ""),
        ("orders", "id", "integer", ""),
        ("orders", "user_id", "integer", ""),
    ]
    fks = [(r["table_name"], r["fk_name"], r["col_name"], r["ref_table"], r["ref_column"]) for r in schema.ddl_to_fks(ddl).collect()]
    assert fks == [("orders", "", "user_id", "users", ""), ("orders", "fk", "user_id", "users", "id")]
