import pytest
from pyspark.sql import functions as F

from tidemark.functions.text import without_comments
from tidemark.operators import evolution as V
from tidemark.operators import schema as D
from tidemark.operators.episodes import tasks_dim

START = "CREATE TABLE users (id SERIAL PRIMARY KEY); CREATE TABLE orders (id INT, user_id INT, CONSTRAINT fk FOREIGN KEY (user_id) REFERENCES users(id));"
RENAME = "ALTER TABLE users RENAME COLUMN id TO user_id;"
DROP = "ALTER TABLE orders DROP CONSTRAINT fk;"
ADD = "ALTER TABLE orders ADD CONSTRAINT fk FOREIGN KEY (user_id) REFERENCES users({});"
LOG = "episode_id string, task_id string, step int, sql string, ran boolean"


def log_of(spark, statements, task="easy_add_column"):
    rows = [("e", task, n, sql, ran) for n, (sql, ran) in enumerate([(START, True), *statements])]
    return spark.createDataFrame(rows, LOG)


@pytest.fixture(scope="module")
def tasks(spark):
    return tasks_dim(spark)


def test_statements_meet_the_schema_of_their_moment(spark, tasks):
    log = log_of(spark, [(RENAME, True), (f"/* first the key */ {DROP} -- then\n{RENAME}", True), (ADD.format("id"), True), (ADD.format("user_id"), False), (ADD.format("user_id"), True)])
    rows = V.preflight(D.schema_changes(log), tasks).orderBy("step", "pos").collect()
    assert [(r["step"], r["pos"], r["op"], r["problem"], r["made"]) for r in rows] == [
        (1, 0, "rename_column", "foreign key constraint still references users(id); drop referencing constraint(s) first: orders.fk", False),
        (2, 0, "drop_constraint", None, True),
        (2, 1, "rename_column", None, True),
        (3, 0, "add_constraint", "referenced column users.id does not exist", False),
        (4, 0, "add_constraint", None, False),
        (5, 0, "add_constraint", None, True),
    ]


def test_schema_of_every_step(spark, tasks):
    log = log_of(spark, [("SELECT 1", True), (DROP, True), (RENAME, True), ("SELECT 2", True), ("DROP TABLE users", True), ("DROP TABLE orders", True)])
    changes = D.schema_changes(log)
    by_step = V.schema_by_step(changes, log, tasks)
    listed = {step: set() for step in range(6)}
    for r in V.features(by_step).collect():
        listed[r["step"]].add(r["feature"])
    # the task allows five steps: the sixth is not executed
    assert by_step.count() == 6 and set(listed) == set(range(6))
    assert listed[0] == listed[1] and "fk|orders|fk|user_id|users|id" in listed[1]
    assert listed[2] == {f for f in listed[1] if not f.startswith("fk|")}
    assert "column|users|user_id|serial||false|true" in listed[3] and listed[4] == listed[3]
    assert {f.split("|")[1] for f in listed[5]} == {"orders"}
    last = D.replay_schema(changes, tasks).select("schema").first()
    assert {c["table_name"] for c in last["schema"]["columns"]} == {"orders"}


def test_an_unlisted_task_has_the_largest_limit(spark, tasks):
    log = log_of(spark, [("SELECT 1", True)] * 6 + [(DROP, True)] * 4, task="unheard of")
    by_step = V.schema_by_step(D.schema_changes(log), log, tasks)
    assert by_step.agg(F.max("step")).first()[0] == 8
    assert len(D.replay_schema(D.schema_changes(log), tasks).first()["schema"]["fks"]) == 0


def test_snapshots_can_be_matched(spark, tasks):
    log = log_of(spark, [(DROP, True), (ADD.format("id"), True)])
    by_step = V.schema_by_step(D.schema_changes(log), log, tasks)
    target = D.ddl_to_schema(spark.createDataFrame([("t", START)], "target_id string, ddl string"))
    matched = D.schema_match(*V.as_snapshots(by_step, F.lit("t")), target).collect()
    got = {r["snapshot_id"]["step"]: r["schema_match"] for r in matched}
    assert got[0] == got[2] == 1.0 and got[1] < 1.0


def test_long_literals_and_comments(spark):
    quotes = "''" * 500_000
    texts = {
        "CREATE TABLE t (a TEXT DEFAULT '" + "x--" * 400_000 + "'); -- c": "CREATE TABLE t (a TEXT DEFAULT '" + "x--" * 400_000 + "');  ",
        f"SELECT '{quotes}' /* {'* ' * 500_000}*/": f"SELECT '{quotes}'  ",
        "a /* never closed": "a /* never closed",
        "/**/b /***/ c": " b   c",
    }
    rows = spark.createDataFrame([(k,) for k in texts], "t string").select("t", without_comments(F.col("t")).alias("c")).collect()
    # blanks may be added, never anything else
    assert all(r["c"].replace(" ", "") == texts[r["t"]].replace(" ", "") for r in rows)
