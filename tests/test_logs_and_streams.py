import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidemark.operators import episodes as E
from tidemark.sources import logs, seeds
from tidemark.sources.tables import write_batched
from tidemark.sources.workspace import fresh_path, shared_dir
from tidemark.streaming import live


def test_run_log(spark):
    action = json.dumps({"sql": "SELECT ' reward=1 done=true ' FROM t;"}, separators=(",", ":"))
    lines = [
        "[START] task=easy_add_column env=w model=m-1",
        f"[STEP] step=1 action={action} reward=0.250 done=false error=null",
        '[STEP] step=2 action={} reward=0.001 done=true error=no such table: t done=maybe',
        "[END] task=easy_add_column success=true steps=2 score=0.900 rewards=0.250,0.001",
        "noise",
        "[STEP] cut off",
    ]
    df = spark.createDataFrame([(at, text) for at, text in enumerate(lines)], "line_no int, line string")
    rows = {r["line_no"]: r for r in logs.parse_run_log(df).collect()}
    assert set(rows) == {0, 1, 2, 3, 5}
    assert (rows[0]["kind"], rows[0]["task_id"], rows[0]["model"]) == ("START", "easy_add_column", "m-1")
    assert (rows[1]["step"], rows[1]["action"], rows[1]["reward"], rows[1]["done"], rows[1]["error"]) == (1, action, 0.25, False, None)
    assert (rows[2]["done"], rows[2]["error"]) == (True, "no such table: t done=maybe")
    assert (rows[3]["success"], rows[3]["steps"], rows[3]["score"], rows[3]["rewards"]) == (True, 2, 0.9, [0.25, 0.001])
    assert rows[5]["step"] is None


def test_last_payload(spark):
    good = '{"easy_add_column": 2, "medium_rename_fk": "0.5", "hard_repartition": 0}'
    lines = [(1, 1, "log"), (1, 2, good), (1, 3, "{broken}"), (2, 1, good), (2, 2, '{"error": "x"}'), (3, 1, "[1]"), (4, 1, good[:-1] + ', "x": 1}')]
    df = spark.createDataFrame(lines, "run int, n int, line string")
    got = {r["run"]: (r["line_no"], r["valid"], r["easy_add_column"], r["medium_rename_fk"], r["hard_repartition"]) for r in logs.last_score_payload(df, "run", "n").collect()}
    assert got == {1: (2, True, 0.998, 0.5, 0.001), 2: (2, False, None, None, None), 4: (1, False, None, None, None)}


def test_actions(spark):
    cases = [
        ({"sql": "A;", "execute_mode": "autocommit", "task_id": "other"}, ("A;", "autocommit", True)),
        ("A;", ("A;", "transaction", True)),
        ({"commands": [{"action_type": "EXECUTE_SQL", "query": "Q"}]}, ("Q", "transaction", True)),
        ({"commands": [{"sql": "Q"}]}, ("SELECT 1;", "transaction", True)),
        ({"commands": ["x"]}, ("SELECT 1;", "transaction", True)),
        ({"commands": None, "sql": "Z"}, ("SELECT 1;", "transaction", True)),
        ({}, ("SELECT 1;", "transaction", True)),
        ({"sql": "A", "execute_mode": "maybe"}, (None, None, False)),
        (5, (None, None, False)),
    ]
    df = spark.createDataFrame([(at, json.dumps(c[0]), "t") for at, c in enumerate(cases)], "at int, payload string, active_task_id string")
    for r in logs.decode_actions(df).collect():
        assert (r["sql"], r["execute_mode"], r["valid"]) == cases[r["at"]][1], cases[r["at"]]
        assert r["task_id"] == "t"


def test_seeds(spark):
    users = seeds.gen_users(seeds.row_numbers(spark, 200)).orderBy("id").collect()
    assert (users[0]["username"], str(users[199]["created_at"])) == ("user_0001", "2025-01-01 00:03:19")
    orders = {r["id"]: (r["user_id"], str(r["amount"])) for r in seeds.gen_orders(seeds.row_numbers(spark, 60)).collect()}
    assert orders[1] == (1, "10.37") and orders[26] == (1, "19.62")
    items = seeds.gen_order_items(seeds.row_numbers(spark, 180)).orderBy("id").collect()
    assert tuple(items[61]) == (62, 2, "pen_0062")
    events = seeds.gen_events(seeds.row_numbers(spark, 256)).orderBy("id").collect()
    assert json.loads(events[6]["payload"]) == {"batch": 0, "kind": "login", "seq": 7}
    assert (events[255]["user_id"], str(events[255]["created_at"])) == (64, "2025-01-01 04:15:00")


def test_write_batched(spark):
    path = fresh_path(spark, "batches")
    write_batched(spark.range(0, 1000, 1, 2), path, 200)
    sizes = spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in sizes) == 200 and sum(r["count"] for r in sizes) == 1000


class _Cluster:
    """A session that is not local, with or without the setting."""

    def __init__(self, named):
        self.conf = SimpleNamespace(get=lambda key, default=None: named)
        self.sparkContext = SimpleNamespace(master="yarn", getConf=lambda: SimpleNamespace(get=lambda key: None))


def test_shared_folder_is_the_one_the_cluster_names(spark):
    assert shared_dir(_Cluster("hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(ValueError):
        shared_dir(_Cluster(None))
    assert shared_dir(spark) == shared_dir(spark)


def _write_part(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def _run(writer, path=None):
    query = writer.trigger(availableNow=True).start(path) if path else writer.trigger(availableNow=True).start()
    query.awaitTermination()


def test_windows_close_with_the_watermark_and_drop_late_rows(spark):
    source, sink, state = (fresh_path(spark, n) for n in ("w-in", "w-out", "w-state"))
    schema = "ts string, failed boolean"

    def run():
        stream = spark.readStream.schema(schema).parquet(source).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        windows = live.live_availability(stream, "1 hour", delay="2 hours")
        _run(windows.writeStream.outputMode("append").format("parquet").option("checkpointLocation", state), sink)
        return {str(r["window_start"]): (r["queries_total"], r["queries_failed"]) for r in spark.read.schema(windows.schema).parquet(sink).collect()}

    _write_part(spark, [("2025-01-01 00:10:00", True), ("2025-01-01 00:50:00", False), ("2025-01-01 05:00:00", False)], schema, source)
    assert run() == {"2025-01-01 00:00:00": (2, 1)}
    _write_part(spark, [("2025-01-01 00:20:00", True), ("2025-01-01 04:30:00", True), ("2025-01-01 09:00:00", False)], schema, source)
    assert run() == {"2025-01-01 00:00:00": (2, 1), "2025-01-01 04:00:00": (1, 1), "2025-01-01 05:00:00": (1, 0)}
    batch = live.live_availability(spark.read.schema(schema).parquet(source), "2 hours", "1 hour")
    assert batch.agg(F.sum("queries_total")).first()[0] == 12


def test_live_state_equals_batch_over_many_batches_and_replays(spark):
    from test_episodes import _STEPS, _random_steps

    rows = _random_steps(4)
    source, sink, state = (fresh_path(spark, n) for n in ("e-in", "e-out", "e-state"))

    def run():
        stream = spark.readStream.schema(_STEPS).parquet(source)
        states = live.live_episodes(stream, E.tasks_dim(spark))
        store = states.writeStream.outputMode("update").option("checkpointLocation", state).foreachBatch(
            lambda batch, n: batch.write.mode("overwrite").parquet(f"{sink}/batch={n}")
        )
        _run(store)

    for low, high in ((0, 3), (3, 6), (5, 20)):  # step 5 is delivered twice
        _write_part(spark, [r for r in rows if low <= r[2] < high], _STEPS, source)
        run()
    fields = ["step", "schema_match", "queries_total", "queries_failed", "cumulative_reward", "done"]
    latest = spark.read.parquet(sink).groupBy("episode_id").agg(F.max_by(F.struct(*fields), "batch").alias("x")).select("episode_id", "x.*")
    got = {r["episode_id"]: r for r in latest.collect()}
    final = E.final_states(E.step_rewards(spark.createDataFrame(rows, _STEPS), E.tasks_dim(spark))).collect()
    assert set(got) == {r["episode_id"] for r in final}
    for r in final:
        live_row = got[r["episode_id"]]
        assert (live_row["step"], live_row["queries_total"], live_row["queries_failed"], live_row["done"]) == (
            r["steps"], r["queries_total"], r["queries_failed"], r["done"],
        )
        assert abs(live_row["cumulative_reward"] - r["cumulative_reward"]) < 1e-9
        assert abs(live_row["schema_match"] - r["schema_match"]) < 1e-9


def test_catch_up_is_exactly_once(spark):
    source, target, state = (fresh_path(spark, n) for n in ("c-in", "c-out", "c-state"))
    for part in range(3):
        _write_part(spark, [(part * 10 + n, n) for n in range(10)], "id int, user_id int", source)
        stream = spark.readStream.schema("id int, user_id int").parquet(source)
        live.catch_up(stream, "user_id", 4, target, state).awaitTermination()
    stored = spark.read.parquet(target)
    assert sorted(r["id"] for r in stored.collect()) == list(range(30))
    assert stored.groupBy("user_id").agg(F.countDistinct("bucket").alias("n")).filter("n > 1").count() == 0
