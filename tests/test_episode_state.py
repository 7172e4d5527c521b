import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import episodes as E
from tidemark.sources.workspace import fresh_path
from tidemark.streaming.episode_state import live_episode_states


@pytest.fixture()
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    kept = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, kept)


def test_equals_the_batch_and_lets_go_of_what_is_over(spark, rocksdb):
    from test_episodes import _STEPS, _random_steps

    rows = _random_steps(4)
    tasks = E.tasks_dim(spark).unionByName(spark.createDataFrame([("long", "easy", 1, 20)], E.tasks_dim(spark).schema))
    example = dict(zip([c.split()[0] for c in _STEPS.split(", ")], rows[0], strict=True))
    # more steps than any listed task used to allow; the match is reached at the nineteenth
    for step in range(1, 21):
        row = example | {"episode_id": -1, "task_id": "long", "step": step, "result": "SUCCESS", "schema_match": step / 19, "valid": True}
        rows.append(tuple(row[c.split()[0]] for c in _STEPS.split(", ")))
    source, sink, state = (fresh_path(spark, n) for n in ("k-in", "k-out", "k-state"))

    def run(n_rows):
        stream = spark.readStream.schema(_STEPS).parquet(source)
        query = (
            live_episode_states(stream, tasks, lateness_ms=600_000)
            .writeStream.outputMode("update")
            .option("checkpointLocation", state)
            .trigger(processingTime="2 seconds")
            .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{sink}/batch={n}"))
            .start()
        )
        # timers keep the batches coming, so the rows are waited for, and a batch more for what is due
        until = time.time() + 120
        while time.time() < until:
            progress = query.recentProgress
            if sum(p["numInputRows"] for p in progress) >= n_rows and progress[-1]["numInputRows"] == 0:
                break
            time.sleep(0.5)
        query.stop()

    def give(part):
        spark.createDataFrame(part, _STEPS).coalesce(1).write.mode("append").parquet(source)
        run(len(part))

    # steps from five on come before the third and fourth, and some twice
    give([r for r in rows if r[2] < 3])
    give([r for r in rows if 5 <= r[2] < 12])
    give([r for r in rows if 2 <= r[2] < 6])
    give([r for r in rows if r[2] >= 10])
    fields = ["step", "queries_total", "queries_failed", "cumulative_reward", "schema_match", "done"]
    latest = spark.read.parquet(sink).groupBy("episode_id").agg(F.max_by(F.struct(*fields), "batch").alias("x")).select("episode_id", "x.*")
    got = {r["episode_id"]: r for r in latest.collect()}
    final = {r["episode_id"]: r for r in E.final_states(E.step_rewards(spark.createDataFrame(rows, _STEPS), tasks)).collect()}
    assert set(got) == set(final)
    assert got[-1]["done"] and got[-1]["step"] == 19
    for key, r in final.items():
        assert (got[key]["step"], got[key]["queries_total"], got[key]["queries_failed"], got[key]["done"]) == (
            r["steps"], r["queries_total"], r["queries_failed"], r["done"],
        ), key
        assert abs(got[key]["cumulative_reward"] - r["cumulative_reward"]) < 1e-9
        assert abs(got[key]["schema_match"] - r["schema_match"]) < 1e-9
    held = spark.read.format("statestore").option("stateVarName", "steps").load(state)
    over = {k for k, r in got.items() if r["done"]}
    assert over and not over & {r["key"]["episode_id"] for r in held.select("key").distinct().collect()}
