import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scores
from tidemark.operators import availability as A
from tidemark.operators import episodes as E

_STEPS = (
    "episode_id long, task_id string, step int, result string, schema_match double, queries_total long, "
    "queries_failed long, data_integrity double, valid boolean"
)
_LIMITS = {"easy_add_column": 5, "medium_rename_fk": 6, "hard_repartition": 8}


def _random_steps(seed=3):
    rng, rows = random.Random(seed), []
    for episode in range(60):
        task = rng.choice(list(_LIMITS))
        rows.append((episode, task, 0, "RESET", rng.choice([0.5, 1.0]), 0, 0, 1.0, True))
        for step in range(1, rng.randint(1, 15)):
            result = rng.choice(["SUCCESS", "SUCCESS", "error"])
            match = rng.choice([0.4, 0.6, 0.8, 0.9, 1.0])
            total = rng.choice([0, 30, 60])
            rows.append((episode, task, step, result, match, total, rng.randint(0, total), rng.choice([1.0, 1.0, 0.0]), rng.random() > 0.2))
    return rows


def _fold(rows):
    """The rules step by step, for each episode on its own."""
    out = {}
    for episode in {r[0] for r in rows}:
        match = total = failed = reward = 0
        done = False
        for _, task, step, result, new, queries, lost, kept, valid in sorted(r for r in rows if r[0] == episode):
            if done:
                out[episode, step] = ("EPISODE_DONE", 0.0, reward, total, failed, match, True, True)
                continue
            gain = 0.0
            if step == 0:
                match = new
            elif not valid:
                gain = -0.05
                done = step >= _LIMITS[task]
            else:
                gain = max(0.0, new - match) * (1 - (lost / queries if queries else 0)) * kept - (0 if result == "SUCCESS" else 0.05)
                match, total, failed = new, total + queries, failed + lost
                done = step >= _LIMITS[task] or new >= 1 - 1e-9
            reward += gain
            out[episode, step] = (result, gain, reward, total, failed, match, done, False)
    return out


def test_step_rewards_equal_a_fold(spark):
    rows = _random_steps()
    got = E.step_rewards(spark.createDataFrame(rows, _STEPS).repartition(4), E.tasks_dim(spark)).collect()
    expected = _fold(rows)
    assert len(got) == len(rows)
    for r in got:
        want = expected[r["episode_id"], r["step"]]
        have = (r["result"], r["reward"], r["cumulative_reward"], r["total_to_date"], r["failed_to_date"], r["match_to_date"], r["done"], r["masked"])
        assert have[0] == want[0] and have[3:5] == want[3:5] and have[6:] == want[6:], (r, want)
        assert have[1:3] == pytest.approx(want[1:3], abs=1e-12) and have[5] == pytest.approx(want[5])


def test_mark_done_agrees_with_rewards(spark):
    steps = spark.createDataFrame(_random_steps(9), _STEPS)
    marked = {(r["episode_id"], r["step"]): (r["done"], r["masked"]) for r in E.mark_done(steps, E.tasks_dim(spark)).collect()}
    rewarded = {(r["episode_id"], r["step"]): (r["done"], r["masked"]) for r in E.step_rewards(steps, E.tasks_dim(spark)).collect()}
    assert marked == rewarded


def test_endless_episode_is_spread(spark):
    # one episode with far more rows than its task allows
    steps = spark.range(200_000).selectExpr(
        "1L AS episode_id", "'easy_add_column' AS task_id", "cast(id + 1 AS int) AS step", "'SUCCESS' AS result",
        "0.5D AS schema_match", "30L AS queries_total", "3L AS queries_failed", "1.0D AS data_integrity",
    )
    got = E.step_rewards(steps, E.tasks_dim(spark))
    assert got.agg(F.count("*"), F.count_if("masked"), F.max("total_to_date"), F.min("total_to_date")).first()[:] == (
        200_000, 199_995, 150, 30,
    )
    assert got.filter("masked").agg(F.min("total_to_date"), F.max("reward")).first()[:] == (150, 0.0)


def test_scores_and_labels(spark):
    df = spark.createDataFrame(
        [(1, 1.0, 1.0, 1.0), (2, 1.0, 1.0, 0.5), (3, 0.5, 1.0, 1.0), (4, 1.0, 0.0, 1.0), (5, 1.0, 1.0, 0.9)],
        "id int, schema_match double, data_integrity double, availability double",
    )
    got = {r["id"]: (r["score"], r["feedback"]) for r in E.episode_scores(df).collect()}
    assert got == {
        1: (0.998, scores.PASS_PERFECT),
        2: (0.5, scores.PARTIAL_AVAILABILITY),
        3: (0.5, scores.PARTIAL_SCHEMA),
        4: (0.001, scores.FAIL_INTEGRITY),
        5: (0.9, scores.PASS_PERFECT),
    }
    labels = df.select(scores.direct_feedback(F.lit(0.1)).alias("a"), scores.direct_feedback(F.lit(0.5)).alias("b")).first()
    assert tuple(labels) == (scores.DIRECT_LOW, scores.DIRECT_MID)


def test_coerced_inputs(spark):
    full = '"current_schema_ddl":null,"target_schema_ddl":"b","data_hash_before":"h","data_hash_after":"h"'
    cases = [
        ("{%s,\"availability_pct\":0.5}" % full, 0.5, True),
        ("{%s,\"availability_pct\":\" 0.25 \"}" % full, 0.25, True),
        ("{%s,\"availability_pct\":-3}" % full, 0.0, True),
        ("{%s,\"availability_pct\":\"x\"}" % full, 0.0, True),
        ("{%s,\"availability_pct\":null}" % full, 0.0, True),
        ("{%s}" % full, 0.0, False),
        ("not json", 0.0, False),
    ]
    df = spark.createDataFrame([(at, c[0], 1.0) for at, c in enumerate(cases)], "at int, payload string, schema_match double")
    graded = {r["at"]: r for r in E.grade_inputs(E.coerce_inputs(df)).collect()}
    for at, (_, served, complete) in enumerate(cases):
        assert (graded[at]["availability_pct"], graded[at]["complete"]) == (served, complete), cases[at]
        assert graded[at]["current_schema_ddl"] == ""
        assert graded[at]["score"] == max(0.001, min(0.998, served if complete else 0.0))


def test_latest_and_resolved(spark):
    resets = spark.createDataFrame(
        [("easy_add_column", "a", 1, 0.4, "x"), ("easy_add_column", "b", 2, 0.7, "y"), ("hard_repartition", "c", 1, 0.2, "z")],
        "task_id string, episode_id string, reset_ts int, score double, feedback string",
    )
    current = E.latest_episode(resets, carry=["score", "feedback"])
    requests = spark.createDataFrame(
        [(1, "easy_add_column", None), (2, "easy_add_column", "a"), (3, "easy_add_column", "b"), (4, "medium_rename_fk", ""), (5, "hard_repartition", "")],
        "request_id int, task_id string, episode_id string",
    )
    got = {r["request_id"]: (r["score"], r["feedback"]) for r in E.resolve_grades(requests, current).collect()}
    assert got == {
        1: (0.7, "y"),
        2: (0.001, E.OTHER_EPISODE),
        3: (0.7, "y"),
        4: (0.001, E.NO_EPISODE),
        5: (0.2, "z"),
    }


def test_next_by_schema_of_an_empty_snapshot(spark):
    columns = spark.createDataFrame(
        [(1, "easy_add_column", "Email", "text", False)], "snapshot_id int, task_id string, col_name string, col_type string, is_primary boolean"
    )
    fks = spark.createDataFrame([], "snapshot_id int, task_id string, fk_name string, ref_table string, ref_column string")
    snapshots = spark.createDataFrame(
        [(1, "easy_add_column"), (2, "easy_add_column"), (3, "medium_rename_fk"), (4, "other")], "snapshot_id int, task_id string"
    )
    got = {r["snapshot_id"]: r["next_sql"] for r in E.next_by_schema(columns, fks, snapshots).collect()}
    assert got == {1: E.ADD_ACTIVE, 2: E.ADD_EMAIL, 3: E.RENAME_USERS_ID, 4: E.NO_OP_SQL}
    assert [r["snapshot_id"] for r in E.next_by_schema(columns, fks).collect()] == [1]


def test_next_pending(spark):
    plan = E.playbook(spark, "hard_repartition", E.SWAP_PLAYBOOK)
    log = [(1, s, "SUCCESS") for s in E.SWAP_PLAYBOOK[:3]] + [(1, E.SWAP_PLAYBOOK[3], "error")]
    log += [(2, s.rstrip(";"), "SUCCESS") for s in E.SWAP_PLAYBOOK] + [(3, "SELECT 1;", "SUCCESS")]
    history = spark.createDataFrame([(e, "hard_repartition", s, r) for e, s, r in log], "episode_id int, task_id string, sql string, result string")
    got = {r["episode_id"]: r["next_sql"] for r in E.next_pending(plan, history).collect()}
    assert got == {1: E.SWAP_PLAYBOOK[3], 2: "SELECT 1;", 3: E.SWAP_PLAYBOOK[0]}


def test_availability_measures(spark):
    workload = spark.createDataFrame(
        [(1, 1, True), (1, 1, False), (1, 2, False), (2, 1, None)], "episode_id int, step int, failed boolean"
    )
    steps = A.downtime_by_step(workload)
    assert {(r["episode_id"], r["step"], r["downtime_pct"]) for r in steps.collect()} == {(1, 1, 0.5), (1, 2, 0.0), (2, 1, 0.0)}
    assert {r["episode_id"]: r["availability"] for r in A.availability(steps).collect()} == {1: pytest.approx(2 / 3), 2: 1.0}
    last = A.cumulative_downtime(steps).filter("episode_id = 1 AND step = 2").first()
    assert last["cumulative_downtime_pct"] == pytest.approx(1 / 3)


def test_lock_windows_are_half_open(spark):
    workload = spark.createDataFrame(
        [("a", f"2025-01-01 00:00:{s:02d}", s % 2 == 0) for s in (0, 10, 10, 20, 30)] + [("b", "2025-01-01 00:00:15", True)],
        "shard string, ts string, failed boolean",
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    locks = spark.createDataFrame(
        [(1, "a", "2025-01-01 00:00:10", "2025-01-01 00:00:30"), (2, "a", "2025-01-01 00:00:05", "2025-01-01 00:00:10"), (3, "c", "2025-01-01 00:00:00", "2025-01-01 01:00:00")],
        "lock_id int, shard string, start_ts string, end_ts string",
    ).withColumns({c: F.col(c).cast("timestamp") for c in ("start_ts", "end_ts")})
    for span in (1_000_000, 3600_000_000):
        got = {r["lock_id"]: (r["in_total"], r["in_failed"], r["out_total"]) for r in A.lock_impact(workload, locks, span_micros=span).collect()}
        assert got == {1: (3, 3, 2), 2: (0, 0, 5), 3: (0, 0, 0)}


def test_lock_windows_without_a_shard_meet_nothing(spark):
    workload = spark.createDataFrame([(None, "2025-01-01 00:00:10", True), ("a", "2025-01-01 00:00:10", True)], "shard string, ts string, failed boolean")
    workload = workload.withColumn("ts", F.col("ts").cast("timestamp"))
    locks = spark.createDataFrame([(1, None), (2, "a")], "lock_id int, shard string").selectExpr(
        "lock_id", "shard", "timestamp '2025-01-01 00:00:00' AS start_ts", "timestamp '2025-01-01 00:01:00' AS end_ts"
    )
    got = {r["lock_id"]: (r["in_total"], r["out_total"]) for r in A.lock_impact(workload, locks).collect()}
    assert got == {1: (0, 0), 2: (1, 0)}
