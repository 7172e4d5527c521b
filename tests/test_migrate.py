import pytest
from pyspark.sql import functions as F

from tidemark.operators import migrate as M
from tidemark.operators.integrity import fingerprint, fingerprint_prefix, partition_report
from tidemark.sources.tables import read_bucketed
from tidemark.sources.workspace import fresh_path


@pytest.fixture()
def users(spark):
    return spark.createDataFrame([(i, f"user_{i:04d}") for i in range(1, 201)], "id int, username string")


def test_add_columns_fills_defaults_and_keeps_data(users):
    wider = M.add_columns(users, [("email", "string", None), ("is_active", "boolean", True)])
    assert wider.columns == ["id", "username", "email", "is_active"]
    assert wider.filter("is_active AND email IS NULL").count() == 200
    assert fingerprint_prefix(wider, 2).first() == fingerprint_prefix(users, 2).first()


def test_add_columns_refuses_existing_names(users):
    with pytest.raises(M.MigrationError):
        M.add_columns(users, [("Username", "string", "")])
    with pytest.raises(M.MigrationError):
        M.add_columns(users, [("a", "int", 1), ("A", "int", 2)])


def test_rename_is_refused_while_referenced(users):
    fk = M.ForeignKey("fk_orders_users", "orders", "user_id", "users", "id")
    with pytest.raises(M.MigrationError, match="orders.fk_orders_users"):
        M.rename_column(users, "id", "user_id", "users", [fk])
    assert M.rename_column(users, "id", "user_id", "users").columns == ["user_id", "username"]


def test_drop_needs_a_remaining_column(users):
    assert M.drop_columns(users, ["id"]).columns == ["username"]
    with pytest.raises(M.MigrationError):
        M.drop_columns(users, ["id", "username"])
    with pytest.raises(M.MigrationError):
        M.drop_columns(users, ["nope"])


def test_retype_reports_what_is_lost(spark):
    df = spark.createDataFrame([("1",), ("2.5",), ("x",), (None,), ("007",)], "v string")
    assert [r["v"] for r in M.retype_column(df, "v", "int").collect()] == [1, None, None, None, 7]
    report = M.retype_report(df, "v", "int").first()
    assert report.asDict() == {"values": 4, "lost": 2, "altered": 1}  # 007 reads back as 7


def test_like_of_like(users):
    empty = M.create_like(M.create_like(users))
    assert empty.schema == users.schema
    assert empty.count() == 0


def test_chunks_cover_the_range_and_resume(spark):
    df = spark.range(5, 2500).withColumnRenamed("id", "k")
    chunks = {r["chunk"]: r for r in M.plan_chunks(df, "k", 1000).collect()}
    assert {c: (r["lo"], r["hi"], r["rows"]) for c, r in chunks.items()} == {
        0: (5, 999, 995),
        1: (1000, 1999, 1000),
        2: (2000, 2499, 500),
    }
    copies = [M.copy_range(df, "k", r["lo"], r["hi"]) for r in chunks.values()]
    whole = copies[0].unionByName(copies[1]).unionByName(copies[2])
    assert fingerprint(whole).first() == fingerprint(df).first()


def test_copy_into_wider_layout(users):
    layout = M.create_like(M.add_columns(users, [("note", "string", None)]))
    assert M.copy_prefix(users, "id", 3, layout).orderBy("id").collect()[-1].asDict() == {
        "id": 3,
        "username": "user_0003",
        "note": None,
    }
    with pytest.raises(M.MigrationError):
        M.copy_all(layout, users)


def test_hash_repartition_spreads_a_hot_key(spark):
    # one key holds most rows; with two buckets a shuffle by bucket alone would use two tasks
    hot = spark.range(20000).select(F.when(F.col("id") % 10 < 9, F.lit(7)).otherwise(F.col("id")).alias("k"), "id")
    moved = M.hash_repartition(hot, "k", 2, spread=8)
    sizes = [r["n"] for r in moved.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 20000 * 0.45
    assert moved.filter("k = 7").select("bucket").distinct().count() == 1
    assert fingerprint(moved, ["k", "id"]).first() == fingerprint(hot, ["k", "id"]).first()


def test_bucket_folders_are_pruned(spark):
    path = fresh_path(spark, "buckets")
    orders = spark.range(1000).selectExpr("id", "id % 50 AS user_id")
    M.write_buckets(M.hash_repartition(orders, "user_id", 4), path)
    one = read_bucketed(spark, path, "user_id", 13, 4, "bucket")
    assert one.count() == 20
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    report = partition_report(spark.read.parquet(path), "user_id", 4, "bucket").collect()
    assert sum(r["rows"] for r in report) == 1000
    assert all(r["misplaced"] == 0 for r in report)


def test_delete_where_keeps_unknown_and_needs_a_condition(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "v int")
    assert M.delete_where(df, F.col("v") == 1).count() == 2
    with pytest.raises(M.MigrationError):
        M.delete_where(df, None)


def test_transaction_and_autocommit(users):
    steps = [
        M.Step("add", "users", lambda t: M.add_columns(t, [("email", "string", None)])),
        M.Step("bad", "users", lambda t: t.select("no_such_column")),
        M.Step("drop", "users", lambda t: M.drop_columns(t, ["username"])),
    ]
    after, statuses = M.apply_migration({"users": users}, steps)
    assert after["users"].columns == users.columns
    assert [s.result for s in statuses][::2] == ["SUCCESS", "SKIPPED"]
    after, _ = M.apply_migration({"users": users}, steps, "autocommit")
    assert after["users"].columns == ["id", "username", "email"]
    after, _ = M.apply_migration({"users": users}, steps[:1], "transaction")
    assert after["users"].columns == ["id", "username", "email"]
    _, statuses = M.apply_migration({}, steps[:1])
    assert "does not exist" in statuses[0].result


def test_repair_fk(spark, users):
    orders = spark.createDataFrame([(1, 5), (2, 999), (3, None)], "id int, user_id int")
    fk = M.ForeignKey("fk_orders_users", "orders", "user_id", "users", "id")
    after, fks, orphans = M.repair_fk({"users": users, "orders": orders}, [fk], "fk_orders_users", "user_id")
    assert after["users"].columns == ["user_id", "username"]
    assert fks == [M.ForeignKey("fk_orders_users", "orders", "user_id", "users", "user_id")]
    assert [tuple(r) for r in orphans.collect()] == [(999, 1)]
    with pytest.raises(M.MigrationError):
        M.repair_fk({"users": users}, [], "fk_orders_users", "user_id")


def test_publish_swap_replaces_the_live_table(spark):
    table = f"{M.staging_database(spark)}.swap_{fresh_path(spark, 'x')[-12:]}"
    events = spark.range(256).selectExpr("id", "id % 64 AS user_id")
    events.write.format("parquet").saveAsTable(table)
    published = M.publish_swap(spark.table(table), table, "user_id", 2)
    assert published.columns == ["id", "user_id", "bucket"]
    assert fingerprint(published, ["id", "user_id"]).first() == fingerprint(events).first()
    assert not spark.catalog.tableExists(f"{table}_old")
    assert not spark.catalog.tableExists(f"{table}_new")


def test_copies_of_one_row_are_spread(spark):
    same = spark.range(0, 16000, 1, 16).selectExpr("7 AS k", "'x' AS v")
    moved = M.hash_repartition(same, "k", 2, spread=8)
    sizes = [r["n"] for r in moved.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 16000 * 0.5
    assert sum(sizes) == 16000
