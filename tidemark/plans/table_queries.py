"""Queries over the given tables: sources, migrations and integrity."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import integrity as I
from tidemark.operators import migrate as M
from tidemark.plans.registry import query
from tidemark.sources import seeds
from tidemark.sources.tables import load_table, table_inventory, write_batched
from tidemark.sources.workspace import fresh_path

TABLES = {
    "benchmark": 2,
    "conversations": 4,
    "customer": 5,
    "documents": 5,
    "embeddings": 3,
    "events": 6,
    "labels": 3,
    "lineitem": 11,
    "nation": 3,
    "orders": 6,
    "pages": 3,
    "part": 6,
    "region": 2,
    "supplier": 4,
}

HASH = "cast(('0x' || substr(md5({0}), 1, 15)) AS bigint)"
ORDERS_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, cast(o_orderdate AS varchar) AS o_orderdate, o_orderpriority"


def _hash(text: str) -> str:
    return HASH.format(text)


def _bucket(col: str, m: int) -> str:
    return f"cast({_hash(f'cast({col} AS varchar)')} % {m} AS int)"


def _text(*cols: str) -> str:
    return "concat_ws('|', " + ", ".join(cols) + ")"


def _digest(text: str) -> str:
    return f"cast(coalesce(sum({_hash(text)}::hugeint), 0) AS varchar)"


def _str(col: str) -> str:
    return rf"coalesce(replace(replace({col}, '\', '\\'), '|', '\p'), '\N')"


def _any(col: str) -> str:
    return rf"coalesce(cast({col} AS varchar), '\N')"


def _ts(col: str) -> str:
    return rf"coalesce(strftime({col}, '%Y-%m-%d %H:%M:%S.%f'), '\N')"


ORDERS_TEXT = _text(
    _any("o_orderkey"), _any("o_custkey"), _str("o_orderstatus"), _any("o_totalprice"), _ts("o_orderdate"), _str("o_orderpriority")
)
CUSTOMER_TEXT = _text(_any("c_custkey"), _str("c_name"), _any("c_nationkey"), _any("c_acctbal"), _str("c_mktsegment"))
SUPPLIER_TEXT = _text(_any("s_suppkey"), _str("s_name"), _any("s_nationkey"), _any("s_acctbal"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "orders")


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


# ---------------------------------------------------------------- sources


@query("s1_load_table", "SELECT * FROM customer")
def s1_load_table(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "customer")


@query(
    "s2_table_inventory",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS rows, {n} AS columns FROM {t}" for t, n in TABLES.items()
    ),
)
def s2_table_inventory(spark: SparkSession, d: str) -> DataFrame:
    return table_inventory({t: load_table(spark, d, t) for t in TABLES})


@query(
    "s3_gen_users",
    """SELECT c_custkey + 1 AS id,
       'user_' || CASE WHEN c_custkey + 1 < 10000 THEN lpad(cast(c_custkey + 1 AS varchar), 4, '0') ELSE cast(c_custkey + 1 AS varchar) END AS username,
       cast(TIMESTAMP '2025-01-01 00:00:00' + to_seconds(c_custkey) AS varchar) AS created_at FROM customer""",
)
def s3_gen_users(spark: SparkSession, d: str) -> DataFrame:
    numbers = load_table(spark, d, "customer").select((F.col("c_custkey") + 1).alias("i"))
    return seeds.gen_users(numbers).withColumn("created_at", F.col("created_at").cast("string"))


@query(
    "s4_gen_orders",
    """SELECT o_orderkey + 1 AS id, o_orderkey % 25 + 1 AS user_id,
       10.0::double + (((o_orderkey + 1) * 37) % 4000) / 100.0::double AS amount FROM orders""",
)
def s4_gen_orders(spark: SparkSession, d: str) -> DataFrame:
    numbers = _orders(spark, d).select((F.col("o_orderkey") + 1).alias("i"))
    return seeds.gen_orders(numbers).withColumn("amount", F.col("amount").cast("double"))


@query(
    "s4_gen_order_items",
    """SELECT p_partkey + 1 AS id, p_partkey % 60 + 1 AS order_id,
       (['book','pen','bag','mouse','desk','chair'])[p_partkey % 6 + 1] || '_' ||
       CASE WHEN p_partkey + 1 < 10000 THEN lpad(cast(p_partkey + 1 AS varchar), 4, '0') ELSE cast(p_partkey + 1 AS varchar) END AS product_name
       FROM part""",
)
def s4_gen_order_items(spark: SparkSession, d: str) -> DataFrame:
    return seeds.gen_order_items(load_table(spark, d, "part").select((F.col("p_partkey") + 1).alias("i")))


@query(
    "s5_gen_events",
    """SELECT event_id + 1 AS id, event_id % 64 + 1 AS user_id,
       (['login','purchase','logout','view','click','checkout'])[event_id % 6 + 1] AS event_type,
       '{"batch":' || cast(event_id // 500 AS varchar) || ',"kind":"' ||
       (['login','purchase','logout','view','click','checkout'])[event_id % 6 + 1] || '","seq":' || cast(event_id + 1 AS varchar) || '}' AS payload,
       cast(TIMESTAMP '2025-01-01 00:00:00' + to_minutes(event_id) AS varchar) AS created_at FROM events""",
)
def s5_gen_events(spark: SparkSession, d: str) -> DataFrame:
    numbers = load_table(spark, d, "events").select((F.col("event_id") + 1).alias("i"))
    return seeds.gen_events(numbers).withColumn("created_at", F.col("created_at").cast("string"))


@query("s10_write_batched", "SELECT count(*) AS rows, true AS within_limit FROM orders")
def s10_write_batched(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "batched")
    write_batched(_orders(spark, d), path, 500)
    per_file = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n"))
    return per_file.agg(F.sum("n").alias("rows"), (F.max("n") <= 500).alias("within_limit"))


# ---------------------------------------------------------------- migrations


@query("m1_add_columns", f"SELECT {ORDERS_COLS}, CAST(NULL AS varchar) AS email, true AS is_active FROM orders")
def m1_add_columns(spark: SparkSession, d: str) -> DataFrame:
    return _shown(M.add_columns(_orders(spark, d), [("email", "string", None), ("is_active", "boolean", True)]))


@query(
    "m2_rename_column",
    "SELECT o_orderkey, o_custkey AS customer_id, o_orderstatus, o_totalprice, cast(o_orderdate AS varchar) AS o_orderdate, o_orderpriority FROM orders",
)
def m2_rename_column(spark: SparkSession, d: str) -> DataFrame:
    return _shown(M.rename_column(_orders(spark, d), "o_custkey", "customer_id"))


@query("m3_drop_columns", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
def m3_drop_columns(spark: SparkSession, d: str) -> DataFrame:
    return M.drop_columns(_orders(spark, d), ["o_totalprice", "o_orderdate"])


_REF_TEXT = "CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority ELSE cast(o_custkey AS string) END"


@query("m4_retype_column", f"SELECT o_orderkey, try_cast({_REF_TEXT} AS int) AS ref FROM orders")
def m4_retype_column(spark: SparkSession, d: str) -> DataFrame:
    texts = _orders(spark, d).select("o_orderkey", F.expr(_REF_TEXT).alias("ref"))
    return M.retype_column(texts, "ref", "int")


@query(
    "m4_retype_report",
    """SELECT count(l_quantity) AS "values", cast(0 AS bigint) AS lost, count(*) FILTER (l_discount <> trunc(l_discount)) AS altered FROM lineitem""",
)
def m4_retype_report(spark: SparkSession, d: str) -> DataFrame:
    return M.retype_report(load_table(spark, d, "lineitem"), "l_discount", "int")


@query("m5_create_like", f"SELECT {ORDERS_COLS} FROM orders")
def m5_create_like(spark: SparkSession, d: str) -> DataFrame:
    orders = _orders(spark, d)
    empty = M.create_like(M.create_like(orders))
    return _shown(empty.unionByName(orders))


@query(
    "m6_plan_chunks",
    "SELECT cast(floor(o_orderkey / 1000) AS bigint) AS chunk, min(o_orderkey) AS lo, max(o_orderkey) AS hi, count(*) AS rows FROM orders GROUP BY 1",
)
def m6_plan_chunks(spark: SparkSession, d: str) -> DataFrame:
    return M.plan_chunks(_orders(spark, d), "o_orderkey", 1000)


@query(
    "m7_copy_range",
    """SELECT l_orderkey AS order_id, l_partkey AS part_id, l_extendedprice AS price, CAST(NULL AS varchar) AS note
       FROM lineitem WHERE l_extendedprice BETWEEN 1000 AND 50000""",
)
def m7_copy_range(spark: SparkSession, d: str) -> DataFrame:
    items = load_table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    layout = spark.createDataFrame([], "order_id long, part_id long, price double, note string")
    return M.copy_range(items, "l_extendedprice", 1000, 50000, layout)


@query("m7_copy_prefix", f"SELECT {ORDERS_COLS} FROM orders ORDER BY o_orderkey LIMIT 1000")
def m7_copy_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _shown(M.copy_prefix(_orders(spark, d), "o_orderkey", 1000))


@query("m7_copy_all", f"SELECT {ORDERS_COLS}, CAST(NULL AS varchar) AS note FROM orders")
def m7_copy_all(spark: SparkSession, d: str) -> DataFrame:
    orders = _orders(spark, d)
    return _shown(M.copy_all(orders, M.create_like(M.add_columns(orders, [("note", "string", None)]))))


@query("m8_hash_repartition", f"SELECT {ORDERS_COLS}, {_bucket('o_custkey', 8)} AS bucket FROM orders")
def m8_hash_repartition(spark: SparkSession, d: str) -> DataFrame:
    return _shown(M.hash_repartition(_orders(spark, d), "o_custkey", 8))


@query("m9_publish_swap", f"SELECT {ORDERS_COLS}, {_bucket('o_custkey', 4)} AS bucket FROM orders")
def m9_publish_swap(spark: SparkSession, d: str) -> DataFrame:
    table = f"{M.staging_database(spark)}.orders_{uuid.uuid4().hex[:12]}"
    orders = _orders(spark, d)
    orders.write.format("parquet").saveAsTable(table)
    return _shown(M.publish_swap(spark.table(table), table, "o_custkey", 4))


@query("m10_delete_where", f"SELECT {ORDERS_COLS} FROM orders WHERE NOT coalesce(o_orderstatus = 'F', false)")
def m10_delete_where(spark: SparkSession, d: str) -> DataFrame:
    return _shown(M.delete_where(_orders(spark, d), F.col("o_orderstatus") == "F"))


_AUTO_ORDERS = f"{ORDERS_TEXT} || '|true'"


@query(
    "m11_apply_migration",
    f"""SELECT 'transaction' AS mode, 'orders' AS table_name, 6 AS columns, count(*) AS rows, {_digest(ORDERS_TEXT)} AS digest FROM orders
    UNION ALL SELECT 'transaction', 'customer', 5, count(*), {_digest(CUSTOMER_TEXT)} FROM customer
    UNION ALL SELECT 'autocommit', 'orders', 7, count(*), {_digest(_AUTO_ORDERS)} FROM orders
    UNION ALL SELECT 'autocommit', 'customer', 5, count(*), {_digest(CUSTOMER_TEXT)} FROM customer""",
)
def m11_apply_migration(spark: SparkSession, d: str) -> DataFrame:
    tables = {"orders": _orders(spark, d), "customer": load_table(spark, d, "customer")}
    steps = [
        M.Step("add column", "orders", lambda t: M.add_columns(t, [("is_active", "boolean", True)])),
        M.Step("rename column", "customer", lambda t: M.rename_column(t, "c_name", "name")),
        M.Step("add column again", "orders", lambda t: M.add_columns(t, [("is_active", "boolean", False)])),
        M.Step("drop column", "customer", lambda t: M.drop_columns(t, ["c_acctbal"])),
    ]
    rows = []
    for mode in ("transaction", "autocommit"):
        after, _ = M.apply_migration(tables, steps, mode)
        for name, table in after.items():
            facts = [F.lit(mode).alias("mode"), F.lit(name).alias("table_name"), F.lit(len(table.columns)).alias("columns")]
            rows.append(I.fingerprint(table).select(*facts, "rows", "digest"))
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query(
    "m12_repair_fk",
    """SELECT o_custkey AS fk_value, count(*) AS rows FROM orders
       WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0)
       GROUP BY 1""",
)
def m12_repair_fk(spark: SparkSession, d: str) -> DataFrame:
    tables = {"orders": _orders(spark, d), "customer": load_table(spark, d, "customer").filter("c_acctbal >= 0")}
    fk = M.ForeignKey("fk_orders_customer", "orders", "o_custkey", "customer", "c_custkey")
    _, _, orphans = M.repair_fk(tables, [fk], "fk_orders_customer", "customer_id")
    return orphans


# ---------------------------------------------------------------- integrity


@query("i1_fingerprint", f"SELECT count(*) AS rows, {_digest(ORDERS_TEXT)} AS digest FROM orders")
def i1_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return I.fingerprint(_orders(spark, d))


@query("i2_fingerprint_prefix", f"SELECT count(*) AS rows, {_digest(ORDERS_TEXT)} AS digest FROM orders")
def i2_fingerprint_prefix(spark: SparkSession, d: str) -> DataFrame:
    wider = M.add_columns(_orders(spark, d), [("email", "string", None), ("is_active", "boolean", True)])
    return I.fingerprint_prefix(M.rename_column(wider, "o_custkey", "customer_id"), 6)


_EACH = f"""SELECT 'archive' AS table_name, cast(0 AS bigint) AS rows, '__MISSING__' AS digest
    UNION ALL SELECT 'customer', count(*), {_digest(CUSTOMER_TEXT)} FROM customer
    UNION ALL SELECT 'orders', count(*), {_digest(ORDERS_TEXT)} FROM orders
    UNION ALL SELECT 'supplier', count(*), {_digest(SUPPLIER_TEXT)} FROM supplier"""


@query(
    "i3_fingerprint_tables",
    f"""WITH e AS ({_EACH}) SELECT * FROM e UNION ALL
    SELECT '*', cast(sum(rows) AS bigint), sha256(string_agg(table_name || ':' || cast(rows AS varchar) || ':' || digest, chr(10) ORDER BY table_name)) FROM e""",
)
def i3_fingerprint_tables(spark: SparkSession, d: str) -> DataFrame:
    tables = {name: load_table(spark, d, name) for name in ("customer", "orders", "supplier")}
    return I.fingerprint_tables(tables, {"customer": 5, "orders": 6, "supplier": 4, "archive": 2})


_EDITED_PRICE = "CASE WHEN o_orderkey % 500 = 3 THEN o_totalprice + 1 ELSE o_totalprice END"


@query(
    "i4_integrity",
    f"""WITH b AS (SELECT 'customer' AS t, count(*) AS n, {_digest(CUSTOMER_TEXT)} AS h FROM customer
      UNION ALL SELECT 'orders', count(*), {_digest(ORDERS_TEXT)} FROM orders
      UNION ALL SELECT 'supplier', count(*), {_digest(SUPPLIER_TEXT)} FROM supplier),
    a AS (SELECT 'customer' AS t, count(*) AS n, {_digest(CUSTOMER_TEXT)} AS h FROM customer
      UNION ALL SELECT 'orders', count(*), {_digest(ORDERS_TEXT)} FROM (SELECT * REPLACE ({_EDITED_PRICE} AS o_totalprice) FROM orders)
      UNION ALL SELECT 'supplier', count(*), {_digest(SUPPLIER_TEXT)} FROM supplier)
    SELECT t AS table_name, b.n AS rows_before, b.h AS digest_before, a.n AS rows_after, a.h AS digest_after,
      CASE WHEN b.n = a.n AND b.h = a.h AND t <> 'supplier' THEN 1.0::double ELSE 0.0::double END AS data_integrity FROM b JOIN a USING (t)""",
)
def i4_integrity(spark: SparkSession, d: str) -> DataFrame:
    def facts(tables: dict[str, DataFrame]) -> DataFrame:
        plan = {name: len(df.columns) for name, df in tables.items()}
        return I.fingerprint_tables(tables, plan).filter(F.col("table_name") != "*")

    before = {name: load_table(spark, d, name) for name in ("customer", "orders", "supplier")}
    after = {**before, "orders": before["orders"].withColumn("o_totalprice", F.expr(_EDITED_PRICE))}
    return I.integrity(facts(before), facts(after), F.col("table_name") == "supplier")


@query("i5_head_rows", f"SELECT {ORDERS_COLS} FROM orders ORDER BY o_orderkey LIMIT 128")
def i5_head_rows(spark: SparkSession, d: str) -> DataFrame:
    return _shown(I.head_rows(_orders(spark, d), "o_orderkey"))


@query(
    "i6_pk_violations",
    "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def i6_pk_violations(spark: SparkSession, d: str) -> DataFrame:
    return I.pk_violations(load_table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "i6_null_violations",
    """SELECT 'event_id' AS column_name, count(*) FILTER (event_id IS NULL) AS nulls FROM events
       UNION ALL SELECT 'event_type', count(*) FILTER (nullif(event_type, 'error') IS NULL) FROM events
       UNION ALL SELECT 'value', count(*) FILTER ((CASE WHEN value >= 10 THEN value END) IS NULL) FROM events""",
)
def i6_null_violations(spark: SparkSession, d: str) -> DataFrame:
    events = load_table(spark, d, "events").selectExpr(
        "event_id", "nullif(event_type, 'error') AS event_type", "CASE WHEN value >= 10 THEN value END AS value"
    )
    return I.null_violations(events, ["event_id", "event_type", "value"])


@query(
    "i7_fk_orphans",
    """SELECT l_suppkey AS fk_value, count(*) AS rows FROM lineitem
       WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal >= 0) GROUP BY 1""",
)
def i7_fk_orphans(spark: SparkSession, d: str) -> DataFrame:
    suppliers = load_table(spark, d, "supplier").filter("s_acctbal >= 0")
    return I.fk_orphans(load_table(spark, d, "lineitem"), "l_suppkey", suppliers, "s_suppkey")


@query(
    "i7_fk_audit",
    """SELECT 'lineitem_orders' AS fk_name, count(DISTINCT l_orderkey) AS orphan_keys, count(*) AS orphan_rows FROM lineitem
         WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')
       UNION ALL SELECT 'lineitem_part', count(DISTINCT l_partkey), count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
       UNION ALL SELECT 'orders_customer', count(DISTINCT o_custkey), count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)""",
)
def i7_fk_audit(spark: SparkSession, d: str) -> DataFrame:
    items, orders = load_table(spark, d, "lineitem"), _orders(spark, d)
    return I.fk_audit(
        [
            ("lineitem_orders", items, "l_orderkey", orders.filter("o_orderstatus <> 'F'"), "o_orderkey"),
            ("lineitem_part", items, "l_partkey", load_table(spark, d, "part"), "p_partkey"),
            ("orders_customer", orders, "o_custkey", load_table(spark, d, "customer").filter("c_acctbal >= 0"), "c_custkey"),
        ]
    )


_STORED = f"CASE WHEN o_orderkey % 50 = 0 THEN 0 WHEN {_bucket('o_custkey', 16)} = 5 THEN 6 ELSE {_bucket('o_custkey', 16)} END"


@query(
    "i8_partition_report",
    f"""WITH s AS (SELECT {_STORED} AS r, {_bucket('o_custkey', 16)} AS c FROM orders),
    g AS (SELECT r, count(*) AS n, count(*) FILTER (r <> c) AS bad FROM s GROUP BY 1)
    SELECT cast(i AS int) AS remainder, coalesce(n, 0) AS rows, coalesce(bad, 0) AS misplaced, n IS NULL AS missing,
      coalesce(n, 0) * 16 / (SELECT count(*) FROM s)::double AS skew FROM range(16) t(i) LEFT JOIN g ON r = i""",
)
def i8_partition_report(spark: SparkSession, d: str) -> DataFrame:
    bucketed = M.bucket_of(F.col("o_custkey"), 16)
    stored = F.when(F.col("o_orderkey") % 50 == 0, 0).when(bucketed == 5, 6).otherwise(bucketed)
    return I.partition_report(_orders(spark, d).withColumn("stored", stored), "o_custkey", 16, "stored")


@query(
    "i9_reconcile_chunks",
    f"""WITH s AS (SELECT o_orderkey // 1000 AS chunk, count(*) AS n, {_digest(ORDERS_TEXT)} AS h FROM orders GROUP BY 1),
    t AS (SELECT o_orderkey // 1000 AS chunk, count(*) AS n, {_digest(ORDERS_TEXT)} AS h
          FROM (SELECT * REPLACE ({_EDITED_PRICE} AS o_totalprice) FROM orders WHERE o_orderkey % 3000 <> 7) GROUP BY 1)
    SELECT chunk, s.n AS rows_src, s.h AS digest_src, t.n AS rows_dst, t.h AS digest_dst,
      s.n IS NOT DISTINCT FROM t.n AND s.h IS NOT DISTINCT FROM t.h AS matches FROM s FULL JOIN t USING (chunk)""",
)
def i9_reconcile_chunks(spark: SparkSession, d: str) -> DataFrame:
    orders = _orders(spark, d)
    copy = orders.filter("o_orderkey % 3000 <> 7").withColumn("o_totalprice", F.expr(_EDITED_PRICE))
    return I.reconcile_chunks(orders, copy, "o_orderkey", 1000, orders.columns)


@query(
    "i10_row_diff",
    f"""WITH n AS (SELECT o_orderkey AS k, o_custkey AS c, {_EDITED_PRICE} AS p,
        CASE WHEN o_orderkey % 1000 = 3 THEN 'X' ELSE o_orderstatus END AS s, o_orderdate AS dt, o_orderpriority AS pr
        FROM orders WHERE o_orderkey % 777 <> 5
        UNION ALL SELECT -1 - o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 900 = 1),
    j AS (SELECT coalesce(o.o_orderkey, n.k) AS key, o.o_orderkey IS NULL AS added, n.k IS NULL AS removed,
        concat_ws(',', CASE WHEN o_custkey IS DISTINCT FROM c THEN 'o_custkey' END, CASE WHEN o_orderdate IS DISTINCT FROM dt THEN 'o_orderdate' END,
          CASE WHEN o_orderpriority IS DISTINCT FROM pr THEN 'o_orderpriority' END, CASE WHEN o_orderstatus IS DISTINCT FROM s THEN 'o_orderstatus' END,
          CASE WHEN o_totalprice IS DISTINCT FROM p THEN 'o_totalprice' END) AS cols
        FROM orders o FULL JOIN n ON o.o_orderkey = n.k)
    SELECT key AS o_orderkey, CASE WHEN added THEN 'added' WHEN removed THEN 'removed' ELSE 'changed' END AS change,
      CASE WHEN removed THEN 0::bigint ELSE 1::bigint END AS rows_added, CASE WHEN added THEN 0::bigint ELSE 1::bigint END AS rows_removed,
      CASE WHEN added OR removed THEN '' ELSE cols END AS changed_columns FROM j WHERE added OR removed OR cols <> ''""",
)
def i10_row_diff(spark: SparkSession, d: str) -> DataFrame:
    orders = _orders(spark, d)
    edited = (
        orders.filter("o_orderkey % 777 <> 5")
        .withColumn("o_totalprice", F.expr(_EDITED_PRICE))
        .withColumn("o_orderstatus", F.expr("CASE WHEN o_orderkey % 1000 = 3 THEN 'X' ELSE o_orderstatus END"))
    )
    extra = orders.filter("o_orderkey % 900 = 1").withColumn("o_orderkey", F.lit(-1) - F.col("o_orderkey"))
    return I.row_diff(orders, edited.unionByName(extra), ["o_orderkey"])
