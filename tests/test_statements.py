import pytest
from pyspark.sql import functions as F

from tidemark.functions.text import child_name, normalize_sql, split_commas, split_quoted
from tidemark.operators import statements as L

CASES = [
    ("ALTER TABLE users ADD COLUMN email VARCHAR(255) DEFAULT NULL;", ("SHARE_UPDATE_EXCLUSIVE", 0, 0.0, False)),
    ("alter table users add column note text", ("ACCESS_EXCLUSIVE", 10, 0.8, False)),
    ("DROP TABLE users;", ("ACCESS_EXCLUSIVE", 20, 1.0, True)),
    ("DROP TABLE IF EXISTS public.events_old CASCADE", ("ACCESS_EXCLUSIVE", 5, 0.25, False)),
    ("DROP TABLE old_events", ("ACCESS_EXCLUSIVE", 20, 1.0, True)),
    ("TRUNCATE users", ("ACCESS_EXCLUSIVE", 20, 1.0, True)),
    ("DELETE FROM users", ("ACCESS_EXCLUSIVE", 20, 1.0, True)),
    ("DELETE FROM users WHERE id = 1", ("UNKNOWN", 1, 0.5, False)),
    ("CREATE INDEX CONCURRENTLY i ON orders (user_id);", ("SHARE_UPDATE_EXCLUSIVE", 0, 0.0, False)),
    ("CREATE UNIQUE INDEX i ON orders (user_id);", ("SHARE", 8, 0.6, False)),
    ("CREATE TABLE t (id INT)", ("ACCESS_EXCLUSIVE", 0, 0.0, False)),
    ("INSERT INTO t VALUES (1)", ("ROW_EXCLUSIVE", 1, 0.02, False)),
    ("INSERT INTO t SELECT * FROM e WHERE id BETWEEN 1 AND 2500;", ("ROW_EXCLUSIVE", 45, 0.15, False)),
    ("INSERT INTO t SELECT * FROM e WHERE id BETWEEN 9 AND 2;", ("ROW_EXCLUSIVE", 15, 0.15, False)),
    ("INSERT INTO t SELECT * FROM e LIMIT 1001", ("ROW_EXCLUSIVE", 30, 0.15, False)),
    ("INSERT INTO t SELECT * FROM e WHERE x = 1", ("ROW_EXCLUSIVE", 15, 0.15, False)),
    ("INSERT INTO t SELECT * FROM e", ("ROW_EXCLUSIVE", 15, 0.6, False)),
    ("ALTER TABLE t ALTER COLUMN a TYPE TEXT", ("ACCESS_EXCLUSIVE", 12, 0.9, False)),
    ("ALTER TABLE users RENAME COLUMN id TO user_id;", ("ACCESS_EXCLUSIVE", 3, 0.25, False)),
    ("ALTER TABLE a RENAME TO b", ("ACCESS_EXCLUSIVE", 1, 0.05, False)),
    ("ALTER TABLE a DROP COLUMN b", ("ACCESS_EXCLUSIVE", 5, 0.4, False)),
    ("ALTER TABLE orders DROP CONSTRAINT fk_orders_users;", ("ACCESS_EXCLUSIVE", 2, 0.2, False)),
    (
        "ALTER TABLE orders ADD CONSTRAINT fk FOREIGN KEY (user_id) REFERENCES users(id);",
        ("SHARE_ROW_EXCLUSIVE", 4, 0.3, False),
    ),
    ("ALTER TABLE orders ENABLE TRIGGER x", ("UNKNOWN", 1, 0.5, False)),
    ("SELECT 1;", ("NONE", 0, 0.0, False)),
    ("SELECT 'a UNION b' FROM t", ("NONE", 0, 0.0, False)),
    ("SELECT * FROM (SELECT 1 UNION SELECT 2) u", ("NONE", 0, 0.0, False)),
    ("SELECT 1 UNION SELECT 2", ("UNKNOWN", 1, 0.5, False)),
    ("WITH x AS (SELECT 1) SELECT * FROM x", ("NONE", 0, 0.0, False)),
    ("UPDATE users SET a = 1", ("UNKNOWN", 1, 0.5, False)),
    ("THIS IS NOT SQL", ("UNKNOWN", 1, 0.5, False)),
    ("", ("UNKNOWN", 1, 0.5, False)),
    ("-- clean up\nDROP TABLE users", ("ACCESS_EXCLUSIVE", 20, 1.0, True)),
    ("/* a; b */ TRUNCATE users", ("ACCESS_EXCLUSIVE", 20, 1.0, True)),
    ("DELETE FROM users -- WHERE id = 1", ("ACCESS_EXCLUSIVE", 20, 1.0, True)),
    ("INSERT INTO t VALUES (1) /* SELECT */", ("ROW_EXCLUSIVE", 1, 0.02, False)),
    ("INSERT INTO t SELECT * FROM e WHERE a BETWEEN x AND y AND b between 1 and 2500", ("ROW_EXCLUSIVE", 45, 0.15, False)),
    ("ALTER TABLE t ADD c INT", ("ACCESS_EXCLUSIVE", 10, 0.8, False)),
    ("ALTER TABLE t ADD c INT DEFAULT 1", ("SHARE_UPDATE_EXCLUSIVE", 0, 0.0, False)),
    ("ALTER TABLE s.t DROP c", ("ACCESS_EXCLUSIVE", 5, 0.4, False)),
    ('ALTER TABLE "t" RENAME a TO b', ("ACCESS_EXCLUSIVE", 3, 0.25, False)),
    ("ALTER TABLE t RENAME CONSTRAINT a TO b", ("UNKNOWN", 1, 0.5, False)),
    ("ALTER TABLE t ADD PRIMARY KEY (id)", ("UNKNOWN", 1, 0.5, False)),
]


def test_lock_rules(spark):
    df = spark.createDataFrame([(at, sql) for at, (sql, _) in enumerate(CASES)], "at int, statement string")
    got = {r["at"]: (r["lock_type"], r["lock_ticks"], r["failure_rate"], r["destroys_data"]) for r in L.classify_locks(df).collect()}
    for at, (sql, expected) in enumerate(CASES):
        assert got[at] == expected, sql


@pytest.mark.parametrize(
    "script, expected",
    [
        ("CREATE TABLE t (id INT); CREATE INDEX CONCURRENTLY i ON t (id)", ("NONE", 0)),
        ("SELECT 1; DROP TABLE users; ALTER TABLE a ALTER COLUMN b TYPE TEXT", ("ACCESS_EXCLUSIVE", 20)),
        ("DROP TABLE users; UPDATE t SET a = 1", ("UNKNOWN", 1)),
        ("UPDATE t SET a = 1; DROP TABLE users", ("UNKNOWN", 1)),
        ("INSERT INTO t VALUES ('; DROP TABLE users')", ("ROW_EXCLUSIVE", 1)),
        ("ALTER TABLE a RENAME COLUMN b TO c; DROP TABLE x_old", ("ACCESS_EXCLUSIVE", 5)),
        ("", ("UNKNOWN", 1)),
        (" ; ; ", ("UNKNOWN", 1)),
        ("-- first; then\nSELECT 1; /* DROP TABLE users; */ SELECT 2", ("NONE", 0)),
        ("SELECT '-- no comment'; DROP TABLE users", ("ACCESS_EXCLUSIVE", 20)),
    ],
)
def test_script_profile(spark, script, expected):
    row = L.script_profile(spark.createDataFrame([(script,)], "sql string")).first()
    assert (row["lock_type"], row["lock_ticks"]) == expected


def test_expand_add_columns(spark):
    sql = "ALTER TABLE t ADD COLUMN a DECIMAL(10,2), ADD COLUMN b INT DEFAULT f(1, g(2, (3))), c TEXT;"
    df = spark.createDataFrame([(sql,), ("SELECT 1;",)], "statement string")
    assert [r["expanded"] for r in L.expand_add_columns(df).orderBy("statement", "part").collect()] == [
        "ALTER TABLE t ADD COLUMN a DECIMAL(10,2)",
        "ALTER TABLE t ADD COLUMN b INT DEFAULT f(1, g(2, (3)))",
        "ALTER TABLE t ADD COLUMN c TEXT",
        "SELECT 1",
    ]


def _top_level(text):
    parts, depth, start = [], 0, 0
    for at, char in enumerate(text):
        depth = depth + 1 if char == "(" else max(0, depth - 1) if char == ")" else depth
        if char == "," and depth == 0:
            parts.append(text[start:at])
            start = at + 1
    return [p.strip() for p in [*parts, text[start:]] if p.strip()]


def test_split_commas_at_any_depth(spark):
    texts = ["a,b", "a(1,2),b", "f((((1,2),3),4),5),g", "a,,b,", "", "((a,b)", "x(y(z(1,2),3),4), w", "a b (c), (d,e) f,g"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", split_commas(F.col("t")).alias("p"))
    for row in df.collect():
        assert row["p"] == _top_level(row["t"]), row["t"]


def test_normalize(spark):
    texts = {
        "```sql\nSELECT 1\n```": "SELECT 1;",
        "  SELECT 1;  ": "SELECT 1;",
        "SELECT a  \n\n\n  FROM t ": "SELECT a\n  FROM t;",
        "": "",
        "``` \n ```": "",
        "```SQL SELECT 2;```": "SELECT 2;",
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", normalize_sql(F.col("t")).alias("n"))
    assert {r["t"]: r["n"] for r in df.collect()} == texts


def test_unsafe(spark):
    texts = {
        "DROP TABLE events_old;": False,
        "drop  table if exists events_old cascade": False,
        "DROP TABLE events_older": True,
        "DROP TABLE events_old; DROP TABLE users": True,
        "SELECT 1": False,
        "": True,
        "truncate t": True,
        "DROP SCHEMA public": True,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["u"] for r in df.select("t", L.flag_unsafe(F.col("t"), ["events_old"]).alias("u")).collect()}
    assert got == texts
    assert df.limit(1).select(L.flag_unsafe(F.lit("DROP TABLE events_old"), []).alias("u")).first()["u"]


def test_quoted_split_and_child_names(spark):
    df = spark.range(1).select(split_quoted(F.lit("a ';' b; c 'x;y' ;; d")).alias("p"))
    assert df.first()["p"] == ["a ';' b", "c 'x;y'", "d"]
    names = {"orders_p7": "p7", "ORDERS_NEW_P12": "p12", "orders": "orders", "orders_p7x": "orders_p7x"}
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", child_name(F.col("n")).alias("c"))
    assert {r["n"]: r["c"] for r in df.collect()} == names


def test_preflight_against_one_schema(spark):
    fks = spark.createDataFrame([("orders", "fk_orders_users", "users", "id")], "table_name string, fk_name string, ref_table string, ref_column string")
    columns = spark.createDataFrame([("orders", "user_id"), ("users", "id")], "table_name string, col_name string")
    stmts = spark.createDataFrame(
        [
            ("ALTER TABLE users RENAME COLUMN id TO user_id;",),
            ("ALTER TABLE orders DROP CONSTRAINT nope",),
            ("ALTER TABLE orders DROP CONSTRAINT IF EXISTS nope",),
            ("ALTER TABLE orders ADD CONSTRAINT fk_orders_users FOREIGN KEY (user_id) REFERENCES users(id)",),
            ("ALTER TABLE orders ADD CONSTRAINT fk2 FOREIGN KEY (buyer) REFERENCES users(id)",),
            ("ALTER TABLE orders ADD CONSTRAINT fk2 FOREIGN KEY (user_id) REFERENCES users(user_id)",),
            ("ALTER TABLE orders ADD CONSTRAINT fk2 FOREIGN KEY (user_id) REFERENCES users(id)",),
        ],
        "statement string",
    )
    renames = L.preflight_rename(stmts, fks).collect()
    assert [(r["old_name"], r["blockers"], r["blocked"]) for r in renames] == [("id", "orders.fk_orders_users", True)]
    problems = {r["statement"]: r["problem"] for r in L.preflight_constraints(stmts, columns, fks).collect()}
    assert list(problems.values()) == [
        "constraint nope does not exist on orders",
        None,
        "constraint fk_orders_users already exists on orders",
        "column orders.buyer does not exist for foreign key",
        "referenced column users.user_id does not exist",
        None,
    ]


def test_preflight_of_qualified_and_quoted_names_and_of_each_clause(spark):
    fks = spark.createDataFrame([("orders", "fk a", "users", "id")], "table_name string, fk_name string, ref_table string, ref_column string")
    columns = spark.createDataFrame([("orders", "user_id"), ("users", "id")], "table_name string, col_name string")
    texts = [
        '-- why; because\nALTER TABLE IF EXISTS public."Users" RENAME "id" TO "user ""id"""',
        'ALTER TABLE ONLY shop.orders DROP CONSTRAINT IF EXISTS "fk a", DROP CONSTRAINT nope;',
        'ALTER TABLE "orders" ADD CONSTRAINT fk2 FOREIGN KEY ( "user_id" ) REFERENCES shop."users" ("id") ON DELETE CASCADE',
        "ALTER TABLE orders ADD CONSTRAINT fk3 FOREIGN KEY (a, b) REFERENCES users (a, b)",
        "ALTER TABLE orders RENAME TO users",
        "SELECT 1",
        "",
        None,
    ]
    stmts = spark.createDataFrame([(t,) for t in texts], "statement string")
    renames = L.preflight_rename(stmts, fks).collect()
    assert [(r["table_name"], r["old_name"], r["new_name"], r["blockers"]) for r in renames] == [("Users", "id", 'user "id"', "orders.fk a")]
    got = sorted(tuple(r)[1:] for r in L.preflight_constraints(stmts, columns, fks).collect())
    assert got == [
        ("ADD", "orders", "fk2", None),
        ("DROP", "orders", "fk a", None),
        ("DROP", "orders", "nope", "constraint nope does not exist on orders"),
    ]
