from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import integrity as I
from tidemark.sources.tables import table_inventory


def _users(spark, rows):
    return spark.createDataFrame(rows, "id int, username string")


def test_fingerprint_ignores_order_but_sees_every_edit(spark):
    rows = [(i, f"u{i}") for i in range(300)]
    same = I.fingerprint(_users(spark, rows)).first()
    assert I.fingerprint(_users(spark, rows[::-1]).repartition(7)).first() == same
    edited = rows[:299] + [(299, "other")]  # beyond the first 128 rows
    assert I.fingerprint(_users(spark, edited)).first()["digest"] != same["digest"]
    assert I.fingerprint(_users(spark, rows + rows[:1])).first()["rows"] == 301


def test_fingerprint_tells_null_from_text_and_moved_separators(spark):
    schema = "a string, b string"
    frames = [[("x|", "y")], [("x", "|y")], [(None, "y")], [("\\N", "y")], [("", "y")], [("x\\", "|y")], [("x\\p", "y")]]
    digests = {I.fingerprint(spark.createDataFrame(f, schema)).first()["digest"] for f in frames}
    assert len(digests) == len(frames)


def test_digest_sum_is_exact(spark):
    from tidemark.functions.digest import digest_sum

    top = (1 << 60) - 1
    df = spark.range(1000).select(F.lit(top).alias("h"))
    assert df.agg(digest_sum(F.col("h")).alias("d")).first()["d"] == str(top * 1000)
    assert df.filter("false").agg(digest_sum(F.col("h")).alias("d")).first()["d"] == "0"


def test_missing_table_leaves_a_marker(spark):
    rows = I.fingerprint_tables({"users": _users(spark, [(1, "a")])}, {"users": 2, "orders": 3}).collect()
    assert [(r["table_name"], r["rows"]) for r in rows] == [("orders", 0), ("users", 1), ("*", 1)]
    assert rows[0]["digest"] == I.MISSING_TABLE


def test_integrity_verdict(spark):
    a = I.fingerprint_tables({"users": _users(spark, [(1, "a")])}, {"users": 2})
    b = I.fingerprint_tables({"users": _users(spark, [(1, "b")])}, {"users": 2})
    assert {r["data_integrity"] for r in I.integrity(a, a).collect()} == {1.0}
    assert {r["data_integrity"] for r in I.integrity(a, b).collect()} == {0.0}
    assert {r["data_integrity"] for r in I.integrity(a, a, F.lit(True)).collect()} == {0.0}


def test_key_and_null_audits(spark):
    df = _users(spark, [(1, "a"), (1, None), (2, None), (None, "b"), (None, "c")])
    assert {(r["id"], r["copies"]) for r in I.pk_violations(df, ["id"]).collect()} == {(1, 2), (None, 2)}
    assert {(r["column_name"], r["nulls"]) for r in I.null_violations(df, ["id", "username"]).collect()} == {
        ("id", 2),
        ("username", 2),
    }


def test_orphans_with_a_hot_key(spark):
    child = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 10).alias("ref"))
    child = child.unionByName(spark.range(5).select(F.lit(None).cast("long").alias("ref")))
    parent = spark.range(10).withColumnRenamed("id", "key")
    assert [tuple(r) for r in I.fk_orphans(child, "ref", parent, "key").collect()] == [(-1, 3000)]
    audit = I.fk_audit([("f", child, "ref", parent, "key"), ("g", parent, "key", parent, "key")]).collect()
    assert {tuple(r) for r in audit} == {("f", 1, 3000), ("g", 0, 0)}


def test_partition_report_lists_missing_and_foreign_remainders(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 9)], "k long, stored int")
    report = {r["remainder"]: r for r in I.partition_report(df, "k", 2, "stored").collect()}
    assert set(report) == {0, 1, 9}
    assert report[1]["missing"] and report[1]["rows"] == 0
    assert report[9]["misplaced"] == 1
    assert sum(r["rows"] for r in report.values()) == 3


def test_inventory(spark):
    rows = table_inventory({"b": spark.range(3), "a": _users(spark, [(1, "x")])}).collect()
    assert [tuple(r) for r in rows] == [("a", 1, 2), ("b", 3, 1)]


def _expected_diff(a, b):
    """Differences by multiset, one key at a time."""
    out = {}
    for key in {r[0] for r in a} | {r[0] for r in b}:
        old, new = Counter(r for r in a if r[0] == key), Counter(r for r in b if r[0] == key)
        gone, come = old - new, new - old
        if not gone and not come:
            continue
        kind = "added" if not gone else "removed" if not come else "changed"
        cols = []
        for at, name in ((1, "u"), (2, "v")):
            if Counter(r[at] for r in old.elements()) != Counter(r[at] for r in new.elements()):
                cols.append(name)
        # the same values in other rows
        cols = cols or [name for at, name in ((1, "u"), (2, "v")) if len({r[at] for r in gone | come}) > 1]
        out[key] = (kind, sum(come.values()), sum(gone.values()), ",".join(cols) if kind == "changed" else "")
    return out


_ROWS = st.lists(
    st.tuples(
        st.one_of(st.none(), st.integers(0, 3)), st.sampled_from(["a", "b", None, "|"]), st.one_of(st.none(), st.integers(0, 2))
    ),
    max_size=12,
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=_ROWS, b=_ROWS)
def test_row_diff_equals_multiset_difference(spark, a, b):
    schema = "k int, u string, v int"
    got = I.row_diff(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k"]).collect()
    assert {r["k"]: (r["change"], r["rows_added"], r["rows_removed"], r["changed_columns"]) for r in got} == _expected_diff(a, b)
    assert len(got) == len(_expected_diff(a, b))


def test_row_diff_names_columns_whose_cells_changed_rows(spark):
    schema = "k int, u string, v int, w int"
    a = spark.createDataFrame([(1, "a", 1, 7), (1, "b", 2, 7), (2, "a", 1, 7)], schema)
    b = spark.createDataFrame([(1, "a", 2, 7), (1, "b", 1, 7), (2, "a", 1, 8)], schema)
    rows = {tuple(r) for r in I.row_diff(a, b, ["k"]).collect()}
    assert rows == {(1, "changed", 2, 2, "u,v"), (2, "changed", 1, 1, "w")}


def test_row_diff_with_a_hot_key_pairs_nothing(spark):
    # 30000 copies of one key on each side would be 9e8 pairs
    hot = spark.range(30000).select(F.lit(1).alias("k"), (F.col("id") % 100).alias("v"))
    edited = hot.unionByName(spark.createDataFrame([(1, 5), (2, 0)], "k int, v long"))
    rows = {tuple(r) for r in I.row_diff(hot, edited, ["k"]).collect()}
    assert rows == {(1, "added", 1, 0, ""), (2, "added", 1, 0, "")}


def test_reconcile_finds_the_edited_chunk(spark):
    src = spark.range(3000).selectExpr("id", "id * 2 AS v")
    dst = src.filter("id <> 2500").withColumn("v", F.when(F.col("id") == 7, 0).otherwise(F.col("v")))
    got = {r["chunk"]: r["matches"] for r in I.reconcile_chunks(src, dst, "id", 1000, ["id", "v"]).collect()}
    assert got == {0: False, 1: True, 2: False}
