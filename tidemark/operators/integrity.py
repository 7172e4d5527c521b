"""Proof that a table change lost nothing.

Every operator is a partial aggregate, or a join on keys that were reduced first. No operator
pairs rows within a key, so a key held by a large share of the rows costs no more than others.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.digest import bucket_of, column_text, digest_sum, hash60, row_text
from tidemark.sources.workspace import settle

MISSING_TABLE = "__MISSING__"
HEAD_ROWS = 128


def fingerprint(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Row count and order-insensitive digest over the given columns, in one aggregate."""
    hashed = df.select(hash60(row_text(df, cols)).alias("h"))
    return hashed.agg(F.count(F.lit(1)).alias("rows"), digest_sum(F.col("h")).alias("digest"))


def by_position(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` columns under positional names, so renames do not matter."""
    return df.select(*[F.col(f"`{name}`").alias(f"c{at}") for at, name in enumerate(df.columns[:n])])


def fingerprint_prefix(df: DataFrame, n: int) -> DataFrame:
    """Fingerprint over the first ``n`` columns; appended columns and renames leave it unchanged."""
    return fingerprint(by_position(df, n))


def fingerprint_tables(tables: Mapping[str, DataFrame | None], plan: Mapping[str, int]) -> DataFrame:
    """One fingerprint row per planned table, in name order; a missing table leaves a marker.

    ``plan`` gives the number of starting columns of each table. The last row, named ``*``, is the
    digest of all others, formed from one short row per table.
    """
    parts = []
    for name in sorted(plan):
        df = tables.get(name)
        if df is None:
            some = next(t for t in tables.values() if t is not None)
            row = some.sparkSession.range(1).select(
                F.lit(0).cast("bigint").alias("rows"), F.lit(MISSING_TABLE).alias("digest")
            )
        else:
            row = fingerprint_prefix(df, plan[name])
        parts.append(row.select(F.lit(name).alias("table_name"), "rows", "digest"))
    each = reduce(DataFrame.unionByName, parts)
    line = F.concat_ws(":", "table_name", F.col("rows").cast("string"), "digest")
    whole = each.agg(
        F.lit("*").alias("table_name"),
        F.sum("rows").alias("rows"),
        F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(line))), 256).alias("digest"),
    )
    return each.unionByName(whole)


def integrity(before: DataFrame, after: DataFrame, destroys_data: Column | None = None) -> DataFrame:
    """1.0 per table whose fingerprint is unchanged, else 0.0.

    ``destroys_data`` may refer to ``table_name`` and forces 0.0 where it is true.
    """
    a = before.select("table_name", F.col("rows").alias("rows_before"), F.col("digest").alias("digest_before"))
    b = after.select("table_name", F.col("rows").alias("rows_after"), F.col("digest").alias("digest_after"))
    same = F.col("rows_before").eqNullSafe(F.col("rows_after")) & F.col("digest_before").eqNullSafe(
        F.col("digest_after")
    )
    if destroys_data is not None:
        same = same & ~F.coalesce(destroys_data, F.lit(False))
    return a.join(b, "table_name", "full_outer").withColumn(
        "data_integrity", F.when(same, F.lit(1.0)).otherwise(F.lit(0.0))
    )


def head_rows(df: DataFrame, key: str, n: int = HEAD_ROWS, tiebreak: Sequence[str] = ()) -> DataFrame:
    """The ``n`` rows with the smallest keys (a top-k, never a full sort)."""
    return df.orderBy(key, *tiebreak).limit(n)


def pk_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with how many rows hold them."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def null_violations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Number of NULLs in each column that must not hold any."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{at}") for at, c in enumerate(cols)])
    entries = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"n{at}").alias("nulls")) for at, c in enumerate(cols)]
    )
    return counts.select(F.inline(entries))


def fk_orphans(child: DataFrame, col: str, parent: DataFrame, ref: str) -> DataFrame:
    """Child key values without a parent, and the rows that hold them; NULL keys are exempt.

    The child is reduced to its distinct keys before the join, so a hot key is one row there.
    """
    held = (
        child.filter(F.col(col).isNotNull())
        .groupBy(F.col(col).alias("fk_value"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return held.join(parent.select(F.col(ref).alias("fk_value")), "fk_value", "left_anti")


def fk_audit(references: Sequence[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Orphan keys and orphan rows of each named reference (name, child, col, parent, ref)."""
    parts = [
        fk_orphans(child, col, parent, ref).agg(
            F.lit(name).alias("fk_name"),
            F.count(F.lit(1)).alias("orphan_keys"),
            F.coalesce(F.sum("rows"), F.lit(0)).alias("orphan_rows"),
        )
        for name, child, col, parent, ref in references
    ]
    return reduce(DataFrame.unionByName, parts)


def partition_report(df: DataFrame, col: str, modulus: int, stored: str | None = None) -> DataFrame:
    """Rows per remainder, rows stored under a wrong remainder, and skew against an even spread.

    A remainder without rows is listed with 0. ``stored`` names the column that says where a row
    was put; without it every row counts as well placed. Reducing by (stored, computed) first
    leaves at most ``modulus`` squared rows to shuffle, whatever the spread.
    """
    computed = bucket_of(F.col(col), modulus)
    put = F.col(stored).cast("int") if stored else computed
    counts = df.groupBy(put.alias("remainder"), computed.alias("computed")).agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("remainder").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("remainder").eqNullSafe(F.col("computed")), 0).otherwise(F.col("n"))).alias("misplaced"),
    )
    wanted = df.sparkSession.range(modulus).select(F.col("id").cast("int").alias("remainder"))
    listed = per.join(wanted, "remainder", "full_outer").select(
        "remainder",
        F.coalesce("rows", F.lit(0)).alias("rows"),
        F.coalesce("misplaced", F.lit(0)).alias("misplaced"),
        F.col("rows").isNull().alias("missing"),
    )
    total = F.sum("rows").over(Window.partitionBy())  # over one row per remainder only
    return listed.withColumn("skew", F.when(total > 0, F.col("rows") * modulus / total))


def reconcile_chunks(src: DataFrame, dst: DataFrame, key: str, rows: int, cols: Sequence[str]) -> DataFrame:
    """Count and digest of each key chunk on both sides, and whether they agree."""

    def side(df: DataFrame, name: str) -> DataFrame:
        keyed = df.select(
            F.floor(F.col(key) / F.lit(rows)).cast("bigint").alias("chunk"), hash60(row_text(df, cols)).alias("h")
        )
        return keyed.groupBy("chunk").agg(
            F.count(F.lit(1)).alias(f"rows_{name}"), digest_sum(F.col("h")).alias(f"digest_{name}")
        )

    both = side(src, "src").join(side(dst, "dst"), "chunk", "full_outer")
    return both.withColumn(
        "matches",
        F.col("rows_src").eqNullSafe(F.col("rows_dst")) & F.col("digest_src").eqNullSafe(F.col("digest_dst")),
    )


def row_diff(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose rows differ between ``a`` and ``b``: added, removed or changed, and in which columns.

    First both sides are reduced to (key, row digest) with a signed count, which cancels equal rows
    however often a key or a row is repeated. What is left is written to the shared folder; with
    its size known, it filters a second scan by broadcast when it is small, so full rows are
    shuffled only if much has changed. The cells of those rows are counted with sign as well, so
    no row is ever paired with another. A column is named where its values changed; where every column
    holds the same values as before, in other rows, those that differ between the rows are named.
    """
    cols = [c for c in a.columns if c not in keys]

    def digested(df: DataFrame, sign: int) -> DataFrame:
        text = row_text(df.select(*a.columns))
        return df.select(*a.columns, F.unhex(F.md5(text)).alias("__d"), F.lit(sign).alias("__s"))

    old, new = digested(a, -1), digested(b, 1)
    unequal = settle(
        old.select(*keys, "__d", "__s")
        .unionByName(new.select(*keys, "__d", "__s"))
        .groupBy(*keys, "__d")
        .agg(F.sum("__s").alias("__m"))
        .filter(F.col("__m") != 0),
        "unequal-rows",
    )
    counts = unequal.groupBy(*keys).agg(
        F.sum(F.greatest(F.col("__m"), F.lit(0))).alias("rows_added"),
        F.sum(F.greatest(-F.col("__m"), F.lit(0))).alias("rows_removed"),
    )
    cells = F.array(
        *[F.struct(F.lit(c).alias("col"), column_text(a.schema[c]).alias("val")) for c in cols]
    )
    signed = old.unionByName(new).join(unequal.select("__d"), "__d", "left_semi")  # the digest covers the key
    changed = (
        signed.select(*keys, "__s", F.inline(cells))
        .groupBy(*keys, "col", "val")
        .agg(F.sum("__s").alias("__m"))
        .groupBy(*keys, "col")
        .agg(F.bool_or(F.col("__m") != 0).alias("__changed"), (F.count(F.lit(1)) > 1).alias("__moved"))
        .groupBy(*keys)
        .agg(
            F.array_sort(F.collect_set(F.when(F.col("__changed"), F.col("col")))).alias("cols"),
            F.array_sort(F.collect_set(F.when(F.col("__moved"), F.col("col")))).alias("moved"),
        )
    )
    kind = (
        F.when(F.col("rows_removed") == 0, "added").when(F.col("rows_added") == 0, "removed").otherwise("changed")
    )
    match = reduce(Column.__and__, [F.col(f"n.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys])
    return (
        counts.alias("n")
        .join(changed.alias("c"), match, "left")
        .select(
            *[F.col(f"n.{k}").alias(k) for k in keys],
            kind.alias("change"),
            "rows_added",
            "rows_removed",
            F.when(kind == "changed", F.concat_ws(",", F.when(F.size("cols") > 0, F.col("cols")).otherwise(F.col("moved"))))
            .otherwise("")
            .alias("changed_columns"),
        )
    )
