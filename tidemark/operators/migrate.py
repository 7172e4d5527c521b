"""Changes to the layout of tables.

A change is a function from DataFrame to DataFrame; nothing is read or copied until a result is
written. Guard errors are raised while the change is composed, before any data moves.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.digest import bucket_of
from tidemark.operators.integrity import fingerprint, fk_orphans, partition_report
from tidemark.sources.workspace import fresh_path, shared_dir

BUCKET = "bucket"
# Message of a refused rename (table, column, referencing constraints).
RENAME_BLOCKED = "foreign key constraint still references %s(%s); drop referencing constraint(s) first: %s"


class MigrationError(ValueError):
    """A change that must not be applied."""


@dataclass(frozen=True)
class ForeignKey:
    """A named reference from one column to another."""

    name: str
    table: str
    column: str
    ref_table: str
    ref_column: str


def _same(left: str, right: str) -> bool:
    return left.lower() == right.lower()


def _find(df: DataFrame, name: str) -> str | None:
    return next((c for c in df.columns if _same(c, name)), None)


def _require(df: DataFrame, name: str) -> str:
    found = _find(df, name)
    if found is None:
        raise MigrationError(f"column {name} does not exist")
    return found


def add_columns(df: DataFrame, new: Sequence[tuple[str, str, object]]) -> DataFrame:
    """Append columns given as (name, type, default); existing rows get the default."""
    names = [c.lower() for c in df.columns]
    for name, _, _ in new:
        if name.lower() in names:
            raise MigrationError(f"column {name} already exists")
        names.append(name.lower())
    return df.select("*", *[F.lit(default).cast(kind).alias(name) for name, kind, default in new])


def rename_column(
    df: DataFrame, old: str, new: str, table: str = "", fks: Sequence[ForeignKey] = ()
) -> DataFrame:
    """Rename a column in place; refused while a foreign key references it."""
    found = _require(df, old)
    blockers = [fk for fk in fks if _same(fk.ref_table, table) and _same(fk.ref_column, old)]
    if blockers:
        names = ", ".join(f"{fk.table}.{fk.name}" for fk in blockers)
        raise MigrationError(RENAME_BLOCKED % (table, old, names))
    if not _same(old, new) and _find(df, new) is not None:
        raise MigrationError(f"column {new} already exists")
    return df.withColumnRenamed(found, new)


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Remove columns; at least one column must remain."""
    gone = {_require(df, c) for c in cols}
    kept = [c for c in df.columns if c not in gone]
    if not kept:
        raise MigrationError("a table needs at least one column")
    return df.select(*[f"`{c}`" for c in kept])


def retype_column(df: DataFrame, col: str, kind: str) -> DataFrame:
    """Cast a column; values that do not survive the cast become NULL (see ``retype_report``)."""
    found = _require(df, col)
    return df.withColumn(found, F.col(f"`{found}`").try_cast(kind))


def retype_report(df: DataFrame, col: str, kind: str) -> DataFrame:
    """Values, values lost by the cast, and values that read differently when cast back."""
    value = F.col(f"`{_require(df, col)}`")
    cast = value.try_cast(kind)
    back = cast.try_cast(df.schema[_require(df, col)].dataType.simpleString())
    return df.agg(
        F.count(value).alias("values"),
        F.count_if(value.isNotNull() & cast.isNull()).alias("lost"),
        F.count_if(cast.isNotNull() & ~value.eqNullSafe(back)).alias("altered"),
    )


def create_like(df: DataFrame) -> DataFrame:
    """An empty table with the same columns. A copy of a copy has the first table's columns."""
    return df.filter(F.lit(False))


def plan_chunks(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Key ranges of at most ``rows`` unique keys each: (chunk, lo, hi, rows).

    Chunks lie on a fixed grid of the key axis. A chunk keeps its number and bounds when rows are
    added elsewhere, so a backfill may be planned again and resumed, and no minimum is needed.
    """
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(F.floor(F.col(key) / F.lit(rows)).cast("bigint").alias("chunk"))
        .agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("rows"))
    )


def _into_layout(df: DataFrame, layout: DataFrame | None) -> DataFrame:
    """Columns by position under the layout's names and types; extra layout columns are NULL."""
    if layout is None:
        return df
    if len(df.columns) > len(layout.columns):
        raise MigrationError("the new layout has fewer columns than the copied rows")
    fields = layout.schema.fields
    filled = [F.col(f"`{c}`").cast(f.dataType).alias(f.name) for c, f in zip(df.columns, fields)]
    return df.select(*filled, *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields[len(df.columns) :]])


def copy_range(df: DataFrame, key: str, lo: object, hi: object, layout: DataFrame | None = None) -> DataFrame:
    """Rows with lo <= key <= hi in the new layout; the range is pushed down to the scan."""
    return _into_layout(df.filter(F.col(key).between(F.lit(lo), F.lit(hi))), layout)


def copy_prefix(df: DataFrame, key: str, n: int, layout: DataFrame | None = None) -> DataFrame:
    """The ``n`` rows with the smallest keys in the new layout, as ``ORDER BY key LIMIT n``.

    Meant for small ``n``. Larger copies go by the ranges of ``plan_chunks`` and ``copy_range``.
    """
    return _into_layout(df.orderBy(key).limit(n), layout)


def copy_all(df: DataFrame, layout: DataFrame | None = None) -> DataFrame:
    """All rows in the new layout."""
    return _into_layout(df, layout)


def hash_repartition(df: DataFrame, col: str, modulus: int, spread: int | None = None) -> DataFrame:
    """Add the hash bucket of ``col`` and shuffle rows by it, ready for ``write_buckets``.

    With few buckets, or one hot key, a shuffle by bucket alone would give most rows to a few
    tasks. Each bucket is therefore split into ``spread`` parts by a hash of the row and of the
    input partition it comes from, so that even copies of one row are spread. Neither changes when
    a task is run again, so a lost executor cannot alter the result.
    """
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = spread or max(1, -(-wanted // modulus))
    salt = F.pmod(F.xxhash64(*[f"`{c}`" for c in df.columns], F.spark_partition_id()), F.lit(parts))
    salted = df.withColumns({BUCKET: bucket_of(F.col(f"`{_require(df, col)}`"), modulus), "__salt": salt})
    return salted.repartition(modulus * parts, BUCKET, "__salt").drop("__salt")


def write_buckets(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store one folder per bucket, so that a filter on the bucket reads that folder only."""
    df.write.mode(mode).partitionBy(BUCKET).parquet(path)


def delete_where(df: DataFrame, cond: Column | None) -> DataFrame:
    """Rows for which the condition is not true. A delete without a condition is refused."""
    if cond is None:
        raise MigrationError("refusing to delete all rows: no condition given")
    return df.filter(~F.coalesce(cond, F.lit(False)))


def repair_fk(
    tables: Mapping[str, DataFrame], fks: Sequence[ForeignKey], name: str, new_ref: str
) -> tuple[dict[str, DataFrame], list[ForeignKey], DataFrame]:
    """Drop a foreign key, rename the referenced key, and add the foreign key again.

    Returns the tables, the foreign keys, and the orphans found by the new reference (none if it
    is valid). The orphan frame is lazy: whoever commits the change checks it.
    """
    fk = next((f for f in fks if _same(f.name, name)), None)
    if fk is None:
        raise MigrationError(f"constraint {name} does not exist")
    rest = [f for f in fks if f is not fk]
    renamed = rename_column(tables[fk.ref_table], fk.ref_column, new_ref, fk.ref_table, rest)
    after = {**tables, fk.ref_table: renamed}
    repaired = ForeignKey(fk.name, fk.table, fk.column, fk.ref_table, new_ref)
    orphans = fk_orphans(after[fk.table], fk.column, renamed, new_ref)
    return after, [*rest, repaired], orphans


@dataclass(frozen=True)
class Step:
    """One change of one table: ``change`` maps the old table to the new one."""

    label: str
    table: str
    change: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class StepStatus:
    """Outcome of one step: SUCCESS, an error text, or SKIPPED after an earlier error."""

    position: int
    label: str
    result: str


def apply_migration(
    tables: Mapping[str, DataFrame], steps: Sequence[Step], mode: str = "transaction"
) -> tuple[dict[str, DataFrame], list[StepStatus]]:
    """Apply steps in order; stop at the first error.

    In ``transaction`` mode an error leaves all tables as they were; in ``autocommit`` mode the
    steps before the error stay applied. An unknown mode counts as ``transaction``.
    """
    current, statuses, failed = dict(tables), [], False
    for position, step in enumerate(steps, start=1):
        if failed:
            statuses.append(StepStatus(position, step.label, "SKIPPED"))
            continue
        try:
            if step.table not in current:
                raise MigrationError(f"relation {step.table} does not exist")
            current[step.table] = step.change(current[step.table])
            statuses.append(StepStatus(position, step.label, "SUCCESS"))
        except (MigrationError, AnalysisException) as error:
            failed = True
            statuses.append(StepStatus(position, step.label, str(error)))
    if failed and mode != "autocommit":
        current = dict(tables)
    return current, statuses


def staging_database(spark: SparkSession) -> str:
    """A database whose tables live below the shared folder."""
    name = "tidemark_" + uuid.uuid5(uuid.NAMESPACE_URL, shared_dir(spark)).hex[:12]
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{shared_dir(spark)}/{name}'")
    return name


def publish_swap(source: DataFrame, table: str, key: str, modulus: int, keep_old: bool = False) -> DataFrame:
    """Stage a bucketed copy, verify it, and put it in the place of ``table``; clean up last.

    The staged table must hold the same rows as ``source`` and no row in a wrong bucket, or it is
    dropped and the live table stays untouched. It is stored in a folder of its own below the
    shared folder, so the swap is two catalog renames that move no file. Between them the name is
    briefly unbound: plain Parquet tables offer no atomic exchange. The published table is counted
    before the old one is dropped; if it falls short, the renames are undone.
    """
    spark = source.sparkSession
    staged, old = f"{table}_new", f"{table}_old"
    written = hash_repartition(source, key, modulus).write.partitionBy(BUCKET).format("parquet")
    written.option("path", fresh_path(spark, "published")).saveAsTable(staged)
    copied = spark.table(staged)
    expected = fingerprint(source).first()
    same = fingerprint(copied, source.columns).first() == expected
    placed = partition_report(copied, key, modulus, stored=BUCKET).agg(F.sum("misplaced").alias("n")).first()["n"]
    if not same or placed:
        spark.sql(f"DROP TABLE {staged}")
        raise MigrationError(f"copy of {table} failed verification")
    live = spark.catalog.tableExists(table)
    if live:
        spark.sql(f"ALTER TABLE {table} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {staged} RENAME TO {table}")
    if spark.table(table).count() != expected["rows"]:
        spark.sql(f"ALTER TABLE {table} RENAME TO {staged}")
        if live:
            spark.sql(f"ALTER TABLE {old} RENAME TO {table}")
        raise MigrationError(f"published copy of {table} is not whole")
    if live and not keep_old:
        spark.sql(f"DROP TABLE {old}")
    return spark.table(table)
