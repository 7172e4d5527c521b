"""Reading, listing and writing tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.digest import bucket_of


def load_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Scan one Parquet table."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def spread_scan(df: DataFrame, key: str) -> DataFrame:
    """Give heavy work on each row all cores, when the scan has fewer splits than that.

    Such a table is smaller than a split for each core, so the shuffle is small whatever the
    cluster. A larger table is returned as it is: its scan is parallel by the size of its splits.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def table_inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Name, number of rows and number of columns of each table.

    The counts come from Parquet footers and partial aggregates: no column is read.
    """
    rows = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table_name"), "rows", F.lit(len(df.columns)).alias("columns")
        )
        for name, df in sorted(tables.items())
    ]
    return reduce(DataFrame.unionByName, rows)


def write_batched(df: DataFrame, path: str, max_rows: int, mode: str = "errorifexists") -> None:
    """Write Parquet files of at most ``max_rows`` rows each, without a shuffle."""
    df.write.mode(mode).option("maxRecordsPerFile", max_rows).parquet(path)


_BROADCAST_BYTES = 32 << 20


def is_small(*frames: DataFrame, max_bytes: int = _BROADCAST_BYTES) -> bool:
    """Whether the frames' content is measured to be at most ``max_bytes`` in all.

    The measure is one job of partial aggregates; nothing is collected but the sum.
    """
    sizes = [
        df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).cast("bigint").alias("bytes"))
        for df in frames
    ]
    total = reduce(DataFrame.unionByName, sizes).agg(F.sum("bytes").alias("bytes")).first()["bytes"]
    return total <= max_bytes


def broadcast_if_small(df: DataFrame, max_bytes: int = _BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast when its content is measured to be at most ``max_bytes``.

    Beyond the limit the frame is returned unmarked, and the join runs as a shuffle join that
    adaptive execution may split on skew.
    """
    return F.broadcast(df) if is_small(df, max_bytes=max_bytes) else df


def read_bucketed(spark: SparkSession, path: str, key: str, value: object, modulus: int, bucket: str) -> DataFrame:
    """Rows of one key from a table stored by hash bucket; only that bucket's folder is read."""
    number: Column = bucket_of(F.lit(value), modulus)
    at = spark.range(1).select(number.alias("n")).first()["n"]
    return spark.read.parquet(path).filter((F.col(bucket) == at) & (F.col(key) == F.lit(value)))
