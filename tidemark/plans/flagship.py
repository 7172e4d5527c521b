"""The whole of a safe move in one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.integrity import fingerprint_prefix, integrity
from tidemark.operators.migrate import add_columns, hash_repartition
from tidemark.sources.tables import load_table


def migrate_and_prove(spark: SparkSession, directory: str, modulus: int = 8) -> DataFrame:
    """Add two defaulted columns to orders, repartition by customer, compare before and after."""
    orders = load_table(spark, directory, "orders")
    wider = add_columns(orders, [("email", "string", None), ("is_active", "boolean", True)])
    moved = hash_repartition(wider, "o_custkey", modulus)

    def facts(df: DataFrame) -> DataFrame:
        return fingerprint_prefix(df, len(orders.columns)).withColumn("table_name", F.lit("orders"))

    return integrity(facts(orders), facts(moved))
