"""Seed tables by closed formulas over a frame of row numbers 1..n.

The row numbers come from ``spark.range`` or from the key column of a given table, so seeding is
as parallel as its input and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The formulas' constants.
SEED_START = "2025-01-01 00:00:00"
ORDER_USERS = 25
ITEM_ORDERS = 60
EVENT_USERS = 64
EVENTS_PER_BATCH = 500
PRODUCTS = ["book", "pen", "bag", "mouse", "desk", "chair"]
EVENT_TYPES = ["login", "purchase", "logout", "view", "click", "checkout"]


def row_numbers(spark: SparkSession, n: int) -> DataFrame:
    """Numbers 1..n in column ``i``."""
    return spark.range(1, n + 1).withColumnRenamed("id", "i")


def _cycle(values: list[str], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(i - 1, F.lit(len(values))) + 1).cast("int"))


def _start_plus(seconds: Column) -> Column:
    start = F.lit(SEED_START).cast("timestamp_ntz")
    return start + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def gen_users(numbers: DataFrame) -> DataFrame:
    """Users ``user_0001``… created one second apart."""
    i = F.col("i")
    return numbers.select(
        i.alias("id"),
        F.format_string("user_%04d", i).alias("username"),
        _start_plus(i - 1).alias("created_at"),
    )


def gen_orders(numbers: DataFrame) -> DataFrame:
    """Orders spread over the users in turn, with amounts between 10 and 50."""
    i = F.col("i")
    cents = F.lit(1000) + F.pmod(i * 37, F.lit(4000))
    return numbers.select(
        i.alias("id"),
        (F.pmod(i - 1, F.lit(ORDER_USERS)) + 1).alias("user_id"),
        (cents.cast("decimal(12,0)") / 100).cast("decimal(10,2)").alias("amount"),
    )


def gen_order_items(numbers: DataFrame) -> DataFrame:
    """Order items spread over the orders in turn, six products round-robin."""
    i = F.col("i")
    return numbers.select(
        i.alias("id"),
        (F.pmod(i - 1, F.lit(ITEM_ORDERS)) + 1).alias("order_id"),
        F.format_string("%s_%04d", _cycle(PRODUCTS, i), i).alias("product_name"),
    )


def gen_events(numbers: DataFrame) -> DataFrame:
    """Events one minute apart, six types round-robin, with a small JSON payload."""
    i = F.col("i")
    kind = _cycle(EVENT_TYPES, i)
    payload = F.struct(
        F.floor((i - 1) / EVENTS_PER_BATCH).alias("batch"), kind.alias("kind"), i.alias("seq")
    )
    return numbers.select(
        i.alias("id"),
        (F.pmod(i - 1, F.lit(EVENT_USERS)) + 1).alias("user_id"),
        kind.alias("event_type"),
        F.to_json(payload).alias("payload"),
        _start_plus((i - 1) * 60).alias("created_at"),
    )
