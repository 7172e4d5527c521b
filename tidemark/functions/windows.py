"""Running values over ordered logs in which one key may hold a large share of the rows.

A plain window over a key sends all rows of that key to one task. Here the order axis is cut into
spans first: rows are shuffled by (key, span), each span is reduced to one row, the few span rows
are scanned in order, and what came before a span is joined back to it. A hot key is so spread
over as many tasks as it has spans, and the result is the same as that of the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SPAN = "__span"
_DEFAULT_SPAN = 65536

# name -> (kind, value, whether the current row counts); kind is "sum" or "max"
Running = Mapping[str, tuple[str, Column, bool]]


def _merge(kind: str, before: Column, here: Column) -> Column:
    if kind == "sum":
        return F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0))
    return F.greatest(before, here)


def _carried(local: DataFrame, offsets: DataFrame, by_span: Sequence[str]) -> DataFrame:
    """Rows with what came before their span; a NULL key is a key like any other."""
    named = offsets.withColumnsRenamed({key: f"__k_{key}" for key in by_span})
    same = [local[key].eqNullSafe(named[f"__k_{key}"]) for key in by_span]
    return local.join(named, same, "left")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Running,
    span: int = _DEFAULT_SPAN,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Add running sums and maxima over ``order`` (a whole number) within ``keys``.

    A maximum over ``struct(order, value)`` gives the latest value seen, so "previous row" and
    "last known value" need no kind of their own. Struct values must hold orderable fields only.
    """
    aggregate = {"sum": F.sum, "max": F.max}
    rows = df.withColumn(_SPAN, F.floor(F.col(order) / F.lit(span)).cast("bigint"))
    by_span = [*keys, _SPAN]

    totals = rows.groupBy(*by_span).agg(
        *[aggregate[kind](value).alias(f"__t_{name}") for name, (kind, value, _) in values.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy(_SPAN).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        totals.select(
            *by_span,
            F.count(F.lit(1)).over(earlier).alias("__n"),
            *[
                aggregate[kind](F.col(f"__t_{name}")).over(earlier).alias(f"__o_{name}")
                for name, (kind, _, _) in values.items()
            ],
        )
        .filter(F.col("__n") > 0)
        .drop("__n")
    )

    ordered = Window.partitionBy(*by_span).orderBy(order, *tiebreak)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select(
        "*",
        *[
            aggregate[kind](value).over(upto if inclusive else before).alias(f"__l_{name}")
            for name, (kind, value, inclusive) in values.items()
        ],
    )
    return _carried(local, offsets, by_span).select(
        *df.columns,
        *[
            _merge(kind, F.col(f"__o_{name}"), F.col(f"__l_{name}")).alias(name)
            for name, (kind, _, _) in values.items()
        ],
    )


def previous_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    item: Column,
    name: str,
    n: int,
    span: int = _DEFAULT_SPAN,
) -> DataFrame:
    """Add the last ``n`` items before each row as an array, oldest first."""
    rows = df.withColumn(_SPAN, F.floor(F.col(order) / F.lit(span)).cast("bigint")).withColumn("__item", item)
    by_span = [*keys, _SPAN]
    backwards = Window.partitionBy(*by_span).orderBy(F.col(order).desc())
    tails = (
        rows.select(*by_span, order, "__item", F.row_number().over(backwards).alias("__back"))
        .filter(F.col("__back") <= n)
        .groupBy(*by_span)
        .agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.col("__item")))).alias("__tail"))
    )
    earlier = Window.partitionBy(*keys).orderBy(_SPAN).rowsBetween(-n, -1)
    offsets = (
        tails.select(*by_span, F.flatten(F.collect_list("__tail").over(earlier)).alias("__carry"))
        .filter(F.size("__carry") > 0)
        .withColumn("__carry", F.transform("__carry", lambda entry: entry["__item"]))
    )
    nearby = Window.partitionBy(*by_span).orderBy(order).rowsBetween(-n, -1)
    local = rows.withColumn("__near", F.collect_list("__item").over(nearby))
    joined = _carried(local, offsets, by_span)
    whole = F.when(F.col("__carry").isNull(), F.col("__near")).otherwise(F.concat("__carry", "__near"))
    recent = F.slice(whole, F.greatest(F.size(whole) - n, F.lit(0)) + 1, F.lit(n))
    return joined.select(*df.columns, recent.alias(name))
