"""A bounded sample of labelled documents, for models and rules that learn from ``labels``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that anything is fitted on. Everything else covers all rows.
SAMPLE_ROWS = 20_000


def sample(labels: DataFrame, column: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` pairs (doc_id, label), the same ones whatever the order of the table.

    Rows without an id or label are left out; an id with several labels counts with the smallest.
    """
    known = labels.select("doc_id", F.col(column).cast("int").alias("label")).dropna()
    single = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    return single.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def labelled(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """Documents of the sample with their label. The sample is bounded, so it may be broadcast."""
    return docs.join(F.broadcast(picked.withColumnRenamed("label", "__label")), "doc_id")
