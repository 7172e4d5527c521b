"""Exact deduplication by a stateful stream over an arrivals log.

Texts are equal when they are identical after deleting ASCII white space. Steps:

1. Each row becomes an arrival (digest, length, id, locator), written to the shared folder. The
   locator is the file and the row in it, so a text can be found again without carrying it along.
2. A stream reads the arrivals in micro-batches and keeps, by digest, the best arrival and a count in
   a disk-backed state store (RocksDB) without expiry. Batches are combined before the shuffle, so a
   digest with a third of all rows sends one row a task.
3. The state is read back once, written as a table and joined to the arrivals.
4. Rows of digests met more than once are hits: their texts are fetched by locator and the whole
   bytes are compared with those of the row that stays. The comparison is salted by group size. If
   any differ, the groups of that digest are made anew by the bytes themselves.

Of equal texts the row with the most code points in the original stays, then the smallest id (null
ids last), then the first locator; of repeated rows with the same id exactly one is kept. Null texts
count as empty, and all empty texts are one group. An empty table yields no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.workspace import fresh_path, settle

#: Settings of the stream: state on disk, and closed once a batch is committed. An open store holds some
#: 4 MB of local disk for each partition, however little is in it. What the stores of an executor hold in
#: native memory, beside the heap, is bounded for all of them together.
_STREAM = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
}
#: Bytes of arrivals (some 100 a row) that one micro-batch takes in.
BATCH_BYTES = 4 << 30
#: Members of a group that one task compares with the row that stays.
SPLIT_ROWS = 2000


def normalized(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", "")


def sha256(norm: Column) -> Column:
    return F.sha2(norm, 256)


def _located(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with a locator; input that is not read from files is written first."""
    stored = docs if _from_files(docs) else settle(docs.select("doc_id", "text"), "dedup-input")
    return stored.select("doc_id", "text", "_metadata.file_path", F.col("_metadata.row_index").alias("row_index"))


def _best() -> Column:
    """Sorts the arrival that stays first."""
    return F.struct((-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")


def _arrivals(located: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    return located.select(
        digest(normalized(F.col("text"))).alias("digest"),
        F.char_length(F.coalesce("text", F.lit(""))).alias("chars"),
        "doc_id",
        F.col("file_path").alias("file"),
        F.col("row_index").alias("row"),
    )


def _absorb(spark: SparkSession, arrivals: DataFrame, folder: str, checkpoint: str, batch_bytes: int) -> DataFrame:
    """Stream the arrivals into the state at ``checkpoint`` and read the state, written: one row per digest."""
    before = {key: spark.conf.get(key, None) for key in _STREAM}
    for key, value in _STREAM.items():
        spark.conf.set(key, value)
    try:
        stream = spark.readStream.schema(arrivals.schema).option("maxBytesPerTrigger", batch_bytes).parquet(folder)
        state = stream.groupBy("digest").agg(F.min(_best()).alias("best"), F.count(F.lit(1)).alias("group_size"))
        run = (
            state.writeStream.outputMode("update")
            .format("noop")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()
        kept = spark.read.format("statestore").option("path", checkpoint).load()
        best, count = (f"`{c}`" for c in kept.schema["value"].dataType.names)
        # each read opens the stores of all partitions anew, so it is done once
        return settle(
            kept.select(F.col("key.digest").alias("digest"), F.col(f"value.{best}").alias("best"), F.col(f"value.{count}").alias("group_size")),
            "dedup-groups",
        )
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _mismatched(hits: DataFrame, located: DataFrame) -> DataFrame:
    """Digests of which some member's bytes differ from those of the row that stays."""
    texts = located.select(
        F.col("file_path").alias("file"), F.col("row_index").alias("row"), F.col("text").alias("raw")
    )
    found = texts.join(hits, ["file", "row"]).select("digest", "splits", "is_best", "file", "row", normalized(F.col("raw")).alias("norm"))
    best = found.filter("is_best").select(
        "digest", F.explode(F.sequence(F.lit(0), F.col("splits"))).alias("split"), F.col("norm").alias("best_norm")
    )
    members = found.filter("NOT is_best").withColumn("split", F.pmod(F.xxhash64("file", "row"), F.col("splits") + 1).cast("int"))
    return members.join(best, ["digest", "split"]).filter(F.col("norm") != F.col("best_norm")).select("digest").distinct()


def deduplicate(
    docs: DataFrame,
    digest: Callable[[Column], Column] = sha256,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, digest, and its locator."""
    spark = docs.sparkSession
    folder, checkpoint = fresh_path(spark, "dedup-arrivals"), fresh_path(spark, "dedup-state")
    located = _located(docs)
    arrivals = _arrivals(located, digest)
    arrivals.write.parquet(folder)
    state = _absorb(spark, arrivals, folder, checkpoint, batch_bytes)
    logged = spark.read.schema(arrivals.schema).parquet(folder)
    placed = logged.join(state, "digest").withColumn("is_best", (F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row")))
    columns = ["doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", F.col("is_best").alias("kept"), "digest", "file", "row"]
    splits = F.floor(F.col("group_size") / SPLIT_ROWS).cast("int")
    hits = placed.filter("group_size > 1").select("file", "row", "digest", "is_best", splits.alias("splits"))
    wrong = settle(_mismatched(hits, located), "dedup-mismatched")
    by_digest = placed.join(wrong, "digest", "left_anti").select(*columns)
    return by_digest.unionByName(_by_bytes(placed.join(wrong, "digest", "left_semi"), located))


def _by_bytes(rows: DataFrame, located: DataFrame) -> DataFrame:
    """Groups of rows whose digests collide, made by the bytes: a digest alone decides nothing here."""
    texts = located.select(
        F.col("file_path").alias("file"), F.col("row_index").alias("row"), normalized(F.col("text")).alias("norm")
    )
    full = texts.join(rows.drop("best", "group_size", "is_best"), ["file", "row"])
    groups = full.groupBy("digest", "norm").agg(F.min(_best()).alias("best"), F.count(F.lit(1)).alias("group_size"))
    kept = (F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row"))
    return full.join(groups, ["digest", "norm"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "digest", "file", "row"
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The result of the query: one row per document, dropped ones too."""
    return deduplicate(docs).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents, with their columns, of which no better copy exists."""
    stored = docs if _from_files(docs) else settle(docs, "dedup-documents")
    gone = deduplicate(stored).filter("NOT kept").select(F.col("file").alias("__file"), F.col("row").alias("__row"))
    placed = stored.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    return placed.join(gone, ["__file", "__row"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def _from_files(docs: DataFrame) -> bool:
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return False
    return True
