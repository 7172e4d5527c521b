"""Benchmark decontamination by winnowing: fingerprints of k-grams, joined and extended.

Of each window of ten consecutive words the smallest hash of its six grams of five words is kept, the
leftmost one among equals. The choice depends on the ten words alone, so a span of ten words that a text
and an item share has the same fingerprint in both: none is missed. Fingerprints of the texts are joined
with those of the items, and each hit is extended word by word to both sides; runs of ten or more equal
words are hit. A fingerprint brings the words around it that its own windows can reach (five on each
side), so hits are extended in the joined row and no text is read again. Words are compared, not hashes.

An item of one to nine words is one window as a whole: its words are looked up as one gram of that length.

At scale: texts are worked on where they are read; what leaves a task is one row per text and the runs
that were hit. The index of items is written first, so its size is known: Spark broadcasts it below
``spark.sql.autoBroadcastJoinThreshold`` and shuffles by fingerprint beyond, where adaptive execution splits
frequent ones. Equal contexts of one item are one index entry, so a repeated word does not multiply.

Edge cases: null and texts without words have no words and are never hit; an item without words has no
window; items with the same ``item_id`` count as one, a null id as the empty string; repeated rows of
documents each get their (equal) row; with an empty table on either side nothing is hit. Only ``doc_id``,
``item_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textstats import let
from tidemark.sources.workspace import settle

#: Consecutive words that count as copied, and words of a gram.
SPAN, GRAM = 10, 5
#: Grams in a span, and words that a span can reach beyond one of its grams.
GRAMS, REACH = SPAN - GRAM + 1, SPAN - GRAM

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# the built-in may know capitals of a later Unicode than the pattern does, to which they are unassigned
_OTHER_CAPITALS = r"[\p{javaUpperCase}\p{javaTitleCase}\p{Cn}&&[^A-Z]]"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_INT = "array<int>"


def lowered(text: Column) -> Column:
    """``text`` with A-Z as a-z and all else as it is.

    The fast built-in lowers all letters, so it serves texts without other capitals.
    """
    plain = (F.octet_length(text) == F.char_length(text)) | ~text.rlike(_OTHER_CAPITALS)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def words(text: Column) -> Column:
    """Runs of digits, letters of ASCII (lower-cased) and all beyond ASCII; null has none."""
    return F.array_remove(F.split(lowered(F.coalesce(text.cast("string"), F.lit(""))), _BETWEEN), "")


def _grams(split: Column) -> Column:
    """One 64-bit hash for each run of five words."""
    n = F.size(split) - (GRAM - 1)
    shifted = [F.slice(split, F.lit(k + 1), n) for k in range(GRAM)]
    return F.transform(F.arrays_zip(*shifted), lambda w: F.xxhash64(w))


def _picked(grams: Column) -> Column:
    """(hash, place) of the fingerprints: the leftmost smallest gram of each window, each place once."""
    starts = F.slice(grams, F.lit(1), F.size(grams) - (GRAMS - 1))
    lowest = F.transform(starts, lambda g, i: F.least(g, *[F.get(grams, i + k) for k in range(1, GRAMS)]))

    def place(low: Column, i: Column) -> Column:
        """Where the window at ``i`` has its choice, if the window before had another."""
        leftmost = reduce(
            lambda chain, k: chain.when(F.get(grams, i + k) == low, i + k), range(1, GRAMS), F.when(F.get(grams, i) == low, i)
        )
        return lambda lows: F.when(
            (i == 0) | (low != F.get(lows, i - 1)) | (F.get(grams, i - 1) == F.get(lows, i - 1)),
            F.struct(low.alias("h"), leftmost.cast("int").alias("p"), F.lit(GRAM).alias("n")),
        )

    return let(lowest, lambda lows: F.array_compact(F.transform(lows, lambda low, i: place(low, i)(lows))))


def _none() -> Column:
    return F.array().cast("array<struct<h:bigint,p:int,n:int>>")


def _fingerprints(split: Column) -> Column:
    return F.when(F.size(split) < SPAN, _none()).otherwise(let(_grams(split), _picked))


def _whole(split: Column, n: Column) -> Column:
    """(hash, place) of all runs of ``n`` words (fewer than ten), hashed with their number."""
    starts = F.when(F.size(split) >= n, F.slice(split, F.lit(1), F.size(split) - n + 1)).otherwise(F.array().cast("array<string>"))
    run = lambda i: F.xxhash64(F.slice(split, i + 1, n), n)
    return F.transform(starts, lambda w, i: F.struct(run(i).alias("h"), i.cast("int").alias("p"), (-n).cast("int").alias("n")))


def _around(split: Column, f: Column) -> dict[str, Column]:
    """The words that the windows of a fingerprint can reach, and how many of them stand before it."""
    before = F.when(f.n > 0, F.least(f.p, F.lit(REACH))).otherwise(F.lit(0))
    length = F.when(f.n > 0, before + GRAM + REACH).otherwise(-f.n)
    return {"before": before, "around": F.slice(split, F.greatest(f.p - before + 1, F.lit(1)), length)}


def index_of(items: DataFrame) -> DataFrame:
    """item, size, h, before, around: the fingerprints of the items with the words around them."""
    split = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w"))
    long, short = F.size("w") >= SPAN, F.size("w") > 0
    prints = F.when(long, _fingerprints(F.col("w"))).when(short, _whole(F.col("w"), F.size("w"))).otherwise(_none())
    each = split.withColumn("prints", prints).withColumn("f", F.explode_outer("prints"))
    around = _around(F.col("w"), F.col("f"))
    return each.select(
        "item", F.col("f.n").alias("n"), F.col("f.h").alias("h"), around["before"].alias("before"), around["around"].alias("around")
    ).distinct()


def _span(met: Column) -> Column:
    """Start and end of the run of equal words around two equal fingerprints; null if it is too short."""

    def agree(k: int) -> Column:
        here, there = F.get(met.around, met.before + k), F.get(met.item_around, met.item_before + k)
        return F.coalesce(here == there, F.lit(False))

    def reach(places: list[int]) -> Column:
        """How many of the words at ``places`` agree before the first that does not."""
        differ = [F.when(~agree(k), at) for at, k in enumerate(places)]
        return F.coalesce(*differ, F.lit(len(places)))

    left, right = reach([-k for k in range(1, REACH + 1)]), reach([GRAM - 1 + k for k in range(1, REACH + 1)])
    same = reduce(Column.__and__, [agree(k) for k in range(GRAM)])
    span = lambda start, end: F.struct(start.alias("start"), end.alias("end"))
    whole = F.when(met.around == met.item_around, span(met.p, met.p - met.n))
    grown = lambda r: F.when(same & (r.l + r.r >= REACH), span(met.p - r.l, met.p + GRAM + r.r))
    return F.when(met.n < 0, whole).otherwise(let(F.struct(left.alias("l"), right.alias("r")), grown))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, spans (array of start, end of hit words), items (sorted)."""
    index = settle(index_of(items), "winnowing-items")
    # lengths of the items that are shorter than a window: nine numbers at most
    shorter = sorted(-row["n"] for row in index.filter("n < 0").select("n").distinct().collect())
    split = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("digest"),
        words(F.col("text")).alias("w"),
    )
    # the first entry stands for the document itself and meets nothing
    itself = F.array(F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(-1).alias("p"), F.lit(0).alias("n")))
    prints = F.concat(itself, _fingerprints(F.col("w")), *[_whole(F.col("w"), F.lit(n)) for n in shorter])
    # a column of its own, so that exploding stays in generated code and copies no words; outer, since a plain
    # explode has Spark work the whole column out once more to pass empty arrays over
    each = split.withColumn("prints", prints).withColumn("f", F.explode_outer("prints"))
    around = _around(F.col("w"), F.col("f"))
    each = each.select(
        "doc_id",
        "digest",
        F.size("w").cast("bigint").alias("n_words"),
        F.col("f.h").alias("h"),
        F.col("f.p").alias("p"),
        around["before"].alias("before"),
        around["around"].alias("around"),
    )
    theirs = index.select("h", "item", "n", F.col("before").alias("item_before"), F.col("around").alias("item_around"))
    met = each.join(theirs, "h", "left").filter((F.col("p") == -1) | F.col("item").isNotNull())
    # inside a lambda, so that the join above it stays in generated code; few rows get here
    pair = F.struct("p", "n", "before", "around", "item_before", "item_around")
    span = F.when(F.col("item").isNotNull(), let(pair, _span))
    found = met.select("doc_id", "digest", "n_words", (F.col("p") == -1).alias("itself"), "item", span.alias("span"))
    per_text = (
        found.groupBy("doc_id", "digest", "n_words")
        .agg(
            F.sum(F.col("itself").cast("int")).alias("copies"),
            F.sort_array(F.collect_set("span")).alias("spans"),
            F.sort_array(F.collect_set(F.when(F.col("span").isNotNull(), F.col("item")))).alias("items"),
        )
    )
    return per_text.select(
        "doc_id", "n_words", _merged(F.col("spans")).alias("spans"), "items", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    ).drop("copy")


def _merged(spans: Column) -> Column:
    """Sorted spans as the fewest that cover the same words."""
    kind = "array<struct<start:int,end:int>>"

    def step(state: Column, s: Column) -> Column:
        joins = s.start <= state.end
        return F.struct(
            F.when(joins, state.done).otherwise(F.concat(state.done, F.array(F.struct(state.start.alias("start"), state.end.alias("end"))))).alias("done"),
            F.when(joins, state.start).otherwise(s.start).alias("start"),
            F.when(joins, F.greatest(state.end, s.end)).otherwise(s.end).alias("end"),
        )

    first = F.get(spans, F.lit(0))
    zero = F.struct(F.array().cast(kind).alias("done"), first.start.alias("start"), first.end.alias("end"))
    whole = F.aggregate(spans, zero, step, lambda s: F.concat(s.done, F.array(F.struct(s.start.alias("start"), s.end.alias("end")))))
    return F.when(F.size(spans) == 0, F.array().cast(kind)).otherwise(whole)


def digests(hits: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of the rows of ``contaminated``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s.end - s.start)
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def oracle() -> str:
    """The same by comparing all runs of words, which serves to check, not to scale."""
    split = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH texts AS (SELECT doc_id, {split} AS w FROM documents),
items AS (SELECT item_id, {split} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, w[i:i + least(10, len(w)) - 1] AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT len(win) AS n FROM windows),
runs AS (
  SELECT doc_id, i, n, w[i:i + n - 1] AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM texts, lengths WHERE len(w) >= n)),
found AS (SELECT doc_id, i, n, item_id FROM runs JOIN windows USING (win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
met AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN hit USING (doc_id) LEFT JOIN met USING (doc_id)"""
