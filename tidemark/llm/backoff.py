"""Stupid-backoff scores of documents against the n-grams of all of them, as joins by hash.

Words are lower-cased (A-Z) runs of other characters than ASCII white space; n-grams do not cross texts.

1. Documents are dealt into blocks of some ``BLOCK_BYTES`` of text, at random, so that no source or
   copied text fills a block.
2. Each block's n-grams are exploded and counted inside the block, and asked for by hash: a row holds the
   distinct n-grams of one block that fall in one range of the hash, as arrays.
3. The count table is partitioned by that range. In each range the rows of all blocks are joined on the
   n-gram: counts are summed, and each row goes back to its block with the totals of its n-grams. An
   n-gram that all documents share is one entry a block, not one a document.
4. Each block is joined with its totals, and each position is scored: with the longest n-gram of
   at least ``MIN_COUNT`` occurrences, by its count over that of its first words, times ``ALPHA`` for
   every order given up; a single word by its count over all words.
5. Scores are summed per document, in whole millionths of a nat, so that sums do not depend on order.

Both shuffles grow with the text and nothing is collected but its size. The order is a parameter: each
further one adds some 8 bytes a word to the shuffle. Two queries are registered, of order two and three.

Edge cases: texts without words score 0 over 0 words; repeated rows count and are scored each; null
texts count as empty; an empty table yields no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shingles
from tidemark.sources.workspace import settle

ORDER = 2
MIN_COUNT = 2
ALPHA = 0.4
#: Least bytes of text in a block, and of text whose n-grams one range of the count table holds. Both grow
#: with the root of the text up to ``MOST_BYTES``, so that what a block asks of a range does not dwindle; a
#: task needs some fifteen times as much memory.
BLOCK_BYTES = 4 << 20
RANGE_BYTES = 8 << 20
MOST_BYTES = 64 << 20
UNIT = 1_000_000

_REQUEST = "block int, range int, grams binary, counts binary"
_RESPONSE = "block int, range int, totals binary"


def _planes(values: np.ndarray) -> bytes:
    """Bytes of like weight together, which compress where the high ones are zero."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _numbers(raw: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(raw, np.uint8).reshape(width, len(raw) // width)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _hashes(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and the number of words of each."""
    sizes, parts = [], []
    for value in texts.cast(pa.binary()):
        split = shingles.words(value.as_py() or b"")
        sizes.append(len(split))
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, split), np.uint64, len(split)))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array(sizes, np.int64)


def _grams(flat: np.ndarray, sizes: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: hashes of the n-grams, and the positions of their last words."""
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out, value = [], np.zeros(len(flat), np.uint64)
    for n in range(1, order + 1):
        # value[i] covers the n words that end at i
        value = shingles.mixed(value * np.uint64(0x9E3779B97F4A7C15) + flat) if n == 1 else shingles.mixed(
            np.concatenate([[np.uint64(0)], value[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + flat + np.uint64(n)
        )
        at = np.flatnonzero(place >= n - 1)
        out.append((value[at], at))
    return out


def _distinct(flat: np.ndarray, sizes: np.ndarray, order: int) -> tuple:
    grams = _grams(flat, sizes, order)
    every = np.concatenate([g for g, _ in grams])
    unique, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
    return grams, unique, inverse, counts


def _bounds(unique: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of the hash begins in a sorted array, and the end."""
    at = ((unique >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    return np.searchsorted(at, np.arange(ranges + 1, dtype=np.uint64))


def _asker(order: int, ranges: int):
    def ask(block: pa.Table) -> pa.Table:
        flat, sizes = _hashes(block["text"])
        _, unique, _, counts = _distinct(flat, sizes, order)
        bounds = _bounds(unique, ranges)
        full = [r for r in range(ranges) if bounds[r] < bounds[r + 1]]
        steps = np.diff(unique, prepend=np.uint64(0))
        grams = []
        for r in full:
            part = steps[bounds[r] : bounds[r + 1]].copy()
            part[0] = unique[bounds[r]]
            grams.append(_planes(part))
        tallies = [_planes(counts[bounds[r] : bounds[r + 1]].astype(np.uint64)) for r in full]
        number = block["block"][0].as_py() if block.num_rows else 0
        return pa.table(
            {
                "block": pa.array([number] * len(full), pa.int32()),
                "range": pa.array(full, pa.int32()),
                "grams": pa.array(grams, pa.binary()),
                "counts": pa.array(tallies, pa.binary()),
            }
        )

    return ask


def _count(asked: pa.Table) -> pa.Table:
    """The count table of one range, joined to what the blocks ask for."""
    sizes = [len(g.as_py()) // 8 for g in asked["grams"]]
    ends = np.cumsum(sizes)
    every, counts = np.empty((2, ends[-1]), np.uint64)
    for gram, count, size, end in zip(asked["grams"], asked["counts"], sizes, ends, strict=True):
        np.cumsum(_numbers(gram.as_py(), np.uint64), dtype=np.uint64, out=every[end - size : end])
        counts[end - size : end] = _numbers(count.as_py(), np.uint64)
    unique, inverse = np.unique(every, return_inverse=True)
    totals = np.zeros(len(unique), np.uint64)
    np.add.at(totals, inverse, counts)
    back = [_planes(totals[inverse[end - size : end]]) for size, end in zip(sizes, ends, strict=True)]
    return pa.table({"block": asked["block"], "range": asked["range"], "totals": pa.array(back, pa.binary())})


def _scorer(order: int, min_count: int, alpha: float):
    def score(block: pa.Table, answered: pa.Table) -> pa.Table:
        flat, sizes = _hashes(block["text"])
        grams, unique, inverse, _ = _distinct(flat, sizes, order)
        answers = answered.sort_by("range")["totals"].to_pylist()
        totals = np.concatenate([_numbers(a, np.uint64) for a in answers]) if answers else np.zeros(0, np.uint64)
        assert len(totals) == len(unique)
        seen = totals[inverse].astype(np.float64)
        count, start = [], 0
        for hashes, at in grams:
            dense = np.zeros(len(flat))
            dense[at] = seen[start : start + len(hashes)]
            count.append(dense)
            start += len(hashes)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        # the words of a position in millionths of a nat, but for the share of all words of those left to one word
        units, level = np.zeros(len(flat), np.int64), np.ones(len(flat), np.int64)
        longest = np.minimum(place + 1, order)
        open_ = np.ones(len(flat), bool)
        for n in range(order, 0, -1):
            use = open_ & (longest >= n) & ((count[n - 1] >= min_count) if n > 1 else True)
            at = np.flatnonzero(use)
            nats = np.log(count[n - 1][at])
            if n > 1:
                nats -= np.log(count[n - 2][at - 1])
            units[at] = np.round((nats + (longest[at] - n) * math.log(alpha)) * UNIT).astype(np.int64)
            level[at] = n
            open_ &= ~use
        ends = np.cumsum(sizes)
        summed = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[np.concatenate([[0], ends])])
        return pa.table(
            {
                "doc_id": block["doc_id"],
                "n_words": pa.array(sizes, pa.int64()),
                "units": pa.array(summed(units), pa.int64()),
                "n_single": pa.array(summed(level == 1), pa.int64()),
            }
        )

    return score


def scores(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, alpha: float = ALPHA) -> DataFrame:
    """One row per document: doc_id, n_words, n_single (scored as single words), log_score, mean_log_score."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    grown = min(math.isqrt(size * 64), MOST_BYTES)
    blocks, ranges = (-(-size // max(step, grown)) or 1 for step in (BLOCK_BYTES, RANGE_BYTES))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    asked = dealt.groupBy("block").applyInArrow(_asker(order, ranges), _REQUEST)
    answered = asked.groupBy("range").applyInArrow(_count, _RESPONSE)
    found = dealt.groupBy("block").cogroup(answered.groupBy("block"))
    result = "doc_id bigint, n_words bigint, units bigint, n_single bigint"
    summed = settle(found.applyInArrow(_scorer(order, min_count, alpha), result), "backoff-scores")
    total = summed.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("all_words"))
    each = F.when(F.col("all_words") > 0, F.round(F.log("all_words") * UNIT).cast("bigint")).otherwise(0)
    nats = (F.col("units") - F.col("n_single") * each) / F.lit(float(UNIT))
    # one row, by construction
    return summed.join(F.broadcast(total)).select(
        "doc_id",
        "n_words",
        "n_single",
        nats.alias("log_score"),
        F.when(F.col("n_words") > 0, nats / F.col("n_words")).otherwise(0.0).alias("mean_log_score"),
    )


def oracle(alpha: float = ALPHA, min_count: int = MIN_COUNT) -> str:
    """The query of order two in SQL."""
    units = f"cast(round(({{}}) * {UNIT}) AS bigint)"
    return rf"""
WITH split AS (
  SELECT doc_id, row_number() OVER () AS rid,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
placed AS (SELECT rid, unnest(words) AS word, unnest(range(len(words))) AS place FROM split),
pairs AS (SELECT rid, place, word, lag(word) OVER (PARTITION BY rid ORDER BY place) AS before FROM placed),
single AS (SELECT word, count(*) AS n FROM placed GROUP BY word),
double AS (SELECT before, word, count(*) AS n FROM pairs WHERE before IS NOT NULL GROUP BY before, word HAVING count(*) >= {min_count}),
scored AS (
  SELECT p.rid, d.n IS NULL AS alone,
    CASE WHEN d.n IS NOT NULL THEN {units.format("ln(d.n) - ln(b.n)")}
         WHEN p.before IS NULL THEN {units.format("ln(s.n)")}
         ELSE {units.format(f"ln(s.n) + ln({alpha}::double)")} END AS u
  FROM pairs p JOIN single s ON s.word = p.word LEFT JOIN single b ON b.word = p.before
  LEFT JOIN double d ON d.before = p.before AND d.word = p.word),
summed AS (SELECT rid, sum(u) AS u, count(*) FILTER (alone) AS n_single FROM scored GROUP BY rid),
every AS (SELECT {units.format("ln(count(*))")} AS each FROM placed),
full_rows AS (
  SELECT s.doc_id, len(s.words) AS n_words, coalesce(m.n_single, 0) AS n_single,
    cast(coalesce(m.u - m.n_single * e.each, 0) AS double) / {float(UNIT)} AS log_score
  FROM split s LEFT JOIN summed m ON m.rid = s.rid CROSS JOIN every e)
SELECT doc_id, n_words, n_single, log_score, CASE WHEN n_words > 0 THEN log_score / n_words ELSE 0 END AS mean_log_score FROM full_rows"""
