"""Ranked lexical search with hashed max-sketches: upper bounds first, exact scores in falling order of bounds.

What a term adds to a document's score is its weight times an impact that, within one document, grows with
the number of its occurrences only. So a document's sketch folds its terms into hashed coordinates that each
keep the largest number of occurrences: the coordinatewise maximum of the impacts, put in force once the
corpus totals that impacts depend on are known. Numbers up to 128 are kept exactly, larger ones rounded up.
Each term goes to three coordinates, of which a lookup takes the least; with at least twelve for each different
term, one in a hundred lookups of a term that a document lacks finds something.

One pass over the texts writes the sketches and the partial document counts of terms. The queries come in
blocks of bounded size, and each block goes over the sketches in rounds. A round looks up all its terms, and
of the documents not yet scored keeps each query's highest bounds; those are scored exactly on their texts.
A query is done when no bound is left that reaches its lowest place so far. Nothing is cut: a round that
is not enough is followed by one of four times its size.

Equal term sequences share a digest and are one candidate, however many copies there are, and are dealt out
to their documents at the end. At scale no text and no sketch is shuffled: each task passes on its best
bounds, and the candidates of a round are a written table of counted rows that is broadcast. Only a round of
more than ``BROADCAST_ROWS`` candidates is left to Spark, which may shuffle the texts to meet them.

Edge cases: null and texts without terms are in no count and are not found; an item without terms has no
rows; items are rows, so two with the same id have a list each; repeated rows of documents count and are
ranked each, and those without an id come last among equals; an empty table gives no rows. Only ``doc_id``,
``item_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.winnowing import words as terms_of
from tidemark.sources.workspace import fresh_path, settle

TOP = 50
#: Coordinates that a term is hashed to; coordinates of a sketch for each different term, at least, and in all.
HASHES, ROOM, NARROWEST = 3, 12, 64
#: Terms of a block of queries, about: what the driver holds of them, and what goes to each task.
BLOCK_TERMS = 1 << 17
#: Candidates of a query in its first round.
FIRST = 128
#: Candidates of a round that are broadcast whatever the session's threshold, some 100 bytes each.
BROADCAST_ROWS = 1 << 19
#: Bytes of sketches and documents looked up at once.
LOOKUP_BYTES, LOOKUP_ROWS = 8 << 20, 512
#: Terms whose counts a task holds before it passes them on, and the bytes in them.
HELD_TERMS, HELD_BYTES = 200_000, 32 << 20

# every separator becomes a space and A-Z become a-z; bytes from 0x80 on belong to terms
_KEPT = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]
_READ = bytes(b if b in _KEPT else 0x20 for b in range(256)).lower()


def _levels() -> np.ndarray:
    """Numbers of occurrences by code: exact up to 128, then in steps of 6 %; the last stands for all beyond."""
    levels = list(range(129))
    while len(levels) < 255:
        levels.append(levels[-1] * 106 // 100 + 1)
    return np.array([*levels, 1 << 32], np.int64)


LEVELS = _levels()


def terms(raw: bytes) -> list[bytes]:
    """Terms of a text, in order."""
    return raw.translate(_READ).split()


def digest_of(split: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(split), digest_size=16).digest()


def coordinates(hashes: np.ndarray, width: int) -> list[np.ndarray]:
    """Where the terms of these hashes go in a sketch of ``width``, a power of two: by odd steps from a first place."""
    step = (hashes >> np.uint64(40)) | np.uint64(1)
    return [((hashes + np.uint64(k) * step) & np.uint64(width - 1)).astype(np.int64) for k in range(HASHES)]


def sketch(counts: Counter[bytes]) -> bytes:
    """Codes of the largest numbers of occurrences by coordinate."""
    width = max(NARROWEST, 1 << (ROOM * len(counts) - 1).bit_length())
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, counts), np.uint64, len(counts))
    codes = np.searchsorted(LEVELS, np.fromiter(counts.values(), np.int64, len(counts))).astype(np.uint8)
    out = np.zeros(width, np.uint8)
    for at in coordinates(hashes, width):
        np.maximum.at(out, at, codes)
    return out.tobytes()


_SKETCHED = "kind string, doc_id bigint, digest binary, n bigint, sketch binary, term binary, df bigint"


def _sketch_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches of texts, and how many of the task's texts hold each term."""
    names = [c.split()[0] for c in _SKETCHED.split(", ")]
    held: Counter[bytes] = Counter()
    held_bytes = 0

    def docs(rows: list[tuple]) -> pa.RecordBatch:
        ids, digests, sizes, sketches = zip(*rows, strict=True)
        none = pa.nulls(len(rows), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(["doc"] * len(rows)), pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
             pa.array(sketches, pa.binary()), none, pa.nulls(len(rows), pa.int64())], names)

    def counts() -> pa.RecordBatch:
        n, none = len(held), pa.nulls(len(held), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(["term"] * n), pa.nulls(n, pa.int64()), none, pa.nulls(n, pa.int64()), none,
             pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names)

    for batch in batches:
        rows, size = [], 0
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text").cast(pa.binary()), strict=True):
            split = terms(text.as_py() or b"")
            if not split:
                continue
            found = Counter(split)
            before = len(held)
            held.update(found.keys())
            held_bytes += sum(map(len, found)) if len(held) > before else 0
            rows.append((doc_id.as_py(), digest_of(split), len(split), sketch(found)))
            size += len(rows[-1][3])
            if size > LOOKUP_BYTES:
                yield docs(rows)
                rows, size = [], 0
            if len(held) > HELD_TERMS or held_bytes > HELD_BYTES:
                yield counts()
                held.clear()
                held_bytes = 0
        if rows:
            yield docs(rows)
    if held:
        yield counts()


class Queries:
    """A block of queries: the hashes of their terms, and each one's terms and weights."""

    def __init__(self, rows: list[tuple[int, list[bytes], list[int]]]):
        self.keys = [key for key, _, _ in rows]
        vocabulary = sorted({term for _, listed, _ in rows for term in listed})
        place = {term: i for i, term in enumerate(vocabulary)}
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), np.uint64, len(vocabulary))
        self.places = [np.array([place[t] for t in listed], np.int64) for _, listed, _ in rows]
        self.weights = [np.array(w, np.float64) for _, _, w in rows]
        self.exact = [list(zip(listed, w, strict=True)) for _, listed, w in rows]

    def bounds(self, sketches: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Upper bounds, query by document; whole numbers below 2^53, so doubles add them up exactly."""
        by_coordinate = np.ascontiguousarray(sketches.T)
        codes = reduce(np.minimum, (by_coordinate[at] for at in coordinates(self.hashes, sketches.shape[1])))
        term, doc = np.nonzero(codes)
        tf = LEVELS[codes[term, doc]]
        impacts = np.zeros(codes.shape)
        impacts[term, doc] = (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])
        return np.stack([w @ impacts[at] for at, w in zip(self.places, self.weights, strict=True)])

    def score(self, query: int, counts: Counter[bytes], m: int) -> int:
        return sum(w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m)) for term, w in self.exact[query] if (tf := counts.get(term)))


def length_norm(n, n_docs: int, n_terms: int):
    """m of documents with ``n`` terms."""
    return 50 + (50 * n * n_docs) // n_terms


_CANDIDATE = "query int, bound double, digest binary, doc_id bigint"


class _Best:
    """The highest bounds of one query among the different digests of a task."""

    def __init__(self, size: int):
        self.size, self.floor, self.found = size, 0.0, {}

    def add(self, bound: float, digest: bytes, doc_id: int | None) -> None:
        known = self.found.get(digest)
        if known is not None:
            self.found[digest] = (bound, min((i for i in (known[1], doc_id) if i is not None), default=None))
            return
        self.found[digest] = (bound, doc_id)
        if len(self.found) >= 2 * self.size:
            self.cut()

    def cut(self) -> None:
        order = sorted(self.found.items(), key=lambda x: (-x[1][0], x[0]))[: self.size]
        self.found = dict(order)
        if len(order) == self.size:
            self.floor = order[-1][1][0]


def _highest(sketches: DataFrame, queries: Queries, totals: tuple[int, int], size: int, low: list[float], after: list[tuple | None]) -> DataFrame:
    """Each task's ``size`` highest bounds of each query, from ``low`` on and behind ``after``, by digest."""
    lowest = np.array(low)
    #: queries that are done look at nothing
    first = np.array([np.inf if a is None else a[0] for a in after])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(size) for _ in queries.keys]
        floor = np.maximum(lowest, 1.0)
        for batch in batches:
            digests, ids = batch.column("digest").to_pylist(), batch.column("doc_id").to_pylist()
            m = length_norm(batch.column("n").to_numpy().astype(np.int64), *totals)
            raw = batch.column("sketch")
            widths = np.array([len(s.as_buffer()) for s in raw], np.int64)
            for width in np.unique(widths).tolist():
                alike = np.flatnonzero(widths == width)
                step = max(1, min(LOOKUP_ROWS, LOOKUP_BYTES // width))
                for rows in (alike[i : i + step] for i in range(0, len(alike), step)):
                    codes = np.frombuffer(b"".join(raw[int(r)].as_py() for r in rows), np.uint8).reshape(len(rows), width)
                    bounds = queries.bounds(codes, m[rows])
                    inside = (bounds >= floor[:, None]) & (bounds <= first[:, None])
                    for q, d in zip(*map(np.ndarray.tolist, np.nonzero(inside)), strict=True):
                        r = rows[d]
                        if after[q] is None or (-bounds[q, d], digests[r]) > (-after[q][0], after[q][1]):
                            best[q].add(bounds[q, d], digests[r], ids[r])
                    floor = np.maximum(floor, [b.floor for b in best])
        for b in best:
            b.cut()
        found = [(q, bound, digest, doc_id) for q, b in enumerate(best) for digest, (bound, doc_id) in b.found.items()]
        for i in range(0, len(found), 10_000):
            columns = zip(*found[i : i + 10_000], strict=True)
            kinds = [pa.int32(), pa.float64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["query", "bound", "digest", "doc_id"])

    each = sketches.select("digest", "doc_id", "n", "sketch").mapInArrow(run, _CANDIDATE)
    alike = each.groupBy("query", "bound", "digest").agg(F.min("doc_id").alias("doc_id"))
    order = Window.partitionBy("query").orderBy(F.desc("bound"), "digest")
    return alike.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= size)


def _scored(texts: DataFrame, candidates: DataFrame, n_candidates: int, queries: Queries, totals: tuple[int, int]) -> DataFrame:
    """Exact scores of candidates, on their texts: query, digest, doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = batch.column("text").cast(pa.binary()), batch.column("digest"), batch.column("queries"), batch.column("doc_id")
            for text, digest, asked, doc_id in zip(*columns, strict=True):
                split = terms(text.as_py() or b"")
                # rows that share an id with the candidate but not its terms
                if not split or digest_of(split) != digest.as_py():
                    continue
                counts, m = Counter(split), length_norm(len(split), *totals)
                rows += [(q, digest.as_py(), doc_id.as_py(), queries.score(q, counts, m)) for q in asked.as_py()]
            kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["query", "digest", "doc_id", "score"])

    asked = settle(candidates.groupBy("digest", F.col("doc_id").alias("__id")).agg(F.collect_list("query").alias("queries")), "search-asked")
    # no text is shuffled to meet a table whose size follows from the queries, not from the texts
    if n_candidates <= BROADCAST_ROWS:
        asked = F.broadcast(asked)
    met = texts.join(asked, F.col("doc_id").eqNullSafe(F.col("__id"))).select("doc_id", "text", "digest", "queries")
    scores = met.mapInArrow(run, "query int, digest binary, doc_id bigint, score bigint").filter("score > 0")
    return scores.groupBy("query", "digest").agg(F.min("doc_id").alias("doc_id"), F.max("score").alias("score"))


def _first_places(scores: DataFrame) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "digest")
    return scores.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= TOP)


def _block(texts: DataFrame, sketches: DataFrame, queries: Queries, totals: tuple[int, int]) -> DataFrame:
    """The documents of the highest scores for a block of queries: query, digest, score, written."""
    n = len(queries.keys)
    after: list[tuple | None] = [None] * n
    low = [0.0] * n
    size = FIRST
    found: DataFrame | None = None
    while True:
        candidates = settle(_highest(sketches, queries, totals, size, low, after), "search-candidates")
        last = {r["query"]: r for r in candidates.groupBy("query").agg(F.count("*").alias("n"), F.max_by(F.struct("bound", "digest"), "place").alias("last")).collect()}
        scores = _scored(texts, candidates, sum(r["n"] for r in last.values()), queries, totals)
        # places won so far, at most TOP a query
        found = settle(_first_places(scores if found is None else found.drop("place").unionByName(scores)), "search-scores")
        for row in found.filter(F.col("place") == TOP).collect():
            low[row["query"]] = float(row["score"])
        open_ = False
        for q in range(n):
            if q in last and last[q]["n"] == size and last[q]["last"]["bound"] >= low[q]:
                after[q], open_ = (last[q]["last"]["bound"], bytes(last[q]["last"]["digest"])), True
            else:
                low[q] = np.inf
        if not open_:
            return found
        size *= 4


def _weighed(spark: SparkSession, items: DataFrame, counts: DataFrame, n_docs: int) -> DataFrame:
    """item, item_id, terms and weights of the items, without terms that no document has or that weigh nothing."""
    numbered = items.withColumn("item", F.monotonically_increasing_id())
    listed = numbered.select("item", "item_id", F.explode_outer(F.array_distinct(terms_of(F.col("text")))).alias("term"))
    listed = settle(listed.filter("term IS NOT NULL").withColumn("term", F.col("term").cast("binary")), "search-items")
    df = counts.join(listed.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double")))
    rows = listed.join(settle(df, "search-counts"), "term").withColumn("w", weight).filter("w > 0")
    return rows.groupBy("item", "item_id").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("terms"))


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: each item's best documents."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    path = fresh_path(spark, "search-sketches")
    texts.mapInArrow(_sketch_texts, _SKETCHED).write.partitionBy("kind").parquet(path)
    written = spark.read.schema(_SKETCHED).parquet(path)
    sketches, counts = written.filter("kind = 'doc'"), written.filter("kind = 'term'").select("term", "df")
    n_docs, n_terms = sketches.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weighed = settle(_weighed(spark, items.select("item_id", F.col("text").cast("string").alias("text")), counts, n_docs), "search-weights")
    n_blocks = -(-(weighed.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS)
    found = [_found_in(texts, sketches, weighed, block, n_blocks, (n_docs, n_terms)) for block in range(n_blocks)]
    if not found:
        nothing = weighed.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("score"))
        return nothing.limit(0)
    return reduce(DataFrame.unionByName, found)


def _found_in(texts: DataFrame, sketches: DataFrame, weighed: DataFrame, block: int, n_blocks: int, totals: tuple[int, int]) -> DataFrame:
    number: Column = F.pmod(F.xxhash64("item"), F.lit(n_blocks))
    rows = weighed.filter(number == block).orderBy("item").collect()
    queries = Queries([(r["item"], [bytes(t["term"]) for t in r["terms"]], [t["w"] for t in r["terms"]]) for r in rows])
    best = _block(texts, sketches, queries, totals).select("query", "digest", "score")
    # of equal texts, only the first TOP by id can be among an item's first TOP
    first = Window.partitionBy("digest").orderBy(F.asc_nulls_last("doc_id"))
    copies = sketches.select("digest", "doc_id").join(best.select("digest").distinct(), "digest", "left_semi")
    copies = copies.withColumn("copy", F.row_number().over(first)).filter(F.col("copy") <= TOP)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.join(copies, "digest").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)
    names = weighed.filter(number == block).select(
        "item_id", F.element_at(F.create_map(*[F.lit(x) for q, key in enumerate(queries.keys) for x in (key, q)]), F.col("item")).alias("query")
    )
    return ranked.join(names, "query").select("item_id", "rank", "doc_id", "score")


def oracle() -> str:
    """The same over all pairs of items and documents, which serves to check, not to scale."""
    split = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH texts AS (SELECT doc_id, {split} AS w FROM documents),
totals AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM texts WHERE len(w) > 0),
tfs AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM texts),
tf AS (SELECT doc_id, term, any_value(n) AS n, count(*) AS tf FROM tfs GROUP BY doc_id, term),
asked AS (SELECT item_id, unnest(list_distinct({split})) AS term FROM benchmark),
weight AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms)))))::BIGINT AS score
  FROM asked JOIN weight USING (term) JOIN tf USING (term), totals GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50"""
