"""Near-duplicate detection by an inverted join of MinHash signature coordinates.

Documents of one word sequence form a class; classes are what is compared.

1. A class has 64 coordinates, each the smallest of its shingle hashes under one of 64 permutations.
   A posting is (coordinate, value) -> class. Values met in one class only are dropped, and with them
   all classes left with fewer than ``MATCHES`` coordinates: they can reach no match count.
2. Prefix: two classes with ``MATCHES`` common values share one among the rarest
   ``left - MATCHES + 1`` of either, so only those are posted for the merge. The longer, commoner lists
   are skipped in the merge; their part of the count is read off the signatures of a candidate pair.
3. Pairs with at least ``MATCHES`` equal coordinates are confirmed on their full shingle sets:
   100 * intersection >= 75 * union.
4. Before each round, the shingles of the classes in open lists are counted. A class whose shingles
   mostly occur nowhere else cannot reach the threshold with any partner, nor can two classes if the
   smaller number of their shared shingles, or their sizes, do not allow it: these are left out, exactly.
   So texts that have a passage in common, and little else, are not compared with each other. Nor are
   copies that differ too much from the hub of their list, unless they differ from it in the same way:
   two classes share at most what both have of the hub and what both have beside it.
5. A list is not paired with itself. Its members are compared with its most central one (the hub, with the
   largest share of shingles that occur elsewhere too); those found linked become one component. A hub has
   then met all of its list and leaves it. Lists whose other members are not of one component yet go on to
   a round with more hubs, and so on until what is left of each list was compared with all of it. So no list
   is cut, and copies of copies cost a star, not a square.
6. Components by contraction: edges shrink each round and are written to the shared folder.

At a similarity of 0.75 a pair has Binomial(64, 0.75) equal coordinates: below 32 with probability
under 1e-5, which is the chance to miss a link at the very threshold.

Edge cases: null or empty texts have no shingles and are linked with nothing; repeated rows are one
class; rows without an id take part, but never name a component while another row does; rows that
share an id and not the text are linked only by their texts, and repeated rows stay or go together.
A group without any id is kept whole. An empty table yields no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import shingles
from tidemark.sources.workspace import settle

COORDINATES = 64
MATCHES = 32
PERCENT = 75
#: Members of one list that one task joins with its hubs, and pairs of one hub that one task compares.
SPLIT_ROWS = 4000
FIRST_HUBS, MORE_HUBS = 64, 16

_LOW = np.uint64(COORDINATES - 1)
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_A = _RANDOM.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 2**63, COORDINATES, dtype=np.uint64)


def _signatures(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of coordinates per text (all texts have shingles here); the low bits name the coordinate."""
    out = np.empty((len(starts), COORDINATES), np.uint64)
    for k in range(COORDINATES):
        least = np.minimum.reduceat(grams * _A[k] + _B[k], starts)
        out[:, k] = (least & ~_LOW) | np.uint64(k)
    return out.view(np.int64)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, raws in shingles.chunks(batch.column("text")):
            split = [shingles.words(raw) for raw in raws]
            grams, at = shingles.hashed(split)
            sizes = [len(np.unique(grams[s:e])) for s, e in zip(at[:-1], at[1:], strict=True)]
            full = np.flatnonzero(np.diff(at))
            signatures = _signatures(grams, at[:-1][full]) if len(full) else np.empty((0, COORDINATES), np.int64)
            lengths = np.zeros(len(raws) + 1, np.int32)
            lengths[1 + full] = COORDINATES
            yield pa.record_batch(
                [
                    batch.column("doc_id").slice(first, len(raws)),
                    batch.column("uid").slice(first, len(raws)),
                    batch.column("th").slice(first, len(raws)),
                    pa.array([shingles.digest(w) for w in split], pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.cumsum(lengths, dtype=np.int32)), pa.array(signatures.ravel())),
                ],
                ["doc_id", "uid", "th", "key", "n_shingles", "signature"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, raws in shingles.chunks(batch.column("text")):
            split = [shingles.words(raw) for raw in raws]
            grams, at = shingles.hashed(split)
            parts = [np.unique(grams[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)]
            offsets = np.cumsum([0, *map(len, parts)], dtype=np.int32)
            flat = np.concatenate(parts).view(np.int64)
            # a row that shares the id of the wanted text but not its words is left out
            right = pa.array([shingles.digest(w) for w in split], pa.binary())
            wanted = batch.column("key").slice(first, len(raws))
            out = pa.record_batch(
                [batch.column("cid").slice(first, len(raws)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                ["cid", "grams"],
            )
            yield out.filter(pa.compute.equal(right, wanted))


def _uid() -> Column:
    """The id, or for rows without one a number made of the text, to find the text again."""
    return F.coalesce(F.col("doc_id").cast("bigint"), -F.abs(F.shiftright(F.xxhash64("text"), 1)) - 1)


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n_shingles) of each row, and one row per class with a number of its own."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = "doc_id bigint, uid bigint, th bigint, key binary, n_shingles bigint, signature array<bigint>"
    marks = settle(rows.select("doc_id", _uid().alias("uid"), F.xxhash64("text").alias("th"), "text").mapInArrow(_mark, kinds), "minhash-marks")
    grouped = (
        marks.filter("key IS NOT NULL")
        .groupBy("key")
        .agg(
            F.min("doc_id").alias("least"),
            F.min("uid").alias("uid"),
            F.first("n_shingles").alias("size"),
            F.first("signature").alias("signature"),
        )
    )
    classes = settle(grouped.select(F.monotonically_increasing_id().alias("cid"), "*"), "minhash-classes")
    return marks, classes


def _postings(classes: DataFrame) -> DataFrame:
    """(token, n, cid, size): the rarest coordinates of each class. n is the number of classes with the
    token, size that of the class's shingles."""
    tokens = classes.select("cid", "size", F.explode("signature").alias("token"))
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    left = (
        tokens.join(common, "token")
        .groupBy("cid", "size")
        .agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("left"))
        .filter(F.size("left") >= MATCHES)
    )
    prefix = F.slice("left", F.lit(1), F.size("left") - (MATCHES - 1))
    return settle(left.select("cid", "size", F.inline(prefix)), "minhash-postings")


def _posted_sets(postings: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(cid, grams): the full shingle sets of the classes that are posted, from the texts."""
    wanted = classes.join(postings.select("cid").distinct(), "cid", "left_semi").select("cid", "uid", "key")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.select(_uid().alias("uid"), "text").join(wanted, "uid").select("cid", "key", "text")
    return settle(found.mapInArrow(_sets, "cid bigint, grams array<bigint>").dropDuplicates(["cid"]), "minhash-sets")


def _splits(rows: Column) -> Column:
    return F.floor(rows / SPLIT_ROWS).cast("int")


def _share(splits: Column, *of: str) -> Column:
    return F.pmod(F.xxhash64(*of), splits + 1).cast("int")


def _copies(splits: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), splits))


def _dealt(members: DataFrame) -> DataFrame:
    """Members of a list dealt over tasks by its length, which whatever joins them by the list knows too."""
    return members.withColumn("share", _share(_splits(F.col("n")), "cid"))


def _near_in_size(size: Column, other: Column) -> Column:
    """Whether sets of these sizes can be similar: the smaller one is all there could be in common."""
    return 100 * F.least(size, other) >= PERCENT * F.greatest(size, other)


def _starred(members: DataFrame, hubs: DataFrame) -> DataFrame:
    """Pairs (a, b, splits) of hubs with the members of their lists that are in other components and that
    sizes and shared shingles allow to be similar. Of the ``live`` shingles that occur elsewhere, ``near``
    are also in the list's first hub. A pair that meets in several lists of a later round comes out of the
    first of them only: ``tokens`` are the member's open lists, ``hub_tokens`` those that it is a hub of."""
    load = hubs.groupBy("hub").agg(_splits(F.max("n")).alias("splits"))
    dealt = hubs.join(load, "hub").select(
        "token", "hub", "hub_comp", "hub_size", "hub_live", "hub_near", "hub_tokens", "splits",
        _copies(_splits(F.col("n"))).alias("share"),
    )
    both = _dealt(members).alias("m").join(
        dealt.alias("h"),
        (F.col("m.token") == F.col("h.token"))
        & (F.col("m.share") == F.col("h.share"))
        & (F.col("comp") != F.col("hub_comp"))
        & _near_in_size(F.col("size"), F.col("hub_size"))
        # similar sets have PERCENT / (100 + PERCENT) of both sizes together in common
        & ((100 + PERCENT) * (F.least("near", "hub_near") + F.least(F.col("live") - F.col("near"), F.col("hub_live") - F.col("hub_near")))
           >= PERCENT * (F.col("size") + F.col("hub_size")))
        & (F.col("hub_tokens").isNull() | (F.col("m.token") == F.array_min(F.array_intersect("tokens", "hub_tokens")))),
    )
    pairs = both.select(F.col("hub").alias("a"), F.col("cid").alias("b"), "splits")
    return pairs.groupBy("a", "b").agg(F.max("splits").alias("splits"))


def _with_both(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """``value`` of either class of each pair; what belongs to a busy hub is dealt over tasks."""
    load = pairs.groupBy("a").agg(F.max("splits").alias("most"))
    left = table.join(load, table["cid"] == load["a"]).select("a", _copies(F.col("most")).alias("share"), F.col(value).alias("of_a"))
    right = table.select(F.col("cid").alias("b"), F.col(value).alias("of_b"))
    return pairs.withColumn("share", _share(F.col("splits"), "b")).join(left, ["a", "share"]).join(right, "b")


def _confirmed(pairs: DataFrame, posted: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that reach the match count and whose full sets are similar."""
    equal = F.size(F.array_intersect("of_a", "of_b"))
    counted = _with_both(pairs, posted, "signature").filter(equal >= MATCHES).select("a", "b", "splits")
    matched = settle(counted, "minhash-matched")
    common = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - common
    return _with_both(matched, sets, "grams").filter(100 * common >= PERCENT * union).select("a", "b")


def _follow(labels: DataFrame, to: DataFrame) -> DataFrame:
    """Labels (cid, comp) after the components in ``to`` (u) took the names they map to (t)."""
    named = to.withColumnsRenamed({"u": "comp", "t": "next"})
    return labels.join(named, "comp", "left").select("cid", F.coalesce("next", "comp").alias("comp"))


def components(edges: DataFrame) -> DataFrame:
    """(cid, comp) of every class in an edge, by contraction.

    Each round maps a class to the first of itself and its neighbours and carries the edges over. The
    order is that of the numbers at first, which folds stars at once, then a new random one each round,
    which folds chains too: a quarter of the classes goes in each round, as expected. Edges and labels are
    written in each round, so no plan grows with the rounds.
    """
    edges = settle(edges.filter("a <> b"), "minhash-edges")
    labels: DataFrame | None = None
    number = 0
    while labels is None or not edges.isEmpty():
        rank = F.col("v") if number < 2 else F.xxhash64("v", F.lit(number))
        number += 1
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")), F.struct("a", F.col("a").alias("b")), F.struct(F.col("b").alias("a"), "b"))).alias("e"))
        ranked = both.select(F.col("e.a").alias("u"), F.col("e.b").alias("v")).groupBy("u").agg(F.min(F.struct(rank.alias("r"), "v")).alias("m"))
        to = settle(ranked.select("u", F.col("m.v").alias("t")), "minhash-map")
        labels = to.select(F.col("u").alias("cid"), F.col("t").alias("comp")) if labels is None else settle(_follow(labels, to), "minhash-labels")
        moved = (
            edges.join(to.withColumnsRenamed({"u": "a", "t": "ta"}), "a")
            .join(to.withColumnsRenamed({"u": "b", "t": "tb"}), "b")
            .filter("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
        )
        edges = settle(moved.distinct(), "minhash-edges")
    return labels


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (cid, comp) after further links (a, b): only the components that they join are contracted."""

    def named(side: str) -> DataFrame:
        return labels.select(F.col("cid").alias(side), F.col("comp").alias(f"comp_{side}"))

    over = links.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b"))
    to = components(over).withColumnsRenamed({"cid": "u", "comp": "t"})
    fresh = links.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(labels, "cid", "left_anti")
    every = labels.unionByName(fresh.withColumn("comp", F.col("cid")))
    return settle(_follow(every, to), "minhash-labels")


def _left(members: DataFrame, hubs: DataFrame, labels: DataFrame) -> DataFrame:
    """Members without the hubs that have met all of their list by now, with their components."""
    rest = members.drop("comp").join(hubs.select("token", F.col("hub").alias("cid")), ["token", "cid"], "left_anti")
    return rest.join(labels, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))


def _open(members: DataFrame) -> DataFrame:
    """Members of lists in which they differ in component."""
    still = members.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high")
    return members.join(still.select("token"), "token", "left_semi")


def _able(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Members with their number of shingles that occur in other members or first hubs of open lists
    (``live``), without those that cannot be similar even to the smallest partner their list allows."""
    ids = members.select(F.explode(F.array("cid", "first")).alias("cid")).distinct()
    grams = sets.join(ids, "cid", "left_semi").select("cid", F.explode("grams").alias("gram"))
    twice = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    live = grams.join(twice, "gram").groupBy("cid").agg(F.count(F.lit(1)).alias("live"))
    counted = members.drop("live").join(live, "cid")
    smallest = members.groupBy("token", "n").agg(F.min("size").alias("smallest"))
    dealt = smallest.select("token", "smallest", _copies(_splits(F.col("n"))).alias("share"))
    partner = F.greatest(F.col("smallest"), F.ceil(F.col("size") * PERCENT / 100))
    able = (100 + PERCENT) * F.col("live") >= PERCENT * (F.col("size") + partner)
    return _dealt(counted).join(dealt, ["token", "share"]).filter(able).drop("share", "smallest")


def _next_hubs(members: DataFrame, hubs: int) -> DataFrame:
    """Up to ``hubs`` members of each list outside its largest component, the most shared ones first."""
    sizes = members.groupBy("token", "n", "comp").agg(F.count(F.lit(1)).alias("members"))
    large = sizes.groupBy("token", "n").agg(F.max_by("comp", F.struct("members", "comp")).alias("large"))
    dealt = large.select("token", "large", _copies(_splits(F.col("n"))).alias("share"))
    outside = _dealt(members).join(dealt, ["token", "share"]).filter("comp <> large")
    order = Window.partitionBy("token").orderBy((F.col("live") / F.col("size")).desc(), "cid")
    picked = outside.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= hubs)
    return _listed(picked.selectExpr(*_AS_HUB), "hub", "hub_tokens")


def _listed(rows: DataFrame, of: str, name: str) -> DataFrame:
    """Rows with all tokens of their class, of which a prefix bounds the number."""
    return rows.withColumn(name, F.collect_set("token").over(Window.partitionBy(of)))


def _beside(members: DataFrame, first: DataFrame, sets: DataFrame) -> DataFrame:
    """Members with the first hub of their list and how many shingles they have in common with it (``near``)."""
    dealt = first.select("token", F.col("hub").alias("first"), _copies(_splits(F.col("n"))).alias("share"))
    placed = _dealt(members.drop("first", "near")).join(dealt, ["token", "share"]).drop("share")
    pairs = placed.groupBy(F.col("first").alias("a"), F.col("cid").alias("b")).agg(_splits(F.max("n")).alias("splits"))
    load = pairs.groupBy("a").agg(F.max("splits").alias("most"))
    # a hub has the splits of its longest list in all its pairs
    known = pairs.drop("splits").join(load.withColumnRenamed("most", "splits"), "a")
    near = _with_both(known, sets, "grams").select(
        F.col("a").alias("first"), F.col("b").alias("cid"), F.size(F.array_intersect("of_a", "of_b")).cast("bigint").alias("near")
    )
    return placed.join(near, ["first", "cid"])


#: A member of a list, as its hub.
_AS_HUB = ["token", "n", "cid AS hub", "comp AS hub_comp", "size AS hub_size", "live AS hub_live", "near AS hub_near"]


def _linked(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(cid, comp) of every class that is linked with another."""
    postings = _postings(classes)
    sets = _posted_sets(postings, classes, docs)
    posted = classes.join(postings.select("cid").distinct(), "cid", "left_semi").select("cid", "signature")
    every = postings.withColumns({"comp": F.col("cid"), "first": F.col("cid")})
    # what is near is unknown before there is a hub: all that is live may be
    able = _able(every, sets).withColumns({"near": F.col("live"), "tokens": F.lit(None).cast("array<bigint>")})
    members = settle(_open(able), "minhash-able")
    central = F.max_by(F.struct("cid", "comp", "size", "live", "near"), F.struct(F.col("live") / F.col("size"), -F.col("cid"))).alias("h")
    hubs = members.groupBy("token", "n").agg(central).select("token", "n", "h.*").selectExpr(*_AS_HUB, "cast(null AS array<bigint>) AS hub_tokens")
    labels, first, number = None, None, FIRST_HUBS
    while True:
        hubs = settle(hubs, "minhash-hubs")
        found = settle(_confirmed(_starred(members, hubs), posted, sets), "minhash-links")
        if labels is None:
            labels = components(found)
        elif not found.isEmpty():
            labels = _joined(labels, found)
        still = settle(_open(settle(_left(members, hubs, labels), "minhash-left")), "minhash-open")
        if still.isEmpty():
            return labels
        if first is None:
            first = hubs
            still = settle(_beside(still, first, sets), "minhash-beside")
        members = settle(_listed(_open(_able(still.drop("tokens"), sets)), "cid", "tokens"), "minhash-able")
        if members.isEmpty():
            return labels
        hubs = _next_hubs(members, number)
        number *= MORE_HUBS


def _placed(docs: DataFrame) -> DataFrame:
    marks, classes = _classes(docs)
    labels = _linked(classes, docs)
    named = classes.select("cid", "key", "least").join(labels, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    # a component of one class is named by that class: only the others have to meet
    alone = named.join(labels.select("comp").distinct(), "comp", "left_anti").select("key", F.col("least").alias("first"))
    together = named.join(labels.select("comp").distinct(), "comp", "left_semi")
    first = together.groupBy("comp").agg(F.min("least").alias("first"))
    names = alone.unionByName(together.join(first, "comp").select("key", "first"))
    placed = marks.select("doc_id", "uid", "th", "key", "n_shingles").join(names, "key", "left")
    component = F.coalesce(F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("first")), F.col("doc_id"))
    named_by = F.coalesce(F.col("doc_id") == component, component.isNull())
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), named_by.alias("kept"), "uid", "th")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    return _placed(docs).drop("uid", "th")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, with their columns, that name their group: one of each group stays.

    A row is told by its id and its text, so of rows that share an id only those of a dropped text go.
    """
    gone = _placed(docs).filter("NOT kept").select(F.col("uid").alias("__uid"), F.col("th").alias("__th")).distinct()
    text = F.col("text").cast("string")
    return docs.join(gone, (_uid() == F.col("__uid")) & (F.xxhash64(text) == F.col("__th")), "left_anti")
