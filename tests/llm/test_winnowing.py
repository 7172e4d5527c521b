import hashlib
import random
import re
import sys
from collections import defaultdict

from pyspark.sql import functions as F

from tidemark.llm import winnowing

from .conftest import EDGES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items):
    """Every window of every item against every place of every document."""
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - 9, 1) if w else 0):
            windows[tuple(w[i : i + 10])].add("" if item is None else str(item))
    sizes = {len(win) for win in windows}
    out = []
    for doc_id, text in docs:
        w, hit, met = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    met |= found
        out.append((doc_id, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items):
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, winnowing.digests(winnowing.contaminated(*frames)).collect()), key=str)


def test_random_texts_with_few_words(spark):
    """Few different words: many equal grams, ties, overlapping and repeated hits."""
    rng = random.Random(5)
    text = lambda n, kinds: " ".join(rng.choice("aBcDeFgh"[:kinds]) for _ in range(n))
    docs = [(i, text(rng.randrange(120), rng.choice([1, 2, 3, 5]))) for i in range(150)]
    long = [(i % 9, text(rng.randrange(10, 40), rng.choice([1, 2, 3, 5]))) for i in range(20)]
    short = [(10 + i, text(rng.randrange(0, 10), 3)) for i in range(12)]
    planted = [(20 + i, " ".join(docs[i][1].split()[3 : 13 + i % 4])) for i in range(30)]
    for items in (long, long + short + planted, planted):
        expected = brute(docs, items)
        assert run(spark, docs, items) == expected and any(row[5] for row in expected)


def test_edges(spark, edges):
    docs = [(i, t) for i, t, *_ in EDGES]
    items = [(1, EDGES[0][1]), (1, "漢字 🙂 é ß 漢字 🙂 é ß 漢字 🙂 é"), (2, None), (3, ""), (None, "One, two"), (100, "word " * 12), (None, None)]
    expected = brute(docs, items)
    assert run(spark, docs, items) == expected and sum(row[5] for row in expected) == 8
    wide = spark.createDataFrame([(*i, 1, "x") for i in items], "item_id long, text string, h long, around string")
    clash = edges.withColumn("h", F.lit(1)).withColumn("item", F.lit("x")).withColumn("w", F.lit(2))
    assert sorted(map(tuple, winnowing.digests(winnowing.contaminated(clash, wide)).collect()), key=str) == expected
    assert winnowing.contaminated(edges.limit(0), wide).collect() == []
    assert winnowing.contaminated(edges, wide.limit(0)).filter("size(spans) > 0").count() == 0


def test_spans_and_items(spark):
    docs = spark.createDataFrame([(1, "x a b c d e f g h i j k y " * 2)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c d e f g h i j k l"), (8, "k y x a b")], "item_id long, text string")
    (row,) = winnowing.contaminated(docs, items).collect()
    assert [tuple(s) for s in row["spans"]] == [(1, 25)] and row["items"] == ["7", "8"]


def test_no_broadcast_gives_the_same(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice("ab") for _ in range(60))) for i in range(40)]
    items = [(i, " ".join(rng.choice("ab") for _ in range(14))) for i in range(30)]
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert run(spark, docs, items) == brute(docs, items)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_only_a_to_z_are_lowered(spark):
    texts = ["".join(map(chr, [*range(k, min(k + 50, 0xD800))])) for k in range(1, 0xD800, 50)]
    texts += ["".join(map(chr, range(k, k + 50))) for k in range(0xE000, sys.maxunicode - 50, 50) if k < 0x20000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", winnowing.lowered(F.col("t")).alias("t"))
    assert {r["i"]: r["t"] for r in rows.collect()} == {i: t.translate(LOWER) for i, t in enumerate(texts)}


def test_long_text_without_an_end(spark):
    text = " ".join(f"w{i}" for i in range(300_000))
    items = [(1, "w150000 w150001 w150002 w150003 w150004 w150005 w150006 w150007 w150008 w150009")]
    assert [row[1:4] for row in run(spark, [(1, text)], items)] == [(300_000, 10, 1)]
