import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ranked_search

from .conftest import EDGES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, items, top=50):
    """Every document's score for every item, in whole numbers."""
    kept = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(kept), sum(n for _, _, n in kept)
    df = Counter(t for _, c, _ in kept for t in c)
    out = []
    for item, text in items:
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(terms(text)) if df[t]}
        scored = []
        for doc_id, counts, n in kept:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            score = sum(w * ((10**9 * counts[t]) // (1000 * counts[t] + 20 * m)) for t, w in weights.items() if counts[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, rank, doc_id, -score) for rank, (score, _, _, doc_id) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def run(spark, docs, items):
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, ranked_search.search(*frames).collect()), key=str)


@pytest.fixture(scope="module")
def random_rows():
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in "AeIoU"]
    pick = lambda n: " ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(40)], k=n))
    docs = [(i, pick(rng.randrange(1, 150))) for i in range(700)]
    docs += [(1000 + i, docs[3][1]) for i in range(180)] + [(2000 + i, docs[i][1] + ".") for i in range(60)]
    return docs, [(i, pick(12)) for i in range(9)] + [(3, "ae ae AI")]


def test_random_rows_with_copies(spark, random_rows):
    assert run(spark, *random_rows) == brute(*random_rows)


def test_many_rounds_and_blocks(spark, random_rows, monkeypatch):
    """Sketches that tell little and small rounds: more of them, the same rows."""
    for name, value in {"FIRST": 3, "ROOM": 1, "NARROWEST": 4, "BLOCK_TERMS": 20, "LOOKUP_ROWS": 7}.items():
        monkeypatch.setattr(ranked_search, name, value)
    docs, items = random_rows
    assert run(spark, docs[:300] + docs[-20:], items) == brute(docs[:300] + docs[-20:], items)


def test_no_text_is_shuffled_to_meet_candidates(spark, monkeypatch):
    """Whatever the session's threshold; beyond the rows that are broadcast the rows are the same."""
    docs = [(i, f"word{i % 7} word{i % 5} {i}") for i in range(300)] + [(3, "word3 another"), (None, "word3")]
    items = [(1, "word3 word4"), (2, "word1 7")]
    plans = []
    scored = ranked_search._scored

    def noted(*args):
        found = scored(*args)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(ranked_search, "_scored", noted)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
        assert run(spark, docs, items) == brute(docs, items)
        assert plans and all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in plans)
        plans.clear()
        monkeypatch.setattr(ranked_search, "BROADCAST_ROWS", 0)
        assert run(spark, docs, items) == brute(docs, items)
        assert plans and all("SortMergeJoin" in p for p in plans)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_edges(spark, edges):
    docs = [(i, t) for i, t, *_ in EDGES]
    items = [(1, "A b ONE"), (1, "word two"), (2, None), (3, "!?"), (None, "é ß x"), (4, "nowhere"), (4, "l")]
    frame = spark.createDataFrame([(*i, 1, b"x") for i in items], "item_id long, text string, item int, term binary")
    clash = edges.withColumn("kind", F.lit("doc")).withColumn("n", F.lit(3))
    assert sorted(map(tuple, ranked_search.search(clash, frame).collect()), key=str) == brute(docs, items)
    assert ranked_search.search(edges.limit(0), frame).collect() == []
    assert ranked_search.search(edges, frame.limit(0)).collect() == []


def test_bounds_hold_and_are_close():
    rng = np.random.default_rng(1)
    words = [f"w{i}".encode() for i in range(3000)]
    texts = [Counter(words[int(i)] for i in rng.zipf(1.3, 400) % 3000) for _ in range(200)]
    listed = [sorted({words[int(i)] for i in rng.integers(0, 3000, 30)}) for _ in range(10)]
    queries = ranked_search.Queries([(q, words, [5000] * len(words)) for q, words in enumerate(listed)])
    slack = []
    for counts in texts:
        codes = np.frombuffer(ranked_search.sketch(counts), np.uint8)[None, :]
        bounds = queries.bounds(codes, np.array([70]))[:, 0]
        scores = [queries.score(q, counts, 70) for q in range(10)]
        assert (bounds >= scores).all()
        slack.append((bounds - scores).mean())
    # a term that occurs once is worth some 2e9 here
    assert np.mean(slack) < 2e9
    levels = ranked_search.LEVELS
    assert len(levels) == 256 and (np.diff(levels) > 0).all() and levels[128] == 128
    big = Counter({b"a": 10**6, b"b": 129})
    codes = np.frombuffer(ranked_search.sketch(big), np.uint8)
    assert levels[codes.max()] >= 10**6 and (levels[codes[codes > 0]] >= 129).all()
