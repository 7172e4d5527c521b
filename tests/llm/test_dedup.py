import hashlib
import os
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, minhash, shingles
from tidemark.llm.queries import QUERIES
from tidemark.sources.tables import load_table

from .conftest import EDGES

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def norm(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\f\r")


def exact(rows):
    """(doc_id, keep_id, group_size, sha) of each row, by groups of equal texts."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[norm(text)].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    return sorted(
        (
            (doc_id, min(groups[norm(t)])[3], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest())
            for doc_id, t in rows
        ),
        key=str,
    )


def rows_of(frame):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in frame.collect()), key=str)


def test_exact_edges(edges):
    got = exact_dedup.exact_dedup(edges)
    assert rows_of(got) == exact([(i, t) for i, t, *_ in EDGES])
    assert got.filter("kept").count() == len({norm(t) for _, t, *_ in EDGES})
    kept = exact_dedup.keep_first(edges)
    assert kept.columns == edges.columns and kept.count() == len({norm(t) for _, t, *_ in EDGES})


def test_exact_empty(edges):
    assert exact_dedup.exact_dedup(edges.limit(0)).collect() == []


def test_a_hit_is_decided_by_the_bytes(spark, edges):
    """With a digest that collides all the time, the groups are still those of equal texts."""
    weak = exact_dedup.deduplicate(edges, digest=lambda n: F.length(n).cast("string"))
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in weak.collect()), key=str)
    assert got == sorted(((i, k, n) for i, k, n, _ in exact([(i, t) for i, t, *_ in EDGES])), key=str)


def test_state_carries_over_micro_batches(spark):
    texts = [(i, f"text number {i % 7}" + " " * (i % 3)) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    many = exact_dedup.deduplicate(docs, batch_bytes=1).select("doc_id", "keep_id", "group_size", F.col("digest").alias("text_sha256"))
    assert rows_of(many) == exact(texts)


def test_the_state_is_read_once(edges):
    """Each read opens the stores of all partitions, in native memory of the executors."""
    plan = exact_dedup.keep_first(edges)._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" not in plan and "FileScan" in plan


@tables
def test_stored_settings_come_back(spark):
    before = {key: spark.conf.get(key, None) for key in exact_dedup._STREAM}
    QUERIES["op7_exact_dedup"](spark, SF)
    assert {key: spark.conf.get(key, None) for key in exact_dedup._STREAM} == before


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def near(rows):
    """(doc_id, n_shingles, component_id) by comparing every pair that shares a shingle; ids are unique."""
    sets, parent, holders = {i: shingle_set(t) for i, t in rows}, {i: i for i, _ in rows}, defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        shared = defaultdict(int)
        for gram in s:
            for j in holders[gram]:
                shared[j] += 1
            holders[gram].append(i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def near_rows(frame):
    got = frame.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got)


@tables
def test_near_against_all_pairs(spark):
    texts = [(r["doc_id"], r["text"]) for r in load_table(spark, SF, "documents").collect()]
    assert near_rows(QUERIES["op1_minhash_near_dedup"](spark, SF)) == near(texts)


def drifting(n, words=60):
    """Texts of which each is close to the next and the ends have nothing in common."""
    return [(i, " ".join(f"w{k}" for k in range(i * 2, i * 2 + words))) for i in range(n)]


def test_near_chains_and_hubs(spark, monkeypatch):
    """Long lists are worked off by hubs: rounds with one hub at a time give the same classes."""
    monkeypatch.setattr(minhash, "FIRST_HUBS", 1)
    monkeypatch.setattr(minhash, "MORE_HUBS", 2)
    monkeypatch.setattr(minhash, "SPLIT_ROWS", 3)
    common = " ".join(f"c{k}" for k in range(40))
    mixed = [(1000 + i, f"{common} " + " ".join(f"u{i}x{k}" for k in range(30 - i % 3))) for i in range(25)]
    copies = [(2000 + i, " ".join(f"z{k}" for k in range(80) if k != i)) for i in range(30)]
    texts = drifting(20) + mixed + copies
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert near_rows(minhash.near_duplicates(docs)) == near(texts)


def test_a_hub_leaves_the_lists_it_has_met(spark, monkeypatch):
    """No list is read with a class that it was compared with in an earlier round, and each round leaves such out once."""
    monkeypatch.setattr(minhash, "FIRST_HUBS", 1)
    monkeypatch.setattr(minhash, "MORE_HUBS", 2)
    rounds, starred, frames = [], minhash._starred, []

    def watched(members, hubs):
        rounds.append(({tuple(r) for r in members.select("token", "cid").collect()}, {tuple(r) for r in hubs.select("token", "hub").collect()}))
        return starred(members, hubs)

    def kept(frame, label, settle=minhash.settle):
        frames.append(frame)
        return settle(frame, label)

    monkeypatch.setattr(minhash, "_starred", watched)
    monkeypatch.setattr(minhash, "settle", kept)
    # blocks of words in one of two wordings: all shingles occur elsewhere, and many pairs are just below the threshold
    random = np.random.default_rng(5)
    wording = random.random((40, 16)) < 0.15
    texts = [(i, " ".join(f"{'xy'[int(w)]}{b}w{k}" for b, w in enumerate(row) for k in range(12))) for i, row in enumerate(wording)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert near_rows(minhash.near_duplicates(docs)) == near(texts)
    assert len(rounds) > 2
    met = set()
    for members, hubs in rounds:
        assert hubs <= members and not met & members
        met |= hubs
    plans = [frame._jdf.queryExecution().optimizedPlan().toString() for frame in frames]
    assert sum(plan.count("Join LeftAnti, ((token") for plan in plans) == len(rounds)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (502, 500)], "a long, b long")
    groups = defaultdict(set)
    for r in minhash.components(edges).collect():
        groups[r["comp"]].add(r["cid"])
    assert sorted(map(sorted, groups.values())) == [list(range(201)), [500, 501, 502]]


def test_near_edges(edges):
    got = minhash.near_duplicates(edges).collect()
    assert len(got) == len(EDGES)
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by_id[1] == [(8, 1, True)] * 2 and by_id[2] == [(8, 1, False)]
    assert by_id[3] == by_id[3] and by_id[3] == [(0, 3, True)] and by_id[4] == [(0, 4, True)] and by_id[5] == [(0, 5, True)]
    assert by_id[6] == [(1, 6, True)] and by_id[7] == [(1, 6, False)]
    # 8 of 9 shingles are shared; a row without an id does not name a group with others in it
    assert sorted(by_id[None], key=str) == [(0, None, True), (9, 1, False)]
    assert minhash.near_duplicates(edges.limit(0)).collect() == []
    kept = minhash.keep_one(edges)
    assert kept.columns == edges.columns and kept.count() == sum(r["kept"] for r in got)


def test_shingle_hashes_tell_sequences_apart():
    split = [b"a b c d e".split(), b"a b c d".split(), b"d c b a".split(), b"e d c b a".split(), b"a".split(), []]
    grams, at = shingles.hashed(split)
    assert len(set(grams.tolist())) == 5 and at.tolist() == [0, 1, 2, 3, 4, 5, 5]


@pytest.mark.parametrize("count", range(7))
def test_shingles_of_a_few_words_in_all(count):
    words = [b"%d" % i for i in range(count)]
    for split in ([words], [[w] for w in words], [words[:1], [], words[1:]]):
        grams, at = shingles.hashed(split)
        expected = [max(len(w) - shingles.SIZE + 1, 1) if w else 0 for w in split]
        assert np.diff(at).tolist() == expected and len(grams) == sum(expected)


def test_a_table_of_one_short_text(spark):
    for count in range(1, 6):
        docs = spark.createDataFrame([(1, " ".join("abcde"[:count]))], "doc_id long, text string")
        assert [(r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()] == [(1, 1)]


def test_rows_that_share_an_id_go_by_their_text(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(0, a), (1, a), (1, b)], "doc_id long, text string")
    assert sorted(map(tuple, minhash.keep_one(docs).collect())) == [(0, a), (1, b)]


def test_components_of_many_rounds(spark):
    """Chains, stars and links that join components of earlier rounds."""
    first = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)]
    later = [(40, 100), (200, 201), (129, 201)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    labels = minhash._joined(minhash.components(frame(first)), frame(later))
    rows = labels.collect()
    assert len(rows) == 73 and len({r["comp"] for r in rows}) == 1
