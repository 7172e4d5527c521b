import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import gam, rules
from tidemark.llm.queries import QUERIES
from tidemark.sources.tables import load_table

from .conftest import EDGES

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    """The base counts, word by word."""
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    seen, covered = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for starts in seen.values():
        if len(starts) > 1:
            covered |= {i + k for i in starts for k in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
        failed,
    )


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_counts_on_edges(spark, edges, no_labels):
    got = sorted(tuple(r) for r in rules.quality_rules(spark, edges, no_labels).select(*COUNTS).collect())
    assert got == sorted(base(text) for _, text, *_ in EDGES)


def test_without_labels_the_base_rule_decides(spark, edges, no_labels):
    rows = rules.quality_rules(spark, edges, no_labels).collect()
    assert all(r["kept"] != r["base_failed"] for r in rows)
    kept = rules.keep_good(edges, no_labels)
    assert kept.columns == edges.columns
    assert kept.count() == sum(r["kept"] for r in rows)


@pytest.mark.parametrize("make", [rules.quality_rules, lambda s, d, l: gam.classify(d, l)])
def test_empty_tables(spark, edges, no_labels, make):
    assert make(spark, edges.limit(0), no_labels).collect() == []


@tables
def test_base_counts_on_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in load_table(spark, SF, "documents").collect()}
    rows = QUERIES["op4_quality_rules"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in COUNTS) == base(texts[r["doc_id"]])


@tables
def test_rules_follow_the_labels(spark):
    judged = QUERIES["op4_quality_rules"](spark, SF).join(load_table(spark, SF, "labels"), "doc_id").filter("NOT base_failed")
    rows = judged.collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.98 * len(good)
    assert sum(bad) <= 0.2 * len(bad)


def test_a_list_is_learned_and_applied_in_order(spark):
    texts = [(i, ("word%d " % i + "other ") * 3 + ("### " * 12 if i % 4 == 0 else "plain text here ")) for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i, _ in texts], "doc_id long, quality int")
    found = rules.learn(docs, labels)
    assert found and all(c.feature in rules.FEATURES for rule in found for c in rule)
    verdicts = {r["doc_id"]: r["__rule"] for r in rules.judge(docs, found).collect()}
    assert all((verdicts[i] == 0) == (i % 4 != 0) for i, _ in texts)


@tables
def test_scores_of_the_held_out_fold(spark):
    labels = load_table(spark, SF, "labels")
    rows = gam.classify(load_table(spark, SF, "documents"), labels).join(labels, "doc_id").filter("held_out").collect()
    right = [r["predicted"] == r["quality"] for r in rows]
    assert sum(right) >= 0.97 * len(right)
    assert all(0 <= r["score"] <= 1 for r in rows)


@tables
def test_held_out_labels_change_nothing(spark):
    docs, labels = load_table(spark, SF, "documents"), load_table(spark, SF, "labels")
    turned = labels.withColumn("quality", F.when(gam.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (sorted((r["doc_id"], r["score"]) for r in gam.classify(docs, x).collect()) for x in (labels, turned))
    assert one == two


def test_gam_edges(spark, edges, no_labels):
    rows = gam.classify(edges, no_labels).collect()
    assert [r["score"] for r in rows] == [0.5] * len(EDGES)
    assert gam.keep_good(edges, no_labels).columns == edges.columns
    single = spark.createDataFrame([(2, 1, 0), (6, 1, 0), (2, 1, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert all(r["score"] > 0.5 for r in gam.classify(edges, single).collect())


def test_pairs_learn_what_features_alone_cannot():
    rng = np.random.default_rng(5)
    a, b = rng.random(4000), rng.random(4000)
    labels = ((a > 0.5) ^ (b > 0.5)).astype(float)
    model = gam.fit([a, b], labels)
    assert ((model.score([a, b]) > 0.5) == labels).mean() > 0.95
