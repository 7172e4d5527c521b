import os

import pytest

import corpus_pipeline
from tidemark.llm import gam, rules
from tidemark.sources.tables import load_table
from tidemark.sources.workspace import settle

from .test_dedup import exact, near
from .test_text_operators import checked

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def texts(frame):
    return sorted((r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect())


def test_stages_against_plain_versions(spark):
    docs = load_table(spark, SF, "documents")
    labels = load_table(spark, SF, "labels")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, settle(stage(spark, docs, SF), f"test-{name}")
        out[name] = (before, docs)
        if name != "best_fit_packing":
            assert docs.columns == before.columns
    before, after = out["quality_rules"]
    kept = {r["doc_id"] for r in rules.quality_rules(spark, before, labels).filter("kept").collect()}
    assert {i for i, _ in texts(after)} == kept
    before, after = out["quality_classifier"]
    good = {r["doc_id"] for r in gam.classify(before, labels).filter("predicted = 1").collect()}
    assert {i for i, _ in texts(after)} == good
    before, after = out["exact_duplicates"]
    assert {i for i, _ in texts(after)} == {keep for _, keep, *_ in exact(texts(before))}
    before, after = out["near_duplicates"]
    assert {i for i, _ in texts(after)} == {component for _, _, component in near(texts(before))}
    before, after = out["best_fit_packing"]
    rows = after.collect()
    assert {r["doc_id"] for r in rows} == {i for i, _ in texts(before)}
    assert checked(rows, 1024) >= sum(r["length"] for r in rows) / 1024
    ran = corpus_pipeline.run(spark, SF)
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in ran.collect()) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows)
