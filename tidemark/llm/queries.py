"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import (
    alignment,
    backoff,
    byte_bpe,
    exact_dedup,
    gam,
    html_text,
    licences,
    minhash,
    packing,
    ranked_search,
    rules,
    warc,
    winnowing,
)
from tidemark.sources.tables import load_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


@_query
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(load_table(spark, sf_dir, "documents"))


@_query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(spark, load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "labels"))


@_query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(load_table(spark, sf_dir, "documents"))


# the window sorts whole groups; it serves to check, not to scale
ORACLES["op7_exact_dedup"] = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
ranked AS (
  SELECT doc_id, sha256(norm) AS text_sha256, count(*) OVER (PARTITION BY norm) AS group_size,
    first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(raw) DESC, doc_id) AS keep_id FROM texts)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked"""


@_query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.round_trip(load_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@_query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.best_fit_packing(load_table(spark, sf_dir, "documents"), path)


@_query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.classify(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "labels"))


@_query
def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(load_table(spark, sf_dir, "pages"))


#: The pages have no capture date of their own: one is given as the time of the crawl.
CAPTURED = "2024-01-01T00:00:00Z"


@_query
def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(load_table(spark, sf_dir, "pages"), CAPTURED)


@_query
def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(load_table(spark, sf_dir, "documents"))


@_query
def op2_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.scores(load_table(spark, sf_dir, "documents"))


ORACLES["op2_stupid_backoff"] = backoff.oracle()


@_query
def op2_stupid_backoff_order3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With counts of three words too; the SQL twin above knows pairs only, and stays as it is."""
    return backoff.scores(load_table(spark, sf_dir, "documents"), order=3)


@_query
def op11_max_sketch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "benchmark"))


ORACLES["op11_max_sketch_search"] = ranked_search.oracle()


@_query
def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = winnowing.contaminated(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "benchmark"))
    return winnowing.digests(hits)


ORACLES["op12_winnowing"] = winnowing.oracle()


@_query
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(load_table(spark, sf_dir, "documents"), *paths)
