"""Quality rules: a decision list learned by sequential covering, emitted as Spark expressions.

A rule is a conjunction of thresholds on statistics of the text (``textstats.FEATURES``). Rules are
grown on two thirds of a bounded labelled sample, one condition at a time by information gain, then
pruned on the last third, condition by condition from the end, and kept while they are precise. Rows
that a rule covers are set aside before the next one is grown. Learning needs only counts by
(feature, bin, label), which one small aggregation a step yields; the result is an ordered CASE.

Edge cases: null text counts as empty and fails the base rule; without labels, or with one class
only, the list is empty and the base rule alone decides; repeated rows get the same verdict each;
columns of the input that clash with helper names are not touched, since helpers start with ``__``.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import labelled
from tidemark.llm.textstats import FEATURES, features, with_counts
from tidemark.sources.workspace import settle

BINS = 24
MAX_RULES = 8
MAX_CONDITIONS = 3
#: Least share of rejected rows that are labelled bad, and least number of them, on either part.
MIN_PRECISION = 0.9
MIN_COVERED = 4


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    bin: int
    threshold: float

    def on(self, value: Column) -> Column:
        return value >= F.lit(self.threshold) if self.at_least else value < F.lit(self.threshold)

    def on_bin(self, value: Column) -> Column:
        return value >= self.bin if self.at_least else value < self.bin

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _thresholds(sample: DataFrame) -> dict[str, list[float]]:
    """Quantiles of each feature, of good and bad rows apart, so that rare values get bounds too."""
    points = [(k + 0.5) / BINS for k in range(BINS)]
    rows = (
        sample.groupBy("label")
        .agg(*[F.percentile_approx(name, points, 1000).alias(name) for name in FEATURES])
        .collect()
    )
    return {name: sorted({v for row in rows for v in row[name] if v is not None}) for name in FEATURES}


def _bin(value: Column, thresholds: list[float]) -> Column:
    """How many of the thresholds the value reaches."""
    return F.size(F.filter(F.array(*map(F.lit, thresholds)), lambda t: value >= t))


def _counts(rows: DataFrame) -> dict[tuple[str, int, int], int]:
    """Rows by (feature, bin, label): at most features x bins x 2 numbers."""
    pairs = F.array(*[F.struct(F.lit(name).alias("feature"), F.col(name).alias("bin")) for name in FEATURES])
    counted = rows.select("label", F.inline(pairs)).groupBy("feature", "bin", "label").count()
    return {(r["feature"], r["bin"], r["label"]): r["count"] for r in counted.collect()}


def _best(counts: dict, thresholds: dict[str, list[float]], have: Rule) -> tuple[Condition | None, int, int]:
    """The condition of largest gain, with the bad and good rows it would leave."""
    by_feature: dict[str, dict[int, list[int]]] = defaultdict(lambda: defaultdict(lambda: [0, 0]))
    for (name, at, label), n in counts.items():
        by_feature[name][at][label] += n
    total = [sum(v[k] for v in by_feature[FEATURES[0]].values()) for k in (0, 1)]
    best, best_gain, left = None, 1e-9, (total[0], total[1])
    if not total[0]:
        return None, 0, total[1]
    base = math.log2(total[0] / (total[0] + total[1]))
    for name in FEATURES:
        bad = good = 0
        for k, threshold in enumerate(thresholds[name], start=1):
            below = by_feature[name].get(k - 1, [0, 0])
            bad, good = bad + below[0], good + below[1]
            for at_least, p, n in ((True, total[0] - bad, total[1] - good), (False, bad, good)):
                if p < MIN_COVERED:
                    continue
                gain = p * (math.log2(p / (p + n)) - base)
                condition = Condition(name, at_least, k, threshold)
                if gain > best_gain and condition not in have:
                    best, best_gain, left = condition, gain, (p, n)
    return best, *left


def _both(rule: Rule) -> Column:
    return reduce(Column.__and__, [c.on_bin(F.col(c.feature)) for c in rule], F.lit(True))


def _pruned(rule: Rule, held: DataFrame) -> Rule | None:
    """The prefix of the rule that is best on rows it was not grown on; None if none is precise."""
    sums = []
    for k in range(1, len(rule) + 1):
        covers = _both(rule[:k])
        sums += [F.count_if(covers & (F.col("label") == v)).alias(f"n{k}_{v}") for v in (0, 1)]
    row = held.agg(*sums).first()
    scored = []
    for k in range(1, len(rule) + 1):
        bad, good = row[f"n{k}_0"], row[f"n{k}_1"]
        if bad >= MIN_COVERED and bad >= MIN_PRECISION * (bad + good):
            scored.append(((bad - good) / (bad + good), bad, -k))
    return rule[: -max(scored)[2]] if scored else None


def learn(docs: DataFrame, labels: DataFrame, rows: int = labelled.SAMPLE_ROWS) -> list[Rule]:
    """An ordered list of rules for bad texts (label 0), from at most ``rows`` labelled documents."""
    known = labelled.labelled(docs.select("doc_id", "text"), labelled.sample(labels, "quality", rows))
    counted = with_counts(known)
    stats = settle(
        counted.select("doc_id", F.col("__label").alias("label"), *_named(F.col("__s"))).filter(F.col("label").isin(0, 1)),
        "rule-statistics",
    )
    thresholds = _thresholds(stats)
    if not any(thresholds.values()):
        return []
    binned = [_bin(F.col(name), thresholds[name]).alias(name) for name in FEATURES]
    bins = settle(
        stats.select("label", (F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3)) == 0).alias("held"), *binned)
        .coalesce(1),
        "rule-bins",
    )
    found: list[Rule] = []
    while len(found) < MAX_RULES:
        free = reduce(Column.__and__, [~_both(r) for r in found], F.lit(True))
        grow, held = bins.filter(free & ~F.col("held")), bins.filter(free & F.col("held"))
        rule: Rule = ()
        while len(rule) < MAX_CONDITIONS:
            condition, _, good = _best(_counts(grow.filter(_both(rule))), thresholds, rule)
            if condition is None:
                break
            rule += (condition,)
            if not good:
                break
        kept = _pruned(rule, held) if rule else None
        if kept is None:
            break
        found.append(kept)
    return found


def _named(s: Column) -> list[Column]:
    return [value.alias(name) for name, value in features(s).items()]


def verdict(rules: list[Rule], s: Column) -> Column:
    """Number of the first rule that covers a row (from 1), or 0: an ordered conditional expression."""
    values = features(s)
    chain = None
    for number, rule in enumerate(rules, start=1):
        covers = reduce(Column.__and__, [c.on(values[c.feature]) for c in rule])
        chain = F.when(covers, number) if chain is None else chain.when(covers, number)
    return F.lit(0) if chain is None else chain.otherwise(0)


def base_failed(s: Column) -> Column:
    """Too few words, or more than a fifth of them in repeated windows."""
    of = s.w.of
    return (of.n_words < 10) | (100 * of.n_repeat_words > 20 * of.n_words)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` with ``__s``, ``__base_failed`` and ``__rule``; no shuffle."""
    counted = with_counts(docs)
    s = F.col("__s")
    return counted.withColumn("__base_failed", base_failed(s)).withColumn("__rule", verdict(rules, s))


def quality_rules(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: the base counts, both verdicts and the rule that decided."""
    judged = judge(docs.select("doc_id", "text"), learn(docs, labels))
    s = F.col("__s")
    return judged.select(
        "doc_id",
        s.w.of.n_words.alias("n_words"),
        s.w.word_chars.alias("word_chars"),
        s.m.n_symbols.alias("n_symbols"),
        s.l.n_dup_lines.alias("n_dup_lines"),
        s.w.of.n_repeat_words.alias("n_repeat_words"),
        F.col("__base_failed").alias("base_failed"),
        (~F.col("__base_failed") & (F.col("__rule") == 0)).alias("kept"),
        F.col("__rule").alias("rule"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with their columns, that neither the base rule nor the list rejects."""
    judged = judge(docs, learn(docs, labels))
    return judged.filter(~F.col("__base_failed") & (F.col("__rule") == 0)).select(*[F.col(f"`{c}`") for c in docs.columns])
