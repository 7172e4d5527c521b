"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text (``textstats.FEATURES``) is cut into bins. Cyclic boosting fits one small tree
at a time on the residual, feature by feature, and adds its leaves to that feature's table; pairs of
features that still explain residual then get tables over two cut axes in the same way. A score is the
sum of one table entry per feature and per pair, taken for a whole Arrow batch at once.

The model is fitted on a bounded sample of labelled rows (``labelled.SAMPLE_ROWS``) that are not held
out; features and scores cover all rows. A row is held out when the crc32 of its id as text is 0
modulo 5; a row without an id counts as one with the empty text for an id.

Edge cases: null texts count as empty and get the score of an empty text; without labels the score
is 0.5 everywhere, with one class only it is that class's smoothed share; repeated rows get equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import labelled
from tidemark.llm.textstats import FEATURES, features, with_counts

BINS, PAIR_BINS, PAIRS = 48, 12, 6
ROUNDS, RATE, SMOOTH, LEAST_ROWS = 120, 0.12, 2.0, 15
THRESHOLD = 0.3
FOLDS = 5


@dataclass(frozen=True)
class Gam:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, columns: list[np.ndarray]) -> np.ndarray:
        """Probability of label 1, one table lookup per feature and pair."""
        total = np.full(len(columns[0]), self.intercept)
        for values, edges, table in zip(columns, self.edges, self.tables, strict=True):
            total += table[np.searchsorted(edges, values, side="right")]
        for i, j, cut_i, cut_j, table in self.pairs:
            total += table[
                np.searchsorted(cut_i, columns[i], side="right"), np.searchsorted(cut_j, columns[j], side="right")
            ]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def _step(grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    return grad / (hess + SMOOTH)


def _gain(grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    return grad * grad / (hess + SMOOTH)


def _cut(grad: np.ndarray, hess: np.ndarray, rows: np.ndarray) -> int:
    """Bins left of the best cut, or 0."""
    g, h, n = grad.cumsum()[:-1], hess.cumsum()[:-1], rows.cumsum()[:-1]
    gains = _gain(g, h) + _gain(grad.sum() - g, hess.sum() - h)
    gains[(n < LEAST_ROWS) | (rows.sum() - n < LEAST_ROWS)] = -1
    if not len(gains) or gains.max() <= _gain(grad.sum(), hess.sum()) + 1e-9:
        return 0
    return int(gains.argmax()) + 1


def _leaves(at: np.ndarray, size: int, grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    """A tree of at most four leaves on one binned feature: two levels of cuts."""
    g, h, n = (np.bincount(at, w, size) for w in (grad, hess, None))
    out = np.zeros(size)
    first = _cut(g, h, n)
    for low, high in ((0, first), (first, size)) if first else ((0, size),):
        second = low + _cut(g[low:high], h[low:high], n[low:high])
        for a, b in ((low, second), (second, high)) if second > low else ((low, high),):
            out[a:b] = _step(g[a:b].sum(), h[a:b].sum())
    return RATE * out


def _quarters(at: np.ndarray, shape: tuple[int, int], grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, float]:
    """The best tree that cuts two binned features once each, and its gain."""
    size = shape[0] * shape[1]
    g, h, n = (np.bincount(at, w, size).reshape(shape).cumsum(0).cumsum(1) for w in (grad, hess, None))
    if min(shape) < 2:
        return np.zeros(shape), 0.0

    def parts(c: np.ndarray) -> list[np.ndarray]:
        inner, right, low, every = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return [inner, right - inner, low - inner, every - right - low + inner]

    gg, hh, nn = parts(g), parts(h), parts(n)
    gains = sum(_gain(x, y) for x, y in zip(gg, hh, strict=True)) - _gain(g[-1, -1], h[-1, -1])
    gains = np.where(np.minimum.reduce(nn) >= 1, gains, 0)
    i, j = np.unravel_index(gains.argmax(), gains.shape)
    out = np.zeros(shape)
    if gains[i, j] <= 0:
        return out, 0.0
    leaf = [RATE * _step(x[i, j], y[i, j]) for x, y in zip(gg, hh, strict=True)]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return out, float(gains[i, j])


def fit(columns: list[np.ndarray], labels: np.ndarray) -> Gam:
    """Boost the tables on a sample of labelled rows."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    intercept = float(np.log(share / (1 - share)))
    edges = [_edges(c, BINS) if len(c) else np.empty(0) for c in columns]
    tables = [np.zeros(len(e) + 1) for e in edges]
    if len(np.unique(labels)) < 2:
        return Gam(intercept, edges, tables, [])
    at = [np.searchsorted(e, c, side="right") for e, c in zip(edges, columns, strict=True)]
    total = np.full(len(labels), intercept)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return labels - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, table in enumerate(tables):
            leaves = _leaves(at[f], len(table), *residual())
            table += leaves
            total += leaves[at[f]]
    cuts = [_edges(c, PAIR_BINS) for c in columns]
    near = [np.searchsorted(e, c, side="right") for e, c in zip(cuts, columns, strict=True)]
    found = []
    for i, j in combinations(range(len(columns)), 2):
        shape = (len(cuts[i]) + 1, len(cuts[j]) + 1)
        found.append((_quarters(near[i] * shape[1] + near[j], shape, *residual())[1], i, j, shape))
    chosen = [(i, j, shape, np.zeros(shape)) for gain, i, j, shape in sorted(found, reverse=True)[:PAIRS] if gain > 0]
    for _ in range(ROUNDS // 2):
        for i, j, shape, table in chosen:
            leaves, _ = _quarters(near[i] * shape[1] + near[j], shape, *residual())
            table += leaves
            total += leaves[near[i], near[j]]
    return Gam(intercept, edges, tables, [(i, j, cuts[i], cuts[j], t) for i, j, _, t in chosen])


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, rows: int = labelled.SAMPLE_ROWS) -> Gam:
    """Fit on at most ``rows`` labelled rows outside the held-out fold; they alone reach the driver."""
    known = labelled.labelled(
        docs.select("doc_id", "text"), labelled.sample(labels.filter(~held_out()), "quality", rows)
    )
    named = [value.alias(name) for name, value in features(F.col("__s")).items()]
    # repeated rows of an id could exceed the bound
    sample = with_counts(known).select("doc_id", F.col("__label").alias("label"), *named).orderBy("doc_id").limit(rows)
    got = sample.toPandas()
    return fit([got[name].to_numpy(np.float64) for name in FEATURES], got["label"].to_numpy(np.float64))


def scored(docs: DataFrame, model: Gam) -> DataFrame:
    """``docs`` with ``__score``. Counting stays in the JVM; only the features of a row go to Python."""

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(model.score([c.to_numpy(np.float64) for c in columns]))

    # marked so that a filter on the score is not pushed below the counting, where it would be worked out twice
    once = score.asNondeterministic()
    counted = with_counts(docs)
    return counted.withColumn("__score", once(*features(F.col("__s")).values()))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = scored(docs.select("doc_id", "text"), train(docs, labels))
    return rows.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with their columns, that the classifier takes for good."""
    rows = scored(docs, train(docs, labels))
    return rows.filter(F.col("__score") >= THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])
