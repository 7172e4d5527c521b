"""Counts over whole texts as built-in column expressions, shared by the quality rules and the classifier.

Everything is worked out inside the row: no text is exploded or shuffled. A value that a lambda reads
again and again is bound first (``let``), since an expression inside a lambda is otherwise worked out
anew for each element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
_SPACE_RUN = r"[\x20\x09-\x0D]+"
WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: The characters of which some kind is counted: the text is cut down to them once.
_MARKS = SYMBOLS + "A-Z0-9!"

#: Ratios and counts that rules and models may look at, in this order.
FEATURES = [
    "n_words",
    "mean_word",
    "symbol_share",
    "upper_share",
    "digit_share",
    "bang_share",
    "bar_share",
    "repeat_share",
    "dup_line_share",
    "distinct_share",
    "line_words",
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space, as an array."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE_RUN))


def counted(text: Column, characters: str) -> Column:
    """Number of code points of ``text`` that are in the class ``characters``."""
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, f"[{characters}]+", ""))).cast("bigint")


def _windows(hashes: Column) -> Column:
    """One 64-bit hash for each window of five words."""
    n = F.size(hashes) - (WINDOW - 1)
    shifted = [F.slice(hashes, F.lit(k + 1), n) for k in range(WINDOW)]
    return F.transform(F.arrays_zip(*shifted), lambda w: F.xxhash64(w))


def _covered(windows: Column) -> Column:
    """Words that lie in a window whose hash occurs at least twice; sorting keeps it n log n."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def count(pairs: Column) -> Column:
        same = lambda p, i: p.h.eqNullSafe(F.get(pairs, i).h)
        twice = F.filter(
            pairs, lambda p, i: F.when(i > 0, same(p, i - 1)).otherwise(F.lit(False)) | same(p, i + 1)
        )
        starts = F.sort_array(F.transform(twice, lambda p: p.i))
        zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("n"))
        step = lambda s, i: F.struct(i.alias("last"), (s.n + F.least(F.lit(WINDOW), i - s.last)).alias("n"))
        return F.aggregate(starts, zero, step, lambda s: s.n)

    return let(placed, count)


def repeated_words(hashes: Column) -> Column:
    """Words in five-word windows found twice or more in the text, the first one included."""

    def count(windows: Column) -> Column:
        single = F.size(F.array_distinct(windows)) == F.size(windows)
        return F.when(single, F.lit(0).cast("bigint")).otherwise(_covered(windows))

    return F.when(F.size(hashes) <= WINDOW, F.lit(0).cast("bigint")).otherwise(let(_windows(hashes), count))


def _of_hashes(hashes: Column) -> Column:
    return F.struct(
        F.size(hashes).cast("bigint").alias("n_words"),
        repeated_words(hashes).alias("n_repeat_words"),
        F.size(F.array_distinct(hashes)).cast("bigint").alias("n_distinct"),
    )


def _of_words(split: Column) -> Column:
    return F.struct(
        let(F.transform(split, lambda w: F.xxhash64(w)), _of_hashes).alias("of"),
        F.char_length(F.array_join(split, "")).cast("bigint").alias("word_chars"),
    )


def _of_lines(lines: Column) -> Column:
    size = F.size(lines).cast("bigint")
    return F.struct(size.alias("n_lines"), (size - F.size(F.array_distinct(lines))).alias("n_dup_lines"))


def _of_marks(marks: Column) -> Column:
    kinds = {"n_symbols": SYMBOLS, "n_upper": "A-Z", "n_digits": "0-9", "n_bang": "!", "n_bars": "|"}
    return F.struct(*[counted(marks, kind).alias(name) for name, kind in kinds.items()])


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``__s``, a struct of counts of the whole text (null counts as empty)."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    return docs.withColumn(
        "__s",
        F.struct(
            let(words(whole), _of_words).alias("w"),
            let(lines, _of_lines).alias("l"),
            let(F.array_join(F.regexp_extract_all(whole, F.lit(f"[{_MARKS}]+"), F.lit(0)), ""), _of_marks).alias("m"),
        ),
    )


def features(s: Column) -> dict[str, Column]:
    """The features of a struct made by ``with_counts``; shares of nothing are 0."""
    w, lines, m = s.w, s.l, s.m
    share = lambda part, whole: F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))
    return {
        "n_words": w.of.n_words.cast("double"),
        "mean_word": share(w.word_chars, w.of.n_words),
        "symbol_share": share(m.n_symbols, w.word_chars),
        "upper_share": share(m.n_upper, w.word_chars),
        "digit_share": share(m.n_digits, w.word_chars),
        "bang_share": share(m.n_bang, w.word_chars),
        "bar_share": share(m.n_bars, w.word_chars),
        "repeat_share": share(w.of.n_repeat_words, w.of.n_words),
        "dup_line_share": share(lines.n_dup_lines, lines.n_lines),
        "distinct_share": share(w.of.n_distinct, w.of.n_words),
        "line_words": share(w.of.n_words, lines.n_lines),
    }
