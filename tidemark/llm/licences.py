"""Licence scan by a positional index of rare words.

Each notice of ``NOTICES`` is a template: its words by position, and key phrases that must stand in it.
How rare a licence word is follows from all documents: the number of texts that contain it.

Each template has voters: the rarest words of its own key phrases. In a text, each occurrence of a voter
votes for (template, place of the template's first word in the text). A place with the votes of all voters
is a candidate, is verified by its key phrases word for word at their relative positions, and scored by the
share of the template's words that stand where they should. Where the key phrases stand, the voters do, so
no template is lost to what else the text holds. Votes are sorted, never paired, so long texts cost n log n. All of it
happens inside the row, as column expressions over literal tables of fixed size. A text that lacks the
rarest word of every key phrase is passed over, since nothing could be verified in it.

Besides, the base labels: places where the words of ``BASE`` phrases stand consecutively.

Edge cases: null counts as empty (no words, no labels, score 0); repeated rows get equal results; a text
that begins within a notice may start a template before its first word, as long as the key phrases stand.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textstats import let

# Base phrases and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# Notices of public licences, and phrases that must stand in each.
NOTICES = [
    ("agpl", "licensed under the gnu affero general public license version 3", ["gnu affero general public license"]),
    ("apache-2.0", "licensed under the apache license version 2.0", ["apache license", "version 2.0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     ["redistribution and use in source and binary forms"]),
    ("cc-by-4.0", "licensed under cc by 4.0", ["cc by 4.0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4.0", ["cc by nc 4.0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4.0", ["cc by sa 4.0"]),
    ("cc0-1.0", "dedicated to the public domain under cc0 1.0 universal", ["public domain", "cc0"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ["permission to use copy modify and or distribute this software"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("mit", "released under the mit license", ["the mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
     ["permission is hereby granted free of charge"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license version 2.0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ["free and unencumbered software"]),
]

#: Key words of a template that vote for it, if it has as many; the votes of all make a candidate.
VOTES = 2

# letters and digits of ASCII, and all beyond: named as ranges, which is read faster than their complement
_IN = r"[a-zA-Z0-9\x{80}-\x{10FFFF}]"
_OUT = r"[^a-zA-Z0-9\x{80}-\x{10FFFF}]"
_WORD = f"{_IN}+"


def split_words(notice: str) -> list[str]:
    """The words of a notice, as the pattern cuts them: 2.0 is two words."""
    return notice.replace(".", " ").replace("-", " ").split()


def rarest(words: set[str], seen: dict[str, int]) -> str:
    return min(words, key=lambda w: (seen.get(w, 0), w))


class Index:
    """Templates, their key phrases and the places of each word; of fixed size."""

    def __init__(self, notices: list[tuple[str, str, list[str]]]):
        self.labels = [label for label, _, _ in notices]
        self.templates = [split_words(text) for _, text, _ in notices]
        self.keys = [[self._place(words, split_words(key)) for key in keys] for words, (_, _, keys) in zip(self.templates, notices, strict=True)]
        self.vocabulary = sorted({*(w for words in self.templates for w in words), *(w for phrase, _ in BASE for w in phrase.split())})

    def gate(self, seen: dict[str, int]) -> list[str]:
        """The rarest key word of each template: without one of them in a text, no template can be verified."""
        return sorted({rarest(set(words), seen) for words in self._keyed()})

    def voters(self, seen: dict[str, int]) -> list[dict[str, int]]:
        """For each template, its ``VOTES`` rarest key words and their positions."""
        by_rarity = lambda words: sorted(words, key=lambda w: (seen.get(w, 0), w))
        return [{w: words[w] for w in by_rarity(words)[:VOTES]} for words in self._keyed()]

    def _keyed(self) -> list[dict[str, int]]:
        """The key words of each template, with one position of each."""
        return [{self.templates[t][p + k]: p + k for p, n in keys for k in range(n)} for t, keys in enumerate(self.keys)]

    @staticmethod
    def _place(words: list[str], key: list[str]) -> tuple[int, int]:
        """(position, length) of a key phrase in its template."""
        for p in range(len(words) - len(key) + 1):
            if words[p : p + len(key)] == key:
                return p, len(key)
        raise ValueError(f"{' '.join(key)!r} does not stand in {' '.join(words)!r}")


INDEX = Index(NOTICES)


def _literal(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def _lower(text: Column) -> Column:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, letters, letters.lower())


def _found(text: Column) -> Column:
    """All words of a text, lower-cased A-Z."""
    return F.regexp_extract_all(_lower(text), F.lit(_WORD), F.lit(0))


def _n_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))).cast("bigint")


def _phrase(phrase: str) -> str:
    """A pattern for the words of a phrase standing consecutively, in either case (A-Z only)."""
    return f"(?i)(?<!{_IN}){f'{_OUT}+'.join(phrase.split())}(?!{_IN})"


def _roughly(text: Column) -> Column:
    """All words, lower-cased by the faster built-in: other letters than A-Z change too, ASCII words do not differ
    but for a Kelvin sign, which reads as k. Good for counts and for passing texts over."""
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def frequencies(texts: DataFrame, index: Index = INDEX) -> dict[str, int]:
    """Number of texts that contain each licence word, over all texts: one row per word at most."""
    seen = F.array_intersect(_roughly(F.col("text")), _literal(index.vocabulary))
    counted = texts.select(F.explode(seen).alias("word")).groupBy("word").count()
    return {row["word"]: row["count"] for row in counted.collect()}


def _votes(words: Column, voters: list[dict[str, int]]) -> Column:
    """(template, start) for each occurrence of a voter."""
    by_word: dict[str, list[Column]] = defaultdict(list)
    for t, positions in enumerate(voters):
        for word, p in positions.items():
            by_word[word].append(F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")))
    places = F.create_map(*[x for word, at in by_word.items() for x in (F.lit(word), F.array(*at))])
    placed = F.filter(
        F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(_literal(list(by_word)), x.w)
    )
    each = F.transform(
        placed, lambda x: F.transform(F.element_at(places, x.w), lambda q: F.struct(q.t.alias("t"), (x.i - q.p).alias("at")))
    )
    return F.sort_array(F.flatten(each))


def _candidates(votes: Column, voters: list[dict[str, int]]) -> Column:
    """Places with the votes of all voters of their template, each once: equal votes stand together."""
    needed = F.array(*[F.lit(len(positions)) for positions in voters])
    first = lambda v, i: (i == 0) | ~F.get(votes, i - 1).eqNullSafe(v)
    return F.filter(votes, lambda v, i: first(v, i) & F.get(votes, i + F.get(needed, v.t) - 1).eqNullSafe(v))


def _verified(words: Column, index: Index, candidates: Column) -> Column:
    """(label, share, start, template) of the candidates whose key phrases all stand at their places."""
    nowhere = F.struct(F.lit("").alias("label"), F.lit(0.0).alias("share"))

    def at(start: Column, p: int, n: int) -> Column:
        from_ = start + F.lit(p)
        return F.when((from_ >= 0) & (from_ + n <= F.size(words)), F.slice(words, from_ + 1, F.lit(n)))

    def judged(c: Column) -> Column:
        chain = None
        for t, template in enumerate(index.templates):
            stand = [
                F.coalesce(at(c.at, p, n) == _literal(template[p : p + n]), F.lit(False)) for p, n in index.keys[t]
            ]
            here = lambda k, c=c: F.when((c.at + k >= 0) & (c.at + k < F.size(words)), F.get(words, c.at + k))
            same = [F.when(here(k) == F.lit(w), 1).otherwise(0) for k, w in enumerate(template)]
            share = reduce(Column.__add__, same).cast("double") / len(template)
            value = F.when(reduce(Column.__and__, stand), F.struct(F.lit(index.labels[t]).alias("label"), share.alias("share"))).otherwise(nowhere)
            chain = F.when(c.t == t, value) if chain is None else chain.when(c.t == t, value)
        return chain.otherwise(nowhere)

    return F.filter(F.transform(candidates, judged), lambda x: x.label != "")


def scan(docs: DataFrame, index: Index = INDEX) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    seen = frequencies(texts, index)
    voters = index.voters(seen)
    base_gate = sorted({rarest(set(phrase.split()), seen) for phrase, _ in BASE})
    gates = lambda words: F.struct(
        F.size(words).cast("bigint").alias("n_words"),
        F.arrays_overlap(words, _literal(index.gate(seen))).alias("notice"),
        F.arrays_overlap(words, _literal(base_gate)).alias("base"),
    )
    texts = texts.withColumn("__w", let(_roughly(F.col("text")), gates))
    text = F.col("text")
    counts, firsts, lasts, names = [], [], [], []
    for phrase, label in BASE:
        hit = F.when(F.col("__w.base"), text.rlike(_phrase(phrase))).otherwise(F.lit(False))
        parts = F.split(text, _phrase(phrase))
        size = len(phrase.split())
        counts.append(F.when(hit, let(parts, lambda x: F.size(x) - 1)).otherwise(0).cast("bigint"))
        firsts.append(F.when(hit, let(parts, lambda x: _n_words(F.get(x, F.lit(0))))))
        # words before the last place: all words but those of the phrase and after it
        after = let(parts, lambda x: _n_words(F.element_at(x, -1)))
        lasts.append(F.when(hit, F.col("__w.n_words") - after - F.lit(size)))
        names.append(F.when(hit, F.lit(label)))
    none = F.array().cast("array<struct<label:string,share:double>>")
    found = F.when(
        F.col("__w.notice"),
        let(_found(text), lambda words: let(_candidates_of(words, voters), lambda c: _verified(words, index, c))),
    ).otherwise(none)
    rows = texts.select(
        "doc_id",
        F.col("__w.n_words").alias("n_words"),
        reduce(Column.__add__, counts).alias("n_base"),
        F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"),
        F.sort_array(F.array_compact(F.array(*names))).alias("base"),
        found.alias("found"),
    )
    best = F.coalesce(F.array_max(F.transform("found", lambda x: x.share)), F.lit(0.0))
    every = F.sort_array(F.array_distinct(F.concat(F.col("base"), F.transform("found", lambda x: x.label))))
    return rows.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        # a base phrase that stands in no known notice is worth half
        F.greatest(best, F.when(F.size("base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def _candidates_of(words: Column, voters: list[dict[str, int]]) -> Column:
    return let(_votes(words, voters), lambda votes: _candidates(votes, voters))
