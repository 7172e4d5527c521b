"""Alignment of two tokenizers over the same bytes: overlaps, groups and links.

Side A is a byte-level BPE that reads a space and the text; side B a sentencepiece model that adds that
space itself. Tokens are byte ranges of the same bytes. Per batch, ``pandas.merge_asof`` keyed by document
finds for each token's start the token of the other side that covers it; the union of both directions is
all pairs that overlap. Pairs that end together are links, and their ends cut both sides into groups.

What a link is worth follows from the whole corpus: the count of its pair of ids over all documents. Each
document's links come as distinct pairs with their number, which are added up before any shuffle; the table
of pairs is bounded by the vocabularies, is written first, and so has a known size: Spark broadcasts it
below ``spark.sql.autoBroadcastJoinThreshold`` and beyond shuffles by pair, where adaptive execution splits
frequent ones. Texts are encoded once; their alignments are written to the shared folder.

Both sides are encoded in parts that no token crosses (A as in ``byte_bpe``; B at the start of each run of
spaces, which is checked against its vocabulary), so that parts met before need not be encoded again. A
batch is worked on in runs of some megabyte of text; a longer text is worked on alone and whole.

Edge cases: texts that are null or empty, or whose tokens do not give back the bytes (B reads U+2581 as a
space), have no tokens: all numbers are 0 and the digest is the empty string. Strings of special tokens are
ordinary text. Repeated rows each get their row and each count in the corpus. An empty table gives no
rows. Only ``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe
from tidemark.llm.shingles import chunks
from tidemark.sources.workspace import settle

#: Sentencepiece's sign for a space.
SPACE = "▁"


class ByteSide:
    """Ids of a space and the text by a byte-level BPE."""

    def __init__(self, path: str):
        self.encoder = byte_bpe.Encoder(byte_bpe.load(path))
        self.table = self.encoder.table
        if not {bytes([b]) for b in range(256)} <= set(self.table):
            raise ValueError(f"{path} has no token for some byte")

    def __call__(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encoder.after_space(text), np.uint32)


class PieceSide:
    """Ids of a text by a sentencepiece model, which puts a space before it."""

    _BYTE = re.compile(r"<0x([0-9A-F]{2})>")
    _PART = re.compile(" +[^ ]*")

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.table = [self._bytes(piece) for piece in pieces]
        # a space within a piece stands at its start, so nothing is merged across the start of a run of spaces
        self.parted = not any(SPACE in piece.lstrip(SPACE) for piece in pieces)
        self.space = self.model.piece_to_id(SPACE)
        self.parts = byte_bpe.Pieces(self._part)

    def _bytes(self, piece: str) -> bytes:
        one = self._BYTE.fullmatch(piece)
        return bytes([int(one[1], 16)]) if one else piece.replace(SPACE, " ").encode()

    def _part(self, part: str) -> bytes:
        """Ids of a part after one space; nothing if they do not give back its bytes.

        The library adds that space to all but the empty text.
        """
        return self._checked(part, self.model.encode(part, num_threads=1) if part else [self.space])

    def _checked(self, part: str, ids: list[int]) -> bytes:
        same = b"".join(map(self.table.__getitem__, ids)) == f" {part}".encode()
        return array("I", ids).tobytes() if same else b""

    def meet(self, texts: list[str]) -> None:
        """Encode the new parts of some texts together, which takes the library half the time."""
        if not self.parted:
            return
        met: set[str] = set().union(*[text.split(" ") for text in texts])
        new = [p for p in met if p and len(p) <= byte_bpe.LONGEST and p not in self.parts and p not in self.parts.older]
        for part, ids in zip(new, self.model.encode(new, num_threads=1), strict=True):
            self.parts.keep(part, self._checked(part, ids))

    def __call__(self, text: str) -> np.ndarray:
        """Ids of the parts that give back their bytes."""
        if not self.parted:
            return np.frombuffer(self._part(text), np.uint32)
        parts = text.split(" ")
        if "" in parts:
            parts = [part[1:] for part in self._PART.findall(f" {text}")]
        return np.frombuffer(b"".join(map(self.parts.__getitem__, parts)), np.uint32)


class Tokens(NamedTuple):
    """Tokens of one side of a run of texts, one text after the other."""

    ids: np.ndarray
    #: Where each token begins and ends in the bytes of all texts.
    start: np.ndarray
    end: np.ndarray
    #: Index of the text of each token.
    doc: np.ndarray


class Aligned(NamedTuple):
    a: Tokens
    b: Tokens
    #: Pairs of overlapping tokens: indexes into ``a`` and ``b``.
    over_a: np.ndarray
    over_b: np.ndarray

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The overlapping pairs that end together."""
        same = self.a.end[self.over_a] == self.b.end[self.over_b]
        return self.over_a[same], self.over_b[same]


def _tokens(found: list[np.ndarray], sizes: np.ndarray) -> Tokens:
    ids = np.concatenate([*found, np.zeros(0, np.uint32)]).astype(np.int64)
    end = np.cumsum(sizes[ids])
    return Tokens(ids, end - sizes[ids], end, np.repeat(np.arange(len(found)), [len(x) for x in found]))


def _covering(starts: Tokens, tokens: Tokens) -> np.ndarray:
    """For the start of each token, the index of the other side's token that covers it."""
    left = pd.DataFrame({"at": starts.start, "doc": starts.doc})
    right = pd.DataFrame({"at": tokens.start, "doc": tokens.doc, "token": np.arange(len(tokens.ids))})
    return pd.merge_asof(left, right, on="at", by="doc")["token"].to_numpy(np.int64)


class Aligner:
    """Encodes runs of texts by both sides and aligns them."""

    def __init__(self, path_a: str, path_b: str):
        self.sides = [ByteSide(path_a), PieceSide(path_b)]
        self.sizes = [np.array([len(t) for t in side.table], np.int64) for side in self.sides]
        self.speller = Speller([len(side.table) for side in self.sides])

    def _found(self, raw: bytes, text: str) -> list[np.ndarray]:
        if not raw:
            return [np.zeros(0, np.uint32)] * 2
        found = [side(text) for side in self.sides]
        # A has a token for each byte and so loses none; a part that B changed is left out and missing here
        whole = all(sizes[ids].sum() == len(raw) + 1 for sizes, ids in zip(self.sizes, found, strict=True))
        return found if whole else [ids[:0] for ids in found]

    def __call__(self, texts: list[bytes]) -> Aligned:
        read = [raw.decode() for raw in texts]
        self.sides[1].meet(read)
        found = [self._found(raw, text) for raw, text in zip(texts, read, strict=True)]
        a, b = (_tokens([f[side] for f in found], self.sizes[side]) for side in (0, 1))
        in_b, in_a = _covering(a, b), _covering(b, a)
        # a pair that begins together is found from both sides
        later = a.start[in_a] != b.start if len(b.ids) else np.zeros(0, bool)
        over_a = np.concatenate([np.arange(len(a.ids)), in_a[later]])
        over_b = np.concatenate([in_b, np.arange(len(b.ids))[later]])
        return Aligned(a, b, over_a, over_b)


def _bounds(doc: np.ndarray, n: int) -> np.ndarray:
    """Where the entries of each of ``n`` texts begin, and the end."""
    return np.searchsorted(doc, np.arange(n + 1))


class Speller:
    """Groups as text: the decimal ids of A, then those of B, by group and in order."""

    def __init__(self, n: list[int]):
        self.n = n
        # an id and the sign after it as eight bytes, those not needed being 0
        spelled = [f"{i}{mark}".encode() for size, marks in zip(n, (",|", ",;"), strict=True) for mark in marks for i in range(size)]
        self.bytes = np.array(spelled, "S8").view(np.uint64)
        self.sizes = np.array([len(s) for s in spelled], np.int64)
        if self.sizes.max() > 8:
            raise ValueError("ids of more than seven digits")

    def __call__(self, x: Aligned, last_a: np.ndarray, last_b: np.ndarray, n: int) -> list[bytes]:
        """One text for each of the ``n`` documents; ``last_a`` and ``last_b`` mark the tokens that end a group."""
        na, nb = self.n
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        ends_a, ends_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        # tokens of A follow those of B in the groups before; tokens of B those of A in their group too
        codes = np.empty(len(x.a.ids) + len(x.b.ids), np.int64)
        codes[np.arange(len(x.a.ids)) + np.concatenate([[0], ends_b])[group_a]] = x.a.ids + na * last_a
        codes[np.arange(len(x.b.ids)) + ends_a[group_b]] = x.b.ids + 2 * na + nb * last_b
        padded = self.bytes[codes].view(np.uint8)
        text = padded[padded != 0].tobytes()
        cut = np.concatenate([[0], np.cumsum(self.sizes[codes])])[_bounds(x.a.doc, n) + _bounds(x.b.doc, n)].tolist()
        return [text[s : e - 1] if e > s else b"" for s, e in zip(cut[:-1], cut[1:], strict=True)]


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def _last(x: Aligned) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the tokens of either side that end a group."""
    marks = np.zeros(len(x.a.ids), np.int64), np.zeros(len(x.b.ids), np.int64)
    for mark, linked in zip(marks, x.links(), strict=True):
        mark[linked] = 1
    return marks


def _mapped(docs: DataFrame, paths: tuple[str, str], build: Callable[..., list[pa.Array]], columns: dict[str, str]) -> DataFrame:
    """``doc_id``, a row number, and what ``build`` makes of each run of texts."""
    names = ["row", "doc_id", *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = byte_bpe.kept_by_worker(("aligner", *paths), lambda: Aligner(*paths))
        speller = aligner.speller
        for batch in batches:
            for start, texts in chunks(batch.column("text")):
                made = build(aligner(texts), speller, len(texts))
                kept = [batch.column(name).slice(start, len(texts)) for name in names[:2]]
                yield pa.RecordBatch.from_arrays([*kept, *made], names)

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    kinds = ", ".join(f"{name} {kind}" for name, kind in columns.items())
    return rows.mapInArrow(run, f"row bigint, doc_id bigint, {kinds}")


def overlaps(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document: doc_id, ids and byte ends of both sides (a_ids, a_ends, b_ids, b_ends), the overlapping
    pairs as indexes of tokens (over_a, over_b), and the byte ends of the groups (cuts)."""

    def build(x: Aligned, _: Speller, n: int) -> list[pa.Array]:
        made = []
        for side in (x.a, x.b):
            at = _bounds(side.doc, n)
            first = np.repeat(side.start[at[:-1][np.diff(at) > 0]], np.diff(at)[np.diff(at) > 0])
            made += [_lists(side.ids, at, pa.int64()), _lists(side.end - first, at, pa.int64())]
        order = np.lexsort((x.over_b, x.over_a))
        over_a, over_b = x.over_a[order], x.over_b[order]
        at = _bounds(x.a.doc[over_a], n)
        for over, side in ((over_a, x.a), (over_b, x.b)):
            made.append(_lists(over - _bounds(side.doc, n)[side.doc[over]], at, pa.int64()))
        last = np.flatnonzero(_last(x)[0])
        begin = np.zeros(n, np.int64)
        begin[x.a.doc[::-1]] = x.a.start[::-1]
        made.append(_lists(x.a.end[last] - begin[x.a.doc[last]], _bounds(x.a.doc[last], n), pa.int64()))
        return made

    names = ["a_ids", "a_ends", "b_ids", "b_ends", "over_a", "over_b", "cuts"]
    return _mapped(docs, (path_a, path_b), build, dict.fromkeys(names, "array<bigint>")).drop("row")


def _summaries(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Numbers and digest of each document, and its distinct linked pairs (a * 2^32 + b) with their number."""

    def build(x: Aligned, speller: Speller, n: int) -> list[pa.Array]:
        last_a, last_b = _last(x)
        at_a, at_b = x.links()
        n_links = np.bincount(x.a.doc[at_a], minlength=n)
        order = np.argsort(x.a.doc[at_a], kind="stable")
        pair = ((x.a.ids[at_a] << 32) | x.b.ids[at_b])[order]
        parts = np.split(pair, np.cumsum(n_links)[:-1])
        counted = [np.unique(p, return_counts=True) for p in parts]
        at = np.concatenate([[0], np.cumsum([len(p) for p, _ in counted])])
        spelled = speller(x, last_a, last_b, n)
        digest = [hashlib.sha256(s).hexdigest() if s else "" for s in spelled]
        count = lambda values: pa.array(values, pa.int64())
        return [
            count(np.diff(_bounds(x.a.doc, n))),
            count(np.diff(_bounds(x.b.doc, n))),
            count(np.bincount(x.a.doc, weights=last_a, minlength=n).astype(np.int64)),
            count(n_links),
            pa.array(digest, pa.string()),
            _lists(np.concatenate([p for p, _ in counted]), at, pa.int64()),
            _lists(np.concatenate([c for _, c in counted]), at, pa.int64()),
        ]

    numbers = dict.fromkeys(["n_a", "n_b", "n_groups", "n_links"], "bigint")
    return _mapped(docs, (path_a, path_b), build, numbers | {"groups_sha256": "string", "pairs": "array<bigint>", "times": "array<bigint>"})


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    aligned = settle(_summaries(docs, path_a, path_b), "alignment")
    each = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    counts = settle(each.groupBy("pair").agg(F.sum("times").alias("count")), "alignment-pairs")
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    highest = counts.groupBy(b.alias("b")).agg(F.max("count").alias("highest"))
    worth = counts.withColumn("b", b).join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    worth = settle(worth, "alignment-worth")
    sums = (
        each.join(worth, "pair")
        .groupBy("row")
        .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    )
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(name)
    return aligned.drop("pairs", "times").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"
    )
