"""Byte-level BPE over Arrow batches with the tokenizers library: ids, offsets and the way back.

A rank file names tokens as bytes; the library works on characters, so each byte is written as one
printable character (``byte_characters``). Any two neighbours whose bytes together are a token may
merge, lowest rank first, so all splits of a token are listed as merges in rank order.

Texts are cut at single spaces between other characters. No match of the pattern crosses such a place
(the space always starts the next match), so a piece has the same ids wherever it stands, and pieces
met before are looked up in a bounded table instead of being encoded again. Where white space meets
white space or the end of the text, the neighbours are left together.

Edge cases: null counts as the empty text, which has no ids; very long texts are worked on whole;
strings of special tokens are ordinary text; ids of an unfinished character decode to its bytes, and
``decode_parts`` holds back such bytes until the rest of the character has come.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import string
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator
from types import ModuleType

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

#: Bytes of pieces that one memory of a task holds (and as many of older ones), what an entry takes besides its
#: characters, and the longest piece that is remembered.
REMEMBERED_BYTES, ENTRY_BYTES, LONGEST = 80 << 20, 200, 64
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def byte_characters() -> list[str]:
    """One printable character for each byte: itself if it is visible, else one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def from_ranks(ranks: dict[bytes, int], pattern: str) -> Tokenizer:
    """A tokenizer with the ids of a rank file, which merges inside each match of ``pattern``."""
    shown = byte_characters()
    name = {token: "".join(shown[b] for b in token) for token in ranks}
    merges = [
        (name[token[:cut]], name[token[cut:]])
        for token in sorted(ranks, key=ranks.__getitem__)
        for cut in range(1, len(token))
        if token[:cut] in ranks and token[cut:] in ranks
    ]
    tokenizer = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return tokenizer


def load(path: str, pattern: str | None = None) -> Tokenizer:
    """A tokenizer from a rank file (with ``pattern``) or from a tokenizers file."""
    if path.endswith(".tiktoken"):
        return from_ranks(read_ranks(path), pattern or public_tokenizers.PATTERN)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def kept_by_worker[T](name: tuple, make: Callable[[], T]) -> T:
    """What ``make`` gave in an earlier task of this worker process, or gives now; the last ``name`` only is kept.

    A worker serves many tasks, but the functions it runs come anew with each, so their own module cannot
    keep anything for the next.
    """
    found = sys.modules.setdefault("tidemark_kept", ModuleType("tidemark_kept")).__dict__.setdefault("found", {})
    if name not in found:
        found.clear()
        found[name] = make()
    return found[name]


class _Loose(Exception):
    """A piece with white space at an end: its ids depend on what stands beside it."""


class Pieces(dict):
    """Ids (as 32-bit little-endian bytes) of pieces; those not met for a while are forgotten, and long ones at once."""

    def __init__(self, ids: Callable[[str], bytes]):
        self.ids, self.older, self.held = ids, {}, 0

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > LONGEST:
            return self.ids(piece)
        found = self.older.get(piece)
        if found is None:
            found = self.ids(piece)
        self.keep(piece, found)
        return found

    def keep(self, piece: str, found: bytes) -> None:
        if self.held >= REMEMBERED_BYTES:
            self.older, self.held = dict(self), 0
            self.clear()
        self[piece] = found
        self.held += ENTRY_BYTES + len(piece) + len(found)


class Encoder:
    """Whole texts to ids as 32-bit little-endian bytes, and the bytes of each id."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer, self.model, self.table = tokenizer, tokenizer.model, token_bytes(tokenizer)
        self.shown = str.maketrans(dict(enumerate(byte_characters())))
        self.leads = {"": "", " ": self.shown[0x20]}
        self.first = Pieces(lambda piece: self.piece("", piece))
        self.later = Pieces(lambda piece: self.piece(" ", piece))
        self.marks = Pieces(self.ids)

    def ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, lead: str, piece: str) -> bytes:
        """Ids of a piece after ``lead``. Letters are one match of the pattern, and so are ASCII marks after
        letters: a word is merged by itself, whatever mark follows it."""
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Loose
        word = piece.rstrip(string.punctuation)
        if not word.isalpha():
            return self.ids(lead + piece)
        if word != piece:
            return (self.later if lead else self.first)[word] + self.marks[piece[len(word) :]]
        # letters of ASCII are written as themselves
        match = self.leads[lead] + word if word.isascii() else (lead + word).encode().decode("latin-1").translate(self.shown)
        return array("I", [token.id for token in self.model.tokenize(match)]).tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        first, *later = text.split(" ")
        try:
            return b"".join([self.first[first], *map(self.later.__getitem__, later)])
        except _Loose:
            first, *later = _SAFE_SPACE.split(text)
            return b"".join([self.ids(first), *[self.ids(" " + piece) for piece in later]])

    def after_space(self, text: str) -> bytes:
        """Ids of a space and the text."""
        try:
            return b"".join(map(self.later.__getitem__, text.split(" ")))
        except _Loose:
            return self(" " + text)


def encoder_of(path: str, pattern: str | None = None) -> Encoder:
    """The worker's encoder for a vocabulary file, with the pieces it has met."""
    return kept_by_worker(("encoder", path, pattern), lambda: Encoder(load(path, pattern)))


def token_bytes(tokenizer: Tokenizer) -> list[bytes]:
    """The bytes of each id: its characters through the byte table, the other way."""
    back = {c: b for b, c in enumerate(byte_characters())}
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, number in vocabulary.items():
        out[number] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return out


def decode(ids: Iterable[int], table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids))


def decode_parts(parts: Iterable[Iterable[int]], table: list[bytes]) -> Iterator[str]:
    """Text of each part of a sequence of ids; a character split over parts comes with its last byte."""
    waiting = codecs.getincrementaldecoder("utf-8")("replace")
    for part in parts:
        yield waiting.decode(decode(part, table))
    yield waiting.decode(b"", final=True)


def offsets(ids: np.ndarray, table: list[bytes]) -> np.ndarray:
    """Where each token begins in the bytes of the text, and the end."""
    return np.concatenate([[0], np.cumsum([len(table[i]) for i in ids.tolist()])]).astype(np.int64)


def encode_column(docs: DataFrame, path: str, pattern: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``offsets`` (byte offsets of the tokens, and the end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, pattern)
        table = encoder.table
        for batch in batches:
            for at, value in enumerate(batch.column("__text")):
                ids = np.frombuffer(encoder(value.as_py() or ""), np.uint32)
                row = batch.slice(at, 1).drop_columns(["__text"])
                row = row.append_column("ids", pa.array([ids.astype(np.int32)], pa.list_(pa.int32())))
                yield row.append_column("offsets", pa.array([offsets(ids, table)], pa.list_(pa.int64())))

    kept = docs.drop("ids", "offsets")
    schema = StructType([*kept.schema.fields, StructField("ids", ArrayType(IntegerType())), StructField("offsets", ArrayType(LongType()))])
    return kept.select("*", F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, and digests of its ids and of the bytes decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, pattern)
        table = encoder.table
        for batch in batches:
            counts, encoded, decoded = [], [], []
            for value in batch.column("text"):
                raw = encoder(value.as_py() or "")
                counts.append(len(raw) // 4)
                encoded.append(hashlib.sha256(raw).hexdigest())
                decoded.append(hashlib.sha256(decode(np.frombuffer(raw, np.uint32).tolist(), table)).hexdigest())
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
