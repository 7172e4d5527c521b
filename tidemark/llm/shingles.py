"""Word shingles of whole texts as 64-bit hashes, in Arrow batches of bounded size."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SIZE = 5
#: Bytes of text worked on at once; a longer text is worked on alone.
CHUNK_BYTES = 1 << 20
_STEPS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts as bytes) for runs of some ``limit`` bytes; null counts as empty."""
    start, size, part = 0, 0, []
    for at, value in enumerate(texts.cast(pa.binary())):
        raw = value.as_py() or b""
        if part and size + len(raw) > limit:
            yield start, part
            start, size, part = at, 0, []
        part.append(raw)
        size += len(raw)
    if part:
        yield start, part


def words(raw: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of bytes other than ASCII white space."""
    return raw.lower().split()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashed(split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All shingle hashes of the texts, one text after the other, and where each text's begin (and the end).

    A text of fewer than five words has its whole sequence as its one shingle; one without words, none.
    """
    sizes = np.array([len(w) for w in split], np.int64)
    flat = np.fromiter((xxhash.xxh3_64_intdigest(w) for text in split for w in text), np.uint64, int(sizes.sum()))
    grams = np.zeros(max(len(flat) - SIZE + 1, 0), np.uint64)
    for k in range(SIZE):
        grams = mixed(grams * _STEPS[0] + flat[k : k + len(grams)])
    ends = np.cumsum(sizes)
    parts, counts = [], []
    for size, end in zip(sizes.tolist(), ends.tolist(), strict=True):
        if size >= SIZE:
            parts.append(grams[end - size : end - SIZE + 1])
        elif size:
            value = np.array([size], np.uint64) * _STEPS[2]
            for at in range(end - size, end):
                value = mixed(value * _STEPS[1] + flat[at : at + 1])
            parts.append(value)
        else:
            parts.append(np.zeros(0, np.uint64))
        counts.append(len(parts[-1]))
    return np.concatenate(parts) if parts else grams[:0], np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def digest(split: list[bytes]) -> bytes | None:
    """128 bits of the word sequence; None without words."""
    return hashlib.blake2b(b" ".join(split), digest_size=16).digest() if split else None
