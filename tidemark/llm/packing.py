"""Best-fit packing of documents into sequences, with a swap-based local search.

A document longer than a sequence is cut; its first piece takes the remainder and all others are full,
so that at most one piece of a document is left to place. Those are dealt at random into blocks of
bounded size and packed block by block: best fit of the longest first, then a local search over the
bins that are not full. It moves a piece, exchanges one piece for one, or two for one, whenever that
raises the sum of squared fills, from the emptiest bin on, until no such exchange between any two bins
is left. Partners come out of an index by piece size and fill. Bins that are exactly full are done; all
others are dealt anew, bin by bin, into fewer blocks, so that what does not fit together in one block meets
the rest of the other blocks. There the search starts from the bins as they are and from a new best fit of
their pieces, and the smaller result stays. Rounds go on while they save sequences; one that saves none is dropped.

Every round is written to the shared folder. A block holds at most some ``BLOCK`` pieces (24 bytes each)
whatever the size of the table or of any key, since pieces are dealt by row number.

Edge cases: null and empty texts are the end token alone; repeated rows are packed each; documents
without an id are packed and keep their null; an empty table yields no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe
from tidemark.sources.workspace import settle

CAPACITY = 1024
END = 2
BLOCK = 20_000


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: a remainder first, then full ones."""
    first = (total - 1) % capacity + 1
    return [(0, first), *[(at, capacity) for at in range(first, total, capacity)]]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe.encoder_of(path)
        tail = int(end).to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            for number, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                raw = memoryview(encoder(text.as_py() or "") + tail)
                rows += [
                    (number, k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]))
                    for k, (start, length) in enumerate(cut(len(raw) // 4, capacity))
                ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of piece numbers: longest first, each into the fullest bin that still takes it."""
    by_room: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    bins: list[list[int]] = []
    for at in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[at])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, chosen = capacity, []
            bins.append(chosen)
        chosen.append(at)
        by_room[room - size].append(chosen)
        rooms |= 1 << (room - size)
    return bins


class _Index:
    """Bins by the sizes of their pieces, and by fill; every bin is listed under size 0 too, for plain moves."""

    def __init__(self, capacity: int):
        self.fills = [0] * (capacity + 1)  # by size: bit f is set if some bin of fill f has such a piece
        self.bins: dict[tuple[int, int], dict[int, None]] = {}
        self.sizes: list[int] = []  # those that occur, in order

    def add(self, at: int, fill: int, sizes: set[int]) -> None:
        for size in (0, *sizes):
            if not self.fills[size]:
                insort(self.sizes, size)
            self.fills[size] |= 1 << fill
            self.bins.setdefault((size, fill), {})[at] = None

    def remove(self, at: int, fill: int, sizes: set[int]) -> None:
        for size in (0, *sizes):
            held = self.bins[size, fill]
            del held[at]
            if not held:
                del self.bins[size, fill]
                self.fills[size] &= ~(1 << fill)
                if not self.fills[size]:
                    del self.sizes[bisect_left(self.sizes, size)]


class _Search:
    """Bins that are not full. What a bin gives is larger than what it takes, and no exchange lowers the squares."""

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int):
        self.bins, self.sizes, self.capacity = bins, sizes, capacity
        self.fill = [sum(sizes[p] for p in b) for b in bins]
        self.every, self.changed = _Index(capacity), _Index(capacity)
        self.last: set[int] = set()  # the two of the last exchange
        self.marked: set[int] = set()  # the bins of ``changed``: those since the pass before began
        self.upto = [(1 << (f + 1)) - 1 for f in range(capacity + 1)]
        for at in range(len(bins)):
            self._list(self.every, at)

    def _list(self, index: _Index, at: int) -> None:
        # a bin that is empty or full takes nothing
        if 0 < self.fill[at] < self.capacity:
            index.add(at, self.fill[at], {self.sizes[p] for p in self.bins[at]})

    def _unlist(self, index: _Index, at: int) -> None:
        if 0 < self.fill[at] < self.capacity:
            index.remove(at, self.fill[at], {self.sizes[p] for p in self.bins[at]})

    def _gives(self, source: int) -> list[tuple[int, tuple[int, ...]]]:
        """What the bin can give, each size once: a piece, or two of them for one."""
        one, two = {}, {}
        by_size: dict[int, list[int]] = {}
        for p in self.bins[source]:
            by_size.setdefault(self.sizes[p], []).append(p)
            one[self.sizes[p]] = (p,)
        kinds = sorted(by_size)
        for k, a in enumerate(kinds):
            if len(by_size[a]) > 1:
                two[2 * a] = tuple(by_size[a][:2])
            for b in kinds[:k]:
                two[a + b] = (by_size[a][0], by_size[b][0])
        return sorted([*one.items(), *two.items()], reverse=True)

    def best(self, source: int, index: _Index) -> tuple | None:
        """(rise, size taken, fill of the partner, pieces given) of the exchange that raises the squares most."""
        fill, found, most = self.fill[source], None, 0
        for given, give in self._gives(source):
            for taken in index.sizes:
                gain = given - taken
                # no bin is fuller than full after it
                if gain <= 0 or gain * (self.capacity - fill) <= most:
                    break
                if gain > self.capacity or (len(give) == 2 and not taken):
                    continue
                fits = index.fills[taken] & self.upto[self.capacity - gain]
                if fits:
                    other = fits.bit_length() - 1
                    rise = gain * (other - fill + gain)
                    if rise > most:
                        found, most = (rise, taken, other, give), rise
        return found

    def exchange(self, source: int, index: _Index) -> bool:
        """Make the best exchange of a bin with those of the index."""
        here = source in self.marked
        self._unlist(self.every, source)
        if here:
            self._unlist(self.changed, source)
        found = self.best(source, index)
        if found is None:
            self._list(self.every, source)
            if here:
                self._list(self.changed, source)
            return False
        _, taken, other, give = found
        target = next(iter(index.bins[taken, other]))
        self._unlist(self.every, target)
        if target in self.marked:
            self._unlist(self.changed, target)
        take = [next(p for p in self.bins[target] if self.sizes[p] == taken)] if taken else []
        gain = sum(self.sizes[p] for p in give) - taken
        self.bins[source] = [p for p in self.bins[source] if p not in give] + take
        self.bins[target] = [p for p in self.bins[target] if p not in take] + list(give)
        self.fill[source] -= gain
        self.fill[target] += gain
        self.last = {source, target}
        for at in self.last:
            self.marked.add(at)
            self._list(self.every, at)
            self._list(self.changed, at)
        return True

    def run(self) -> None:
        """Passes over all bins until one changes nothing. A bin that has not changed since it found no partner
        is held against those that have."""
        before = set(range(len(self.bins)))
        while before:
            self.changed, self.marked = _Index(self.capacity), set(before)
            for at in before:
                self._list(self.changed, at)
            now: set[int] = set()
            for source in sorted(range(len(self.bins)), key=self.fill.__getitem__):
                index = self.every if source in self.marked else self.changed
                while 0 < self.fill[source] < self.capacity and self.exchange(source, index):
                    now |= self.last
                    index = self.every
            before = now


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Exchange pieces between bins that are not full until no exchange raises the squares; drop empty bins."""
    sizes = lengths.tolist()
    full, rest = [], []
    for b in bins:
        (full if sum(sizes[p] for p in b) == capacity else rest).append(b)
    search = _Search(rest, sizes, capacity)
    search.run()
    return full + [b for b in search.bins if b]


def _pack(block: pd.DataFrame, capacity: int, again: bool) -> pd.DataFrame:
    block = block.sort_values("rid", ignore_index=True)
    lengths = block["length"].to_numpy()
    bins = local_search(best_fit(lengths, capacity), lengths, capacity)
    if again:
        held = local_search(list(map(list, block.groupby("sequence_id").indices.values())), lengths, capacity)
        bins = min(held, bins, key=lambda found: (len(found), -sum(int(lengths[b].sum()) ** 2 for b in found)))
    number, offset, full = (np.zeros(len(block), np.int64) for _ in range(3))
    for k, members in enumerate(bins):
        sizes = lengths[members]
        number[members], offset[members] = k, np.cumsum(sizes) - sizes
        full[members] = sizes.sum()
    return block.drop(columns="sequence_id").assign(bin=number, offset=offset, fill=full)


def _packer(capacity: int, again: bool):
    return lambda block: _pack(block, capacity, again)


def pack(found: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (any columns, among them ``length``)."""
    kept = found.columns
    placed = settle(found.withColumn("rid", F.monotonically_increasing_id()), "packing-pieces")
    whole = placed.filter(F.col("length") == capacity).select("rid", (-1 - F.col("rid")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    parts, number = [whole], 0
    rest = placed.filter(F.col("length") < capacity).select("rid", "length", F.col("rid").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    count = used = rest.count()
    while count:
        blocks = -(-count // block)
        dealt = rest.withColumn("block", F.pmod(F.xxhash64("sequence_id", F.lit(number)), F.lit(blocks)).cast("int")).drop("offset")
        schema = "rid bigint, length bigint, block int, bin bigint, offset bigint, fill bigint"
        tried = settle(dealt.groupBy("block").applyInPandas(_packer(capacity, number > 0), schema), "packing-round")
        # each sequence has one piece at its start
        start = F.col("offset") == 0
        made = tried.agg(
            F.count(F.when(start, 1)).alias("all"),
            F.count(F.when(start & (F.col("fill") < capacity), 1)).alias("open"),
            F.count(F.when(F.col("fill") < capacity, 1)).alias("left"),
        ).first()
        if number and made["all"] >= used:
            break
        # rounds stay apart by their number, blocks and bins by theirs
        named = F.lit(number).cast("bigint") * 2**56 + F.col("block").cast("bigint") * 2**24 + F.col("bin")
        numbered = tried.withColumn("sequence_id", named)
        parts.append(numbered.filter(F.col("fill") == capacity).select("rid", "sequence_id", "offset"))
        rest = numbered.filter(F.col("fill") < capacity).select("rid", "length", "sequence_id", "offset")
        count, used, number = made["left"], made["open"], number + 1
    # what is left open stays as the last round that saved sequences put it
    parts.append(rest.select("rid", "sequence_id", "offset"))
    sequences = parts[0]
    for part in parts[1:]:
        sequences = sequences.unionByName(part)
    return placed.join(sequences, "rid").select(*[F.col(f"`{c}`") for c in kept], "sequence_id", "offset")


def best_fit_packing(docs: DataFrame, path: str) -> DataFrame:
    """One row per piece of each document."""
    return pack(pieces(docs, path)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


