"""Packing documents into training sequences by the sum-of-squares rule.

While documents arrive, the open windows (sequences that are partly filled) are known by how full
they are: levels[f] counts those with f tokens. A document goes to the level, or to a new window,
that leaves the sum of the squared counts smallest, which keeps many different levels in stock, so
that what comes next finds a window that it fills. Documents longer than a window fill whole windows
first. When a partition ends, windows of a power of two stay, as they need no padding; of the others
the emptiest is dissolved, and its pieces go by the same rule to those that are left (one that fits
none fills the fullest, and its rest goes on), until one is left, which is cut into powers of two.

Every partition packs the documents that it reads, in their order: nothing is shuffled, and a lost
task packs the same sequences again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks
from .tokens import encoder, read_tokenizer

CAPACITY = 2048
#: Open windows of a partition beyond which they are finished (only documents that never fit each other come to so many).
OPEN = 4_096

Piece = tuple[object, int, bytes, int]  # doc_id, start, ids, tokens of the document


class Packer:
    """Places documents into windows of `capacity` tokens; finished ones collect in `done`, each a list of pieces."""

    def __init__(self, capacity: int = CAPACITY, most_open: int = OPEN):
        self.capacity, self.most_open = capacity, most_open
        self.levels = np.zeros(capacity + 1, np.int64)
        self.windows: dict[int, list[list[Piece]]] = {}
        self.open = 0
        self.done: list[list[Piece]] = []

    def level_for(self, n: int, new: bool = True) -> int | None:
        """The level (0: a new window) that takes n tokens with the least growth of the sum of squares; of equals the fullest. Without `new`, None where no open window takes them."""
        here, there = self.levels[: self.capacity - n + 1], self.levels[n:]
        none = np.iinfo(np.int64).max
        growth = np.where(here > 0, 2 * (there - here) + 2, none)
        if here[-1] > 0:
            growth[-1] = 1 - 2 * here[-1]  # it gets full and is no longer counted
        growth[0] = none if not new else 2 * there[0] + 1 if n < self.capacity else 0
        best = len(growth) - 1 - int(np.argmin(growth[::-1]))
        return None if growth[best] == none else best

    def _take(self, level: int) -> list[Piece]:
        """A window of the level, no longer open."""
        self.levels[level] -= 1
        self.open -= 1
        return self.windows[level].pop()

    def _put(self, level: int, piece: Piece) -> None:
        """The piece into a window of the level (0: a new one)."""
        window = self._take(level) if level else []
        window.append(piece)
        level += len(piece[2]) // 4
        if level == self.capacity:
            self.done.append(window)
        else:
            self.windows.setdefault(level, []).append(window)
            self.levels[level] += 1
            self.open += 1

    def add(self, doc: object, ids: bytes) -> None:
        n = len(ids) // 4
        start = 0
        while n - start >= self.capacity:
            self.done.append([(doc, start, ids[4 * start : 4 * (start + self.capacity)], n)])
            start += self.capacity
        if start == n:
            return
        self._put(self.level_for(n - start), (doc, start, ids[4 * start :], n))
        if self.open > self.most_open:
            self.finish()

    def finish(self) -> None:
        """Close what is open, as the module says; no window is padded."""
        for level in (1 << b for b in range(self.capacity.bit_length() - 1)):
            while self.levels[level]:
                self.done.append(self._take(level))
        while self.open > 1:
            for piece in self._take(int(np.argmax(self.levels > 0))):
                self._put_again(piece)
        if self.open:
            level = int(np.argmax(self.levels > 0))
            self._cut(self._take(level), [1 << b for b in range(level.bit_length() - 1, -1, -1) if level >> b & 1])

    def _put_again(self, piece: Piece) -> None:
        """The piece into open windows, as long as there are any."""
        doc, start, ids, n = piece
        while ids:
            level = self.level_for(len(ids) // 4, new=not self.open)
            size = len(ids) if level is not None else 0
            if level is None:
                level = self.capacity - int(np.argmax(self.levels[::-1] > 0))
                size = 4 * (self.capacity - level)
            self._put(level, (doc, start, ids[:size], n))
            start, ids = start + size // 4, ids[size:]

    def _cut(self, window: list[Piece], sizes: list[int]) -> None:
        """A window's pieces into windows of these sizes."""
        pieces = iter(window)
        doc, start, ids, n = next(pieces)
        for size in sizes:
            part = []
            while size:
                take = min(size, len(ids) // 4)
                if take:
                    part.append((doc, start, ids[: 4 * take], n))
                    start, ids, size = start + take, ids[4 * take :], size - take
                else:
                    doc, start, ids, n = next(pieces)
            self.done.append(part)


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long"


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of a document: (doc_id, start, length, ids, doc_tokens, sequence_id, offset, sequence_length).

    tokenizer: path of a tokenizer file whose tokenizer drops white space. A document's tokens are its
    ids and end_id; ids holds the piece's, little-endian unsigned 32-bit; start counts the document's
    tokens before it, offset the sequence's. Sequences hold `capacity` tokens or a power of two (capacity must be one). Null
    texts are empty: one token. Null and repeated doc_ids are kept as they are, each row its own
    document. An empty table gives no rows; other columns are not read.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    content = read_tokenizer(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(content, blanks_matter=False), Packer(capacity)
        sequence = TaskContext.get().partitionId() << 32

        def rows() -> pa.RecordBatch:
            nonlocal sequence
            out: list[list] = [[] for _ in range(8)]
            for window in packer.done:
                offset, filled = 0, sum(len(p[2]) // 4 for p in window)
                for doc, start, ids, n in window:
                    for column, x in zip(out, (doc, start, len(ids) // 4, ids, n, sequence, offset, filled), strict=True):
                        column.append(x)
                    offset += len(ids) // 4
                sequence += 1
            packer.done.clear()
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 4
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

        for part, texts in blocks(batches, "text"):
            ids, sizes = encode(texts)
            ends = np.cumsum(sizes)
            data, ends = np.insert(ids, ends, end_id).astype("<u4").tobytes(), 4 * (ends + np.arange(1, len(ends) + 1))
            for doc, low, high in zip(part.column("doc_id").to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                packer.add(doc, data[low:high])
            yield rows()
        packer.finish()
        yield rows()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)
