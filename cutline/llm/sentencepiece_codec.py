"""Encoding and decoding with a SentencePiece vocabulary, by unigram Viterbi.

The pieces, with the log scores of the model file, stand in a double-array trie over their UTF-8
bytes. A text's best segmentation is the path of the highest total score; a character that no piece
covers becomes byte pieces. White space is written as the marker U+2581. Where no piece goes from
another character into a marker, a marker that follows another character begins a new segment in
every segmentation: segments are encoded one by one, and a worker encodes all new ones of a slice
together, position by position, remembering what it has encoded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks

MARK = "▁".encode()
#: Kinds of pieces in a model file, and what an unknown character costs below the lowest score.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
REMEMBERED, LONGEST = 300_000, 200


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The (number, value) fields of a serialised message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class Vocabulary:
    """Pieces with scores and kinds, and the options of the normaliser."""

    pieces: list[bytes]
    scores: np.ndarray
    kinds: list[int]
    dummy_prefix: bool = True

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """From a model file; one that rewrites characters or strips white space is refused."""
        pieces, scores, kinds, options = [], [], [], {}
        for number, value in _fields(Path(path).read_bytes()):
            if number == 1:
                one = dict(_fields(value))
                pieces.append(one[1])
                scores.append(np.frombuffer(one.get(2, bytes(4)), "<f4")[0])
                kinds.append(one.get(3, NORMAL))
            elif number == 3:
                options = dict(_fields(value))
        if options.get(2) or options.get(4, 1):
            raise ValueError("only models with the identity normaliser that keep all white space")
        return cls(pieces, np.array(scores, float), kinds, bool(options.get(3, 1)))


class DoubleArray:
    """A trie in two arrays: the child of state s over code c is base[s] + c if check there is s. value: the key's number or -1."""

    def __init__(self, keys: dict[bytes, int]):
        nodes: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for key, number in keys.items():
            node = 0
            for b in key:
                if b not in nodes[node]:
                    nodes[node][b] = len(nodes)
                    nodes.append({})
                node = nodes[node][b]
            ends[node] = number
        n = len(nodes) * 2 + 512
        self.base, self.check, self.value = np.zeros(n, np.int32), np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        used, low, place = bytearray(n), 1, {0: 0}
        used[0] = 1
        self.value[0] = ends.get(0, -1)
        for node in range(len(nodes)):  # parents come before their children
            codes = [b + 1 for b in nodes[node]]
            if not codes:
                continue
            while used[low]:
                low += 1
            first, at = min(codes), low
            while any(used[at - first + c] for c in codes):
                at = used.index(0, at + 1)
            base = at - first
            state = place[node]
            self.base[state] = base
            for b, child in nodes[node].items():
                slot = base + b + 1
                used[slot] = 1
                self.check[slot], place[child] = state, slot
                self.value[slot] = ends.get(child, -1)


class Codec:
    """Encodes and decodes with a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = v = vocabulary
        usable = {p: i for i, (p, k) in enumerate(zip(v.pieces, v.kinds, strict=True)) if k in (NORMAL, USER_DEFINED) and p}
        self.trie = DoubleArray(usable)
        self.longest = max(map(len, usable), default=1)
        normal = [s for s, k in zip(v.scores, v.kinds, strict=True) if k == NORMAL]
        self.scores = v.scores.copy()
        self.scores[[i for i, k in enumerate(v.kinds) if k == USER_DEFINED]] = 0.0
        self.unknown_score = min(normal, default=0.0) - UNKNOWN_PENALTY
        self.unknown = next((i for i, k in enumerate(v.kinds) if k == UNKNOWN), 0)
        by = {p: i for i, (p, k) in enumerate(zip(v.pieces, v.kinds, strict=True)) if k == BYTE}
        self.bytes = [by.get(b"<0x%02X>" % b) for b in range(256)]
        self.fallback = all(x is not None for x in self.bytes)
        self.split = not any("▁" in p.decode("utf-8", "replace").lstrip("▁") for p in usable)
        self._segment = re.compile(b"(?:%b)*(?:(?!%b).)+|(?:%b)+" % (MARK, MARK, MARK), re.DOTALL)
        self._known: dict[bytes, tuple[bytes, float]] = {}
        self._spelt = [b"" if k == CONTROL else bytes([int(p[1:-1], 16)]) if k == BYTE else p.replace(MARK, b" ") for p, k in zip(v.pieces, v.kinds, strict=True)]

    def _viterbi(self, segments: list[bytes]) -> Iterator[tuple[bytes, float]]:
        """The ids (32-bit) and score of each; all at once, one starting position after the other."""
        n, width = len(segments), max(map(len, segments))
        text = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in segments), np.uint8).reshape(n, width).astype(np.int32) + 1
        lengths = np.fromiter(map(len, segments), np.int64, n)
        text[np.arange(width)[None, :] >= lengths[:, None]] = 0
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        came, piece = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
        lead = text - 1
        char = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for s in range(width):
            rows = np.flatnonzero(best[:, s] > -np.inf)
            rows = rows[lengths[rows] > s]
            if not len(rows):
                continue
            all_rows, state, single = rows, np.zeros(len(rows), np.int32), np.zeros(n, bool)
            for end in range(s + 1, min(width, s + self.longest) + 1):
                nxt = base[state] + text[rows, end - 1]
                ok = (text[rows, end - 1] > 0) & (check[nxt] == state)
                rows, state = rows[ok], nxt[ok]
                if not len(rows):
                    break
                hit = value[state] >= 0
                at, which = rows[hit], value[state[hit]]
                total = best[at, s] + self.scores[which]
                better = total > best[at, end]
                best[at[better], end], came[at[better], end], piece[at[better], end] = total[better], s, which[better]
                single[at[char[at, s] == end - s]] = True
            at = all_rows[~single[all_rows]]
            if len(at):
                end = np.minimum(s + char[at, s], lengths[at])
                total = best[at, s] + self.unknown_score
                better = total > best[at, end]
                at, end = at[better], end[better]
                best[at, end], came[at, end], piece[at, end] = total[better], s, self.unknown
        for i, (segment, length) in enumerate(zip(segments, lengths.tolist(), strict=True)):
            ids: list[int] = []
            end, back, which = length, came[i].tolist(), piece[i].tolist()
            while end:
                start = back[end]
                if which[end] == self.unknown and self.fallback:
                    ids += [self.bytes[b] for b in reversed(segment[start:end])]
                else:
                    ids.append(which[end])
                end = start
            yield np.array(ids[::-1], "<i4").tobytes(), float(best[i, length])

    def encode(self, texts: list[bytes]) -> list[tuple[bytes, float]]:
        """Each text's ids (little-endian 32-bit) and the score of its segmentation."""
        cut = []
        for t in texts:
            t = t.replace(b" ", MARK)
            t = MARK + t if t and self.vocabulary.dummy_prefix else t
            cut.append(self._segment.findall(t) if self.split else [t] if t else [])
        known = self._known
        new = list({s for segments in cut for s in segments} - known.keys())
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list({s for segments in cut for s in segments})
        new.sort(key=len)
        at = 0
        while at < len(new):
            to, width = at, max(8, len(new[at]) * 5 // 4)
            while to < len(new) and len(new[to]) <= width and (to - at) * width <= 1 << 20:
                to += 1
            known.update(zip(new[at:to], self._viterbi(new[at:to]), strict=True))
            at = to
        out = []
        for segments in cut:
            found = [known[s] for s in segments]
            out.append((b"".join([x[0] for x in found]), sum([x[1] for x in found])))
        for s in reversed(new):
            if len(s) <= LONGEST:
                break
            del known[s]
        return out

    def decode(self, ids: bytes) -> bytes:
        """The text of ids in UTF-8; bytes that are no UTF-8 become U+FFFD."""
        spelt = b"".join(map(self._spelt.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        if self.vocabulary.dummy_prefix and spelt[:1] == b" ":
            spelt = spelt[1:]
        return spelt.decode("utf-8", "replace").encode()


_codecs: dict[int, Codec] = {}


def _on_worker(broadcast) -> Codec:
    key = id(broadcast.value)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(broadcast.value)
    return _codecs[key]


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, ids, score): ids as little-endian 32-bit numbers; score of the best segmentation.

    model: path of a model file (sent to the workers: a vocabulary does not grow with the data). Null
    and empty texts have no ids and score 0. Every row gives one row, whatever its doc_id. An empty
    table gives no rows; other columns are not read.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _on_worker(vocabulary)
        for rows, texts in blocks(batches, "text"):
            found = codec.encode(texts)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text"), pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "text", "ids", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, text string, ids binary, score double")


def decode(encoded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """The rows with a column `decoded`: the text of the ids (null: empty)."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(Vocabulary.read(model))
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def text(ids):
        codec = _on_worker(vocabulary)
        return ids.map(lambda x: codec.decode(x or b"").decode())

    return encoded.withColumn("decoded", text(ids))
