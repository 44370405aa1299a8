"""Exact duplicates by composable polynomial fingerprints.

A text is a string of 16-bit symbols; its fingerprint is the value of that polynomial at a fixed
point, modulo two primes. Pieces of 64 KiB are hashed independently of each other and combine by
shifting: the hash of A followed by B is hash(A) * base ** len(B) + hash(B). The pieces of a huge
text are rows of their own, which are hashed by different tasks and combined by text; a text of less
is hashed where it is. Texts that agree in fingerprint and length are then compared piece by piece
with the first text of their run in a sorted stream, so a collision never merges different texts.

Only texts of repeated fingerprints are shuffled. Where these are too many to be broadcast, a Bloom
filter of them is (of a bounded size: beyond it more texts pass, and the join drops them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, blocks, cut, mixed

PRIMES, BASES = (2147483647, 2147483629), (1103515245, 1664525013)
#: Symbols (of two bytes) in a piece: 2**15 products of 16 and 31 bits add up to less than 2**63.
PIECE = 1 << 15
#: Bytes of a text beyond which its pieces are hashed by different tasks.
HUGE = 64 * 2 * PIECE
#: Rows of one fingerprint beyond which the comparison is spread over several tasks: as many parts as a part then has rows.
HOT_GROUP = 100
#: Bits of the Bloom filter by fingerprint, its most bits (128 MB), and those that one task makes.
BITS, MOST_BITS, CHUNK = 16, 1 << 30, 1 << 16
_SPACE = frozenset(b" \t\n\x0b\x0c\r")


def _power_table(base: int, prime: int) -> np.ndarray:
    powers = [1]
    for _ in range(PIECE - 1):
        powers.append(powers[-1] * base % prime)
    return np.array(powers[::-1], np.int64)


_TABLES = [_power_table(b, p) for b, p in zip(BASES, PRIMES, strict=True)]


def normalised(text: bytes) -> bytes:
    """Each run of the white space `[\\x20\\x09-\\x0D]` becomes one space, at the ends too."""
    words = text.split()
    if not words:
        return b" " if text else b""
    return b" " * (text[0] in _SPACE) + b" ".join(words) + b" " * (text[-1] in _SPACE)


def combine(a: tuple[int, int], b: tuple[int, int], b_symbols: int) -> tuple[int, int]:
    """The hash of A followed by B, from their hashes and B's length in symbols."""
    return tuple((x * pow(base, b_symbols, prime) + y) % prime for x, y, base, prime in zip(a, b, BASES, PRIMES, strict=True))


def polynomial(data: bytes) -> tuple[int, int]:
    """The hash of the symbols of data (an odd last byte is padded; the length tells such texts apart)."""
    symbols = np.frombuffer(data + b"\0" * (len(data) % 2), "<u2").astype(np.int64)
    whole = len(symbols) // PIECE
    pieces = symbols[: whole * PIECE].reshape(whole, PIECE)
    found = [(pieces @ table) % prime for table, prime in zip(_TABLES, PRIMES, strict=True)]
    h = (0, 0)
    for i in range(whole):
        h = combine(h, (int(found[0][i]), int(found[1][i])), PIECE)
    if rest := len(symbols) - whole * PIECE:
        tail = symbols[whole * PIECE :]
        h = combine(h, tuple(int(tail @ table[PIECE - rest :]) % prime for table, prime in zip(_TABLES, PRIMES, strict=True)), rest)
    return h


def _fp(data: bytes) -> int:
    a, b = polynomial(data)
    return a << 31 | b


def _same(a: bytes, b: bytes) -> bool:
    """Piece by piece, up to the first that differs."""
    if len(a) != len(b):
        return False
    a, b, step = memoryview(a), memoryview(b), 2 * PIECE
    return all(a[at : at + step] == b[at : at + step] for at in range(0, len(a), step))


def _hashes(batches: Iterator[pa.RecordBatch], huge: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, fp, size, sha) of each text; fp is null for huge ones."""
    for rows, texts in blocks(batches, "text"):
        norm = [normalised(t) for t in texts]
        fp = [None if len(t) > huge else _fp(n) for t, n in zip(texts, norm, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), pa.array(fp, pa.int64()), pa.array([len(t) for t in norm], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in norm])],
            ["doc_id", "fp", "size", "sha"],
        )


def _marks(fp: np.ndarray, size: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each fingerprint and length in a filter of so many bits (a power of two)."""
    h = mixed(fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + size.view(np.uint64))
    return tuple((x & np.uint64(bits - 1)).astype(np.int64) for x in (h, h >> np.uint64(32)))


def _marked(marks: np.ndarray, fp: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each may be in the filter; all that were put in are."""
    return np.logical_and(*(marks[x >> 3] >> (x & 7).astype(np.uint8) & 1 for x in _marks(fp, size, 8 * len(marks))))


def bloom_filter(groups: DataFrame, rows: int, most_bits: int = MOST_BITS) -> np.ndarray:
    """A filter of the (fp, size) of groups as bytes; each chunk of it is made by a task, and the driver puts them together."""
    bits = max(CHUNK, min(most_bits, 1 << (BITS * rows - 1).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_marks(batch.column("fp").to_numpy(), batch.column("size").to_numpy(), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at // CHUNK), pa.array(at % CHUNK)], ["chunk", "place"])

    def chunk(table: pa.Table) -> pa.Table:
        set_ = np.zeros(CHUNK, bool)
        set_[table.column("place").to_numpy()] = True
        return pa.table({"chunk": table.column("chunk")[:1], "bits": pa.array([np.packbits(set_, bitorder="little").tobytes()])})

    made = groups.select("fp", "size").mapInArrow(places, "chunk long, place long").groupBy("chunk").applyInArrow(chunk, "chunk long, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in made.toLocalIterator():
        out[row["chunk"] * CHUNK // 8 :][: CHUNK // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def _texts(batches: Iterator[pa.RecordBatch], marks: Broadcast | None = None) -> Iterator[pa.RecordBatch]:
    """(doc_id, fp, size, data) of the texts, of those only that may be in the filter `marks` if there is one."""
    for rows, texts in blocks(batches, "text"):
        norm = [normalised(t) for t in texts]
        found = pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([_fp(t) for t in norm], pa.int64()), pa.array([len(t) for t in norm], pa.int64()), pa.array(norm, pa.binary())], ["doc_id", "fp", "size", "data"])
        yield found.filter(pa.array(_marked(marks.value, found.column("fp").to_numpy(), found.column("size").to_numpy()))) if marks else found


def _huge_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Like _texts, with the SHA-256 in place of the fingerprint."""
    for rows, texts in blocks(batches, "text"):
        norm = [normalised(t) for t in texts]
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([hashlib.sha256(t).hexdigest() for t in norm]), pa.array([len(t) for t in norm], pa.int64()), pa.array(norm, pa.binary())], ["doc_id", "sha", "size", "data"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, sha, size, at, piece): the pieces of each text."""
    step = 2 * PIECE
    for rows, texts in blocks(batches, "text"):
        for row, text in zip(rows.column("row").to_pylist(), texts, strict=True):
            norm = normalised(text)
            sha = hashlib.sha256(norm).hexdigest()
            for at in range(0, len(norm), step):
                yield pa.RecordBatch.from_pylist([{"row": row, "sha": sha, "size": len(norm), "at": at, "piece": norm[at : at + step]}])


def _hashed_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sha, size, at, a, b, shift_a, shift_b): the two hashes of each piece, and what those of the text before it are multiplied by."""
    for rows, pieces in blocks(batches, "piece"):
        found = [(*polynomial(x), *(pow(base, -(-len(x) // 2), prime) for base, prime in zip(BASES, PRIMES, strict=True))) for x in pieces]
        columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("sha", "size", "at")), *columns], ["sha", "size", "at", "a", "b", "shift_a", "shift_b"])


def huge_fingerprints(docs: DataFrame) -> DataFrame:
    """(sha, size, fp) of each different normalised text of docs (column text), its pieces hashed as rows and then combined.

    A text's hashes are gathered in order of its pieces: some 40 bytes for every 64 KiB of it.
    """
    pieces = docs.select(F.monotonically_increasing_id().alias("row"), "text").mapInArrow(_pieces, "row long, sha string, size long, at long, piece binary")
    hashed = pieces.repartition("row", "at").mapInArrow(_hashed_pieces, "sha string, size long, at long, a long, b long, shift_a long, shift_b long")
    hashed = hashed.dropDuplicates(["sha", "size", "at"]).groupBy("sha", "size").agg(F.array_sort(F.collect_list(F.struct("at", "a", "b", "shift_a", "shift_b"))).alias("pieces"))
    none = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    whole = F.aggregate("pieces", none, lambda h, p: F.struct(((h["a"] * p["shift_a"] + p["a"]) % PRIMES[0]).alias("a"), ((h["b"] * p["shift_b"] + p["b"]) % PRIMES[1]).alias("b")))
    return hashed.select("sha", "size", whole.alias("h")).select("sha", "size", (F.shiftleft("h.a", 31).bitwiseOR(F.col("h.b"))).alias("fp"))


_CLASSED = "doc_id long, fp long, size long, part long, class int, of_part long, of_class int, again boolean, sha string, data binary"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (fp, size, part, doc_id) get the number of their text within (fp, size, part). data stays with the first of a text if its group has several parts."""
    at, first, previous = None, [], None
    for rows, texts in blocks(batches, "data"):
        ids, keys = rows.column("doc_id").to_pylist(), list(zip(*(rows.column(c).to_pylist() for c in ("fp", "size", "part")), strict=True))
        parts = rows.column("parts").to_pylist()
        classes, again, shas, kept = [], [], [], []
        for key, doc, text, several in zip(keys, ids, texts, parts, strict=True):
            if key != at:
                at, first, previous = key, [], None
            cls = next((i for i, (x, _) in enumerate(first) if _same(x, text)), len(first))
            new = cls == len(first)
            if new:
                first.append((text, hashlib.sha256(text).hexdigest()))
            classes.append(cls)
            again.append((doc, cls) == previous)
            previous = (doc, cls)
            shas.append(first[cls][1])
            kept.append(text if new and several > 1 else None)
        columns = [rows.column(c) for c in ("doc_id", "fp", "size", "part")] + [pa.array(classes, pa.int32()), rows.column("of_part"), rows.column("of_class"), pa.array(again), pa.array(shas), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "size", "part", "class", "of_part", "of_class", "again", "sha", "data"])


def _classed(rows: DataFrame) -> DataFrame:
    return rows.repartition("fp", "size", "part").sortWithinPartitions("fp", "size", "part", "doc_id").mapInArrow(_compare, _CLASSED)


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", huge: int = HUGE, direct: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per row of docs.

    Texts are equal when identical after each run of white space becomes one space; null counts as
    empty. Of equal texts the row with the smallest doc_id stays (one of them if that doc_id repeats);
    a null doc_id stays only where no row of the group has one. Texts that nothing repeats are not
    shuffled, but for the pieces of texts of more than `huge` bytes and, where more than `direct`
    fingerprints repeat, the few that pass a Bloom filter by chance. An empty table gives no rows; other
    columns are not read.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    each = cut(docs.mapInArrow(partial(_hashes, huge=huge), "doc_id long, fp long, size long, sha string"))
    is_huge = F.coalesce(F.octet_length("text"), F.lit(0)) > huge
    found = None
    if not each.where("fp IS NULL").isEmpty():
        found = cut(huge_fingerprints(docs.where(is_huge)))
        long = each.where("fp IS NULL").drop("fp").join(found, ["sha", "size"])
        each = cut(each.where("fp IS NOT NULL").unionByName(long))
    groups = cut(each.groupBy("fp", "size").agg(F.count("*").alias("n")).where("n > 1"))
    repeated, marks = groups.count(), None
    if repeated <= direct:
        groups = F.broadcast(groups)
    else:
        marks = docs.sparkSession.sparkContext.broadcast(bloom_filter(groups, repeated))
    data = docs.where(~is_huge).mapInArrow(partial(_texts, marks=marks), "doc_id long, fp long, size long, data binary")
    if found is not None:
        long = docs.where(is_huge).mapInArrow(_huge_texts, "doc_id long, sha string, size long, data binary").join(found, ["sha", "size"])
        data = data.unionByName(long.drop("sha"))
    alone = each.join(groups, ["fp", "size"], "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))

    rows = data.join(groups, ["fp", "size"])
    rows = rows.withColumn("parts", F.when(F.col("n") > HOT_GROUP, F.ceil(F.sqrt("n"))).otherwise(F.lit(1)).cast("long")).withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts"))
    rows = cut(_classed(rows.withColumns({"of_part": F.lit(None).cast("long"), "of_class": F.lit(None).cast("int")})))
    # the first texts of the parts of a large group meet; what they are is what their parts are
    heads = rows.where("data is not null").select("doc_id", "fp", "size", "data", F.col("part").alias("of_part"), F.col("class").alias("of_class"), F.lit(0).cast("long").alias("part"), F.lit(1).cast("long").alias("parts"))
    whole = _classed(heads).select("fp", "size", F.col("of_part").alias("part"), F.col("of_class").alias("class"), F.col("class").alias("whole"))
    rows = rows.drop("data").join(whole, ["fp", "size", "part", "class"], "left").withColumn("class", F.coalesce("whole", "class"))
    classes = rows.groupBy("fp", "size", "class").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    dups = rows.join(classes, ["fp", "size", "class"]).select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("again")).alias("kept"), F.col("sha").alias("text_sha256"))
    return alone.unionByName(dups)
