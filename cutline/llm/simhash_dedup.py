"""SimHash near-duplicates by multi-index hashing.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Two
fingerprints that differ in at most 3 of 64 bits differ in at most one bit of their left or of their
right half. So each half is a table: a fingerprint is filed under its half and looked up under every
value within one bit of it. Of two values one bit apart one has the other's bits less one, so the
ball that is enumerated is the value itself and the value less one set bit. Whatever meets under a
key is compared over all 64 bits.

Only distinct fingerprints are looked up, so exact copies cost one row. Under a key, only the links
of a spanning forest leave (never all pairs), and a key that very many fingerprints share is split
by the halves of the other half, in which two of them differ by at most one bit again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, cut, small, text_hashes
from .components import connected_components

DISTANCE = 3
#: Fingerprints under one key beyond which the key is split into finer ones.
HOT_KEY = 20_000
#: Under one key, so many are compared each with each; more are first dealt out by finer keys.
DIRECT = 2_048


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Of a whole text, unsigned; 0 for a text without words, of one shingle for one of few words."""
    norm = b" ".join(text.lower().split())
    if not norm:
        return 0
    spaces = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    starts, ends = [0, *(spaces + 1).tolist()], [*spaces.tolist(), len(norm)]
    if len(starts) < shingle:
        starts, ends = [0], [len(norm)]
    else:
        ends = ends[shingle - 1 :]
    of, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(ends)
    for at in range(0, n, 1 << 15):
        h = np.array([of(norm[a:b], seed) for a, b in zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)], strict=False)], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, text_hash): one row per document, the fingerprint as a signed long, and see text_hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks(batches, "text"):
            found = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(found), text_hashes(texts)], ["doc_id", "fp", "text_hash"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long, text_hash long")


def _ball(value: Column, bits: int) -> Column:
    """value, and value less each of its set bits."""
    cleared = F.transform(F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.call_function("getbit", value, i) == 1), lambda i: value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    return F.concat(F.array(value), cleared)


def _under(fp: str, at: int, bits: int) -> Column:
    """Keys of the bits of fp from `at` on; the keys of different positions differ."""
    value = F.shiftrightunsigned(F.col(fp), at).bitwiseAND(F.lit((1 << bits) - 1))
    return F.transform(_ball(value, bits), lambda x: x + F.lit(at << 33))


def _other(key: int) -> tuple[int, int]:
    """Where the two quarters begin that a key does not hold."""
    return (32, 48) if key < 32 << 33 else (0, 16)


def _finer(at: tuple[int, int]) -> Column:
    """For a hot key, keys that hold a quarter more; they are negative."""
    return F.transform(F.concat(*(_under("fp", x, 16) for x in at)), lambda x: F.xxhash64("key", x).bitwiseOR(F.lit(-(1 << 63))))


class _Forest:
    """Links between the members of one run that join what was not joined yet."""

    def __init__(self, fps: np.ndarray):
        self.fps, self.up, self.links = fps, list(range(len(fps))), []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def compare(self, at: np.ndarray) -> None:
        """Each of these members with each, some rows at a time."""
        fps = self.fps[at]
        step = max(1, (1 << 22) // len(at))
        for low in range(0, len(at), step):
            near = np.bitwise_count(fps[low : low + step, None] ^ fps[None, :]) <= DISTANCE
            first = low + np.arange(len(near))
            near[np.arange(len(fps))[None, :] >= first[:, None]] = False
            for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
                a, b = int(at[low + i]), int(at[j])
                ra, rb = self.root(a), self.root(b)
                if ra != rb:
                    self.up[ra] = rb
                    self.links.append((a, b))

    def run(self, key: int) -> list[tuple[int, int]]:
        n = len(self.fps)
        if n <= DIRECT or key < 0:
            self.compare(np.arange(n))
            return self.links
        for at in _other(key):
            value = (self.fps >> np.uint64(at)) & np.uint64(0xFFFF)
            who, keys = [np.arange(n)], [value]
            for bit in range(16):
                has = np.flatnonzero((value >> np.uint64(bit)) & np.uint64(1))
                who.append(has)
                keys.append(value[has] ^ np.uint64(1 << bit))
            who, keys = np.concatenate(who), np.concatenate(keys)
            order = np.argsort(keys, kind="stable")
            for part in np.split(who[order], np.flatnonzero(np.diff(keys[order])) + 1):
                if len(part) > 1:
                    self.compare(part)
        return self.links


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key: links within each run of a key."""
    held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def found(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        edges = np.flatnonzero(np.diff(k)) + 1
        starts, sizes = np.concatenate([[0], edges]), np.diff(np.concatenate([[0], edges, [len(k)]]))
        two = starts[sizes == 2]
        two = two[(np.bitwise_count(f[two] ^ f[two + 1]) <= DISTANCE) & (f[two] != f[two + 1])]
        u, v = [f[two]], [f[two + 1]]
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            fps = np.unique(f[s : s + n])
            if links := _Forest(fps).run(int(k[s])):
                a, b = np.array(links).T
                u.append(fps[a])
                v.append(fps[b])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (u, v)], ["u", "v"])

    for batch in batches:
        k = np.concatenate([held_k, batch.column("key").to_numpy()])
        f = np.concatenate([held_f, batch.column("fp").to_numpy().view(np.uint64)])
        if not len(k):
            continue
        last = int(np.searchsorted(k, k[-1]))
        held_k, held_f = k[last:], f[last:]
        if last:
            yield found(k[:last], f[:last])
    if len(held_k):
        yield found(held_k, held_f)


def links(fps: DataFrame) -> DataFrame:
    """(u, v): of the distinct fingerprints in column fp, links that join all that are within DISTANCE bits, directly or over others."""
    probes = fps.select("fp", F.explode(F.concat(_under("fp", 0, 32), _under("fp", 32, 32))).alias("key"))
    hot = cut(probes.groupBy("key").count().where(F.col("count") > HOT_KEY).select("key", F.lit(True).alias("hot")))
    if n := hot.count():
        probes = probes.join(small(hot, n), "key", "left")
        finer = F.when(F.col("key") < F.lit(32 << 33), _finer((32, 48))).otherwise(_finer((0, 16)))
        probes = probes.select("fp", F.explode(F.when(F.col("hot"), finer).otherwise(F.array("key"))).alias("key"))
    return probes.repartition("key").sortWithinPartitions("key").select("key", "fp").mapInArrow(_links, "u long, v long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", text_hash: bool = False) -> DataFrame:
    """(doc_id, fingerprint, component_id, and text_hash if wanted): one row per row of docs.

    component_id is the smallest doc_id that can be reached over links of at most 3 differing bits, the
    document itself included. Null texts count as empty; texts without words have fingerprint zero and
    link like others. A null doc_id keeps its row and is never a component's id unless there is no
    other (then null). Repeated rows are repeated in the result; text_hash (XXH64 of the text, seed 42) tells rows of one doc_id apart. An empty table gives no rows; other
    columns are not read.
    """
    each = cut(fingerprints(docs, doc_id, text))
    distinct = cut(each.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = connected_components(links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    classes = distinct.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    ids = classes.groupBy("label").agg(F.min("first").alias("component_id"))
    by = classes.select("fp", "label").join(ids, "label").select("fp", "component_id")
    return each.join(by, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", *["text_hash"] * text_hash)
