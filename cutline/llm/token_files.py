"""Token files: Arrow IPC files whose batches hold equal-length sequences.

A file holds the token stream of a range of doc_ids, cut into sequences of one length: a fixed-size
list of ids, and a fixed-size list of as many mask values, Arrow booleans of a bit each (false: padding,
at the end of a file only). Such columns are plain buffers, so ids and mask of sequence i of a
memory-mapped file are slices of the mapping: nothing is decoded or copied. Beside it lies a small
Arrow file with each document's place. Files are written by the tasks of a range-partitioned sort,
under names of their own; what is listed in the manifest is what finished tasks wrote.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, cut, new_dir, partitions
from .tokens import encoder, read_tokenizer

LENGTH = 2048
#: Sequences of a batch.
ROWS = 128
_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def file_schema(length: int, small_ids: bool) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint16() if small_ids else pa.uint32(), length)), ("mask", pa.list_(pa.bool_(), length))])


class _Writer:
    """Cuts a stream of ids into sequences and writes full batches."""

    def __init__(self, sink, length: int, small_ids: bool):
        self.length, self.schema, self.kind = length, file_schema(length, small_ids), np.uint16 if small_ids else np.uint32
        self.out, self.held, self.size = pa.ipc.new_file(sink, self.schema), [], 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind))
        self.size += len(ids)
        if self.size >= 2 * ROWS * self.length:
            flat = np.concatenate(self.held)
            whole = len(flat) // (ROWS * self.length) * ROWS * self.length
            for at in range(0, whole, ROWS * self.length):
                self._write(flat[at : at + ROWS * self.length], ROWS * self.length)
            self.held, self.size = [flat[whole:]], len(flat) - whole

    def _write(self, flat: np.ndarray, valid: int) -> None:
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(flat)) < valid), self.length)
        self.out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(flat), self.length), mask], schema=self.schema))

    def close(self) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, self.kind)
        for at in range(0, len(flat), ROWS * self.length):
            part = flat[at : at + ROWS * self.length]
            full = np.zeros(-(-len(part) // self.length) * self.length, self.kind)
            full[: len(part)] = part
            self._write(full, len(part))
        self.out.close()


class TokenFile:
    """Random access to the sequences of one file; `source` is a local path (memory-mapped) or an open Arrow file."""

    def __init__(self, source):
        self.reader = pa.ipc.open_file(pa.memory_map(source) if isinstance(source, str) else source)
        self.length = self.reader.schema.field("ids").type.list_size

    def batch(self, i: int) -> pa.RecordBatch:
        return self.reader.get_batch(i)

    def sequence(self, i: int) -> np.ndarray:
        """The ids of sequence i, a view of the file."""
        at = i % ROWS * self.length
        return self.batch(i // ROWS).column("ids").values.to_numpy(zero_copy_only=True)[at : at + self.length]

    def mask(self, i: int) -> pa.BooleanArray:
        """True for each id of sequence i, false for padding; a slice of the file's bits."""
        return self.batch(i // ROWS).column("mask").values.slice(i % ROWS * self.length, self.length)

    def stream(self) -> Iterator[np.ndarray]:
        """All ids in order, without padding, a batch at a time."""
        for i in range(self.reader.num_record_batches):
            batch = self.batch(i)
            yield batch.column("ids").values.to_numpy(zero_copy_only=True)[: batch.column("mask").values.true_count]


def write_token_files(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 0, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the documents' ids, each document's followed by end_id, in ascending doc_id order; return the manifest.

    tokenizer: path of a byte-level tokenizer file. path: a folder that driver and executors share (by
    default a new one in the shared folder). Manifest: (part, ids_path, index_path, n_docs, n_tokens),
    one row per file, part ascending with doc_id. Ids are 16-bit where the vocabulary allows, else
    32-bit. Null texts are empty; null doc_ids come first; rows that repeat a doc_id (or null) follow each
    other in the order of a hash of their texts, by which they may also fall into several files. An empty
    table writes no file. Other columns are not read. The files grow in number with the input.
    """
    spark, content = docs.sparkSession, read_tokenizer(tokenizer)
    from tokenizers import Tokenizer

    path = path or new_dir(spark, "tokens")
    small_ids = max(Tokenizer.from_str(content).get_vocab_size(), end_id + 1) <= 1 << 16
    schema = "part int, ids_path string, index_path string, n_docs long, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), encoder(content, blanks_matter=True)
        fs, root = pa.fs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        name = f"part-{part:05d}-{uuid.uuid4().hex}"
        writer, sink, total, count = None, None, 0, 0
        places = None
        for rows, texts in blocks(batches, "text"):
            if writer is None:
                sink, places_sink = fs.open_output_stream(f"{root}/{name}.arrow"), fs.open_output_stream(f"{root}/{name}.index.arrow")
                writer, places = _Writer(sink, length, small_ids), pa.ipc.new_file(places_sink, _INDEX)
            ids, sizes = encode(texts)
            ends = np.cumsum(sizes)
            writer.add(np.insert(ids, ends, end_id))
            sizes, starts = sizes + 1, total + ends - sizes + np.arange(len(sizes))
            total, count = total + int(sizes.sum()), count + len(texts)
            places.write_batch(pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=_INDEX))
        if writer is None:
            return
        for x in (writer, sink, places, places_sink):
            x.close()
        values = [part], [f"{path}/{name}.arrow"], [f"{path}/{name}.index.arrow"], [count], [total]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], [x.split()[0] for x in schema.split(", ")])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
    return cut(rows.repartitionByRange(partitions(docs), "doc_id", "hash").sortWithinPartitions("doc_id", "hash").mapInArrow(run, schema))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): each document as the files have it; start counts the ids of all files' documents before it.

    The manifest has a row per file, so the sums over earlier files are few numbers, made on the driver.
    """
    spark = manifest.sparkSession
    files, before = [], 0
    for x in manifest.orderBy("part").collect():
        files.append((x["ids_path"], x["index_path"], before))
        before += x["n_tokens"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    listed = spark.createDataFrame(files, "ids_path string, index_path string, before long")
    listed = listed.repartitionByRange(max(1, len(files)), "before") if files else listed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, ids_path = pa.fs.FileSystem.from_uri(row["ids_path"])
                _, index_path = pa.fs.FileSystem.from_uri(row["index_path"])
                read = pa.memory_map if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file
                with read(ids_path) as ids, read(index_path) as places:
                    yield from _documents(TokenFile(ids), pa.ipc.open_file(places), row["before"])

    return listed.mapInArrow(run, schema)


def _documents(file: TokenFile, places: pa.ipc.RecordBatchFileReader, before: int) -> Iterator[pa.RecordBatch]:
    stream, left = file.stream(), np.zeros(0, np.uint16)
    for i in range(places.num_record_batches):
        index = places.get_batch(i)
        sums = []
        for n in index.column("n_tokens").to_pylist():
            crc = 0
            while True:
                crc = zlib.crc32(left[:n].astype("<u4").tobytes(), crc)
                got = min(n, len(left))
                n, left = n - got, left[got:]
                if not n:
                    break
                left = next(stream)
            sums.append(crc)
        start = pa.array(index.column("start").to_numpy() + before)
        yield pa.RecordBatch.from_arrays([index.column("doc_id"), start, index.column("n_tokens"), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
