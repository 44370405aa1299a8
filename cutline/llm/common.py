"""Helpers shared by the operators: the shared folder, cut lineage, checked broadcasts, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast up to this many rows of a few numbers each (tens of MB); larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, one of our own in local mode, else an error."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not given and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(given or tempfile.mkdtemp(prefix="cutline-"))
    return given or context.getCheckpointDir().get()


def new_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, stored in the shared folder so that later steps neither recompute nor lose them."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, kept as Parquet in the shared folder: sorted numbers take a fraction of what cut() needs."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the limit; else Spark shuffles it."""
    return F.broadcast(df) if rows <= limit else df


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet, made of `name`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(df: DataFrame, most: int = 256 << 20) -> int:
    """The session's number of shuffle partitions, or more where df would have over `most` bytes in each (as Spark estimates them, if it can)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // most) if size < 1 << 50 else 0)


def utf8(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_hashes(texts: list[bytes]) -> pa.Array:
    """XXH64 of each text, seed 42, as Spark's xxhash64 gives it for a string."""
    return pa.array(np.array([xxhash.xxh64_intdigest(t, 42) for t in texts], np.uint64).view(np.int64))


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The rows in slices of about `most` bytes of text; only a slice at a time is turned into Python's bytes."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column).cast(pa.binary())).fill_null(0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes.astype(np.int64) + 1), 0
        while at < len(ends):
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most)) + 1
            part = batch.slice(at, to - at)
            yield part, utf8(part.column(column))
            at = to


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over the word."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_BASE, _UNBASE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Runs of more bytes are hashed one by one: polynomials modulo 2**64 are equal for some (very regular) strings of over 1,000.
_REGULAR = 256


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        found = []
        for base in (_BASE, _UNBASE):
            steps = np.full(max(n, 1 << 20), base, np.uint64)
            steps[0] = 1
            found.append(np.multiply.accumulate(steps))
        if n > 1 << 22:
            return found  # of a very long text; not kept
        _powers[:] = found
    return _powers


def _polynomial(values: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function from (starts, ends) to a number of each run values[start:end], equal for equal runs."""
    up, down = _powers_to(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return lambda starts, ends: (sums[ends] - sums[starts]) * down[starts]


def runs_hashed(buffer: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function that gives 64-bit hashes of many runs of bytes buffer[start:end] at once, equal for equal bytes."""
    of = _polynomial(buffer.astype(np.uint64) + np.uint64(1))

    def hashes(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = mixed(of(starts, ends))
        for i in np.flatnonzero(ends - starts > _REGULAR).tolist():
            out[i] = xxhash.xxh64_intdigest(buffer[starts[i] : ends[i]].tobytes(), 42)
        return out

    return hashes


class Words:
    """The lower-cased words of some texts, with 64-bit hashes of any run of them.

    buffer holds all words, one space between any two; word i is buffer[starts[i]:ends[i]]; text k has the
    words first[k] to first[k + 1]. A run's hash is made of those of its words (runs are of some dozens at most).
    """

    def __init__(self, texts: list[bytes]):
        joined = [b" ".join(t.lower().split()) for t in texts]
        counts = np.array([x.count(b" ") + 1 if x else 0 for x in joined], np.int64)
        self.text = b" ".join(x for x in joined if x)
        self.buffer = np.frombuffer(self.text, np.uint8)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        spaces = np.flatnonzero(self.buffer == 32)
        n = int(self.first[-1])
        self.starts = np.concatenate([[0], spaces + 1])[:n]
        self.ends = np.concatenate([spaces, [len(self.buffer)]])[:n]
        self._one = runs_hashed(self.buffer)(self.starts, self.ends)
        self._run = _polynomial(self._one)

    def hashes(self, run: int = 1) -> np.ndarray:
        """Of each run of so many words (one for each start; runs may cross texts)."""
        if run == 1:
            return self._one
        starts = np.arange(max(0, len(self._one) - run + 1))
        return mixed(self._run(starts, starts + run))

    def between(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of the runs of words from starts to ends (exclusive), hundreds of words at most."""
        return mixed(self._run(starts, ends))
