"""Product codes of vectors with codebooks of integers: the same codes on every machine and in every order.

The nearest entry of a part is found by a float32 matrix product first, whose rounding error has a
proven bound: entries whose interval of possible distances overlaps the best are computed again in
64-bit integers, and ties go to the smaller index. So the fast product decides only what it surely can.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small

SCALE = 4096
#: Components below this in size keep every sum and distance here within 64-bit integers; larger ones are reckoned with Python's integers.
EXACT = 1 << 24


def as_integers(vectors: pa.Array, dim: int, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """(kept, x): which rows are whole (not null, of `dim` components, none of them null or non-finite), and floor(scale * component) of those."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = pa.compute.list_value_length(vectors).fill_null(-1).to_numpy(zero_copy_only=False)
    kept = lengths == dim
    flat = vectors.filter(pa.array(kept)).flatten()
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
    whole = np.isfinite(values).all(axis=1)
    kept[kept] = whole
    scaled = np.floor(values[whole] * scale)
    if scaled.size and np.abs(scaled).max() >= EXACT:
        return kept, np.array([[int(v) for v in row] for row in scaled.tolist()], object).reshape(-1, dim)
    return kept, scaled.astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry of the book, exactly; ties to the smaller index. Both hold integers.

    |x - c|^2 = |x|^2 + (|c|^2 - 2 x.c), and only what is in brackets tells entries apart. The float32
    product of x and c is off by at most g |x| |c|, where g = (d + 2) u / (1 - (d + 2) u) and u = 2^-24,
    in whatever order it is summed up (two more roundings: of x and of c). The float64 reckoning of the
    interval itself is widened by a share of 2^-40, far more than it can be off.
    """
    n, d = x.shape
    if not n or not d or x.dtype == object or book.dtype == object:
        return _by_integers(x, book, np.repeat(np.arange(n), len(book)), np.tile(np.arange(len(book)), n))
    product = (x.astype(np.float32) @ book.astype(np.float32).T).astype(np.float64)
    g = (d + 2) * 2.0**-24 / (1 - (d + 2) * 2.0**-24)
    norms = (book * book).sum(axis=1).astype(np.float64)
    lengths = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    score = norms - 2 * product
    off = (2 * g * lengths[:, None] * np.sqrt(norms) + (norms + 2 * np.abs(product)) * 2.0**-40) * (1 + 2.0**-40) + 1e-6
    row, entry = np.nonzero(score - off <= (score + off).min(axis=1)[:, None])
    return _by_integers(x, book, row, entry)


def _by_integers(x: np.ndarray, book: np.ndarray, row: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best of the pairs (row, entry), which are in order and name every row; reckoned in integers, some thousand pairs at a time."""
    if x.dtype == object or book.dtype == object:
        found = np.array([sum((int(a) - int(b)) ** 2 for a, b in zip(x[r], book[e], strict=True)) for r, e in zip(row.tolist(), entry.tolist(), strict=True)] or [], object)
        best: dict[int, tuple[int, int]] = {}
        for r, e, f in zip(row.tolist(), entry.tolist(), found, strict=True):
            if r not in best or f < best[r][1]:
                best[r] = (e, f)
        return np.array([best[r][0] for r in range(len(x))], np.int64), np.array([best[r][1] for r in range(len(x))] or [], object)
    found = np.empty(len(row), np.int64)
    for a in range(0, len(row), 1 << 16):
        off = x[row[a : a + (1 << 16)]] - book[entry[a : a + (1 << 16)]]
        found[a : a + (1 << 16)] = np.einsum("ij,ij->i", off, off)
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    least = np.minimum.reduceat(found, starts)
    hits = np.flatnonzero(found == np.repeat(least, np.diff(starts, append=len(row))))
    return entry[hits[np.unique(row[hits], return_index=True)[1]]], least


def _parts(x: np.ndarray, parts: int) -> list[np.ndarray]:
    width = x.shape[1] // parts
    return [x[:, p * width : (p + 1) * width] for p in range(parts)]


def first_books(vectors: DataFrame, id: str, column: str, parts: int, entries: int) -> tuple[int, list[np.ndarray]] | None:
    """(dim, books): the parts of the rows with the `entries` smallest ids, by which the length of all is fixed; None without rows.

    These are the only vectors that the driver gets.
    """
    whole = vectors.where(F.col(id).isNotNull() & F.col(column).isNotNull() & (F.size(column) > 0) & ~F.exists(column, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf"))))
    least = whole.select(F.col(id).alias("id"), F.col(column).alias("v")).orderBy("id", "v")
    first = least.limit(1).collect()
    if not first:
        return None
    dim = len(first[0]["v"])
    if dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    taken = least.where(F.size("v") == dim).limit(entries).collect()
    _, x = as_integers(pa.array([list(map(float, r["v"])) for r in taken], pa.list_(pa.float64())), dim)
    return dim, _parts(x, parts)


def _moved(vectors: DataFrame, column: str, dim: int, books: list[np.ndarray]) -> list[np.ndarray]:
    """The books after a round: each entry the floor of its parts' mean. What is gathered is one row for each component of the books."""
    parts = len(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], list] = {}
        for batch in batches:
            _, x = as_integers(batch.column(0), dim)
            for p, own in enumerate(_parts(x, parts)):
                index, _ = nearest(own, books[p])
                for e in np.unique(index).tolist():
                    mine = own[index == e]
                    was = totals.setdefault((p, e), [0, [0] * own.shape[1]])
                    was[0] += len(mine)
                    was[1] = [a + int(b) for a, b in zip(was[1], mine.sum(axis=0).tolist(), strict=True)]
        rows = [(p, e, at, n, str(v)) for (p, e), (n, values) in totals.items() for at, v in enumerate(values)]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "entry", "at", "n", "total"])

    found = vectors.select(column).mapInArrow(sums, "part int, entry int, at int, n long, total string")
    found = found.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    moved = [book.astype(object) for book in books]
    for r in found.collect():
        moved[r["part"]][r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return [m.astype(np.int64) if not m.size or max(abs(int(v)) for v in m.flat) < EXACT else m for m in moved]


def books_sha256(books: list[np.ndarray]) -> str:
    """Of all components as decimal numbers, by part, entry and place, commas between."""
    return hashlib.sha256(",".join(str(int(v)) for book in books for entry in book for v in entry).encode()).hexdigest()


def fit(vectors: DataFrame, id: str = "vec_id", column: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[int, list[np.ndarray]] | None:
    """(dim, books) after the rounds, each over all vectors; None without vectors."""
    made = first_books(vectors, id, column, parts, entries)
    if made is None:
        return None
    dim, books = made
    for _ in range(rounds):
        books = _moved(vectors, column, dim, books)
    return dim, books


def product_codes(vectors: DataFrame, id: str = "vec_id", column: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256) of each vector that is whole.

    code: the indexes of the nearest entries in hex, two digits a part; error: the squared distances added
    up; label_error: error added up over the rows of a label, those without one together. Vectors that are
    null, empty or hold null or non-finite components take no part, nor do those of another length than the
    one with the smallest id. Null ids are coded but never entries of a first book; rows that repeat an id
    are rows of their own (in a first book ordered by their components); with fewer rows than entries the
    books are smaller. Only an error beyond 64 bits (components in the millions) is an ArithmeticException.
    No rows give none. `vectors` is read once for each round and twice more: give a stored table.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits a part")
    names = f"id {vectors.schema[id].dataType.simpleString()}, label {vectors.schema[label].dataType.simpleString()}, code string, error string"
    made = fit(vectors, id, column, parts, entries, rounds)
    if made is None:
        empty = vectors.sparkSession.createDataFrame([], names)
        return empty.select(F.col("id").alias(id), F.col("label").alias(label), "code", F.col("error").cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    dim, books = made

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, x = as_integers(batch.column(2), dim)
            codes, errors = np.empty((len(x), parts), np.int64), np.zeros(len(x), object)
            for p, own in enumerate(_parts(x, parts)):
                codes[:, p], off = nearest(own, books[p])
                errors = errors + off
            text = [bytes(c).hex() for c in codes.astype(np.uint8)]
            rest = batch.filter(pa.array(kept))
            yield pa.record_batch([rest.column(0), rest.column(1), pa.array(text, pa.string()), pa.array(list(map(str, errors)), pa.string())], names=["id", "label", "code", "error"])

    coded = cut(vectors.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(column).alias("v")).mapInArrow(code, names).withColumn("error", F.col("error").cast("long")))
    labels = cut(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    joined = coded.join(small(labels, labels.count()), F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias(id), F.col("label").alias(label), "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def decoded(codes: DataFrame, books: list[np.ndarray], id: str = "vec_id", code: str = "code", scale: int = SCALE) -> DataFrame:
    """(id, embedding): the vectors that the codes stand for; null for a null code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [None if c is None else [float(v) / scale for p, i in enumerate(bytes.fromhex(c)) for v in books[p][i]] for c in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=["id", "embedding"])

    found = codes.select(F.col(id).alias("id"), F.col(code).alias("code")).mapInArrow(run, f"id {codes.schema[id].dataType.simpleString()}, embedding array<float>")
    return found.withColumnRenamed("id", id)
