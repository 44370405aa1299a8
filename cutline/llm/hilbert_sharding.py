"""Shards along a Hilbert curve through several columns, so that a shard holds a small box of values.

Each dimension is cut into levels that hold about as many rows each (exact counts of all rows), a row's
levels are a cell of a grid, and the cells are visited in the order of a Hilbert curve, whose
neighbours differ by one step in one dimension. Runs of that order are the shards. A condition on any
of the dimensions then meets few shards, which shard_ranges shows and shards_within uses.

Everything here is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.operators.positions import positions

from .common import cut, small, unused

MADE = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def levels(rows: DataFrame, column: str, bits: int) -> DataFrame:
    """(value, level): each value of the column, null first, with the share of rows before its middle, in 2**bits steps."""
    counts = positions(rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")), ["value"], "before", weight="n")
    distinct, total = counts.agg(F.count("*"), F.sum("n")).first()
    found = counts.select("value", F.expr(f"cast(((2 * before + n) * {1 << bits}) div {2 * (total or 1)} as int)").alias("level"))
    return small(found, distinct)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is computed once for a row however often `then` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def curve_index(levels: Sequence[Column], bits: int) -> Column:
    """The place on the Hilbert curve of a cell, given its level (0 to 2**bits - 1) in each dimension; one to one.

    Bits are taken from the highest down; each turns or mirrors the axes below it, so that the curve
    leaves every half where it enters the next (Skilling's transform of axes).
    """
    n = len(levels)
    if not 1 <= n * bits <= 62:
        raise ValueError("dimensions times bits must be 1 to 62")
    # for each bit but the lowest, and each axis: [bit, axis]
    steps = F.lit([[1 << b, i] for b in range(bits - 1, 0, -1) for i in range(n)] or [[1, 0]])
    axes = F.array(*(c.cast("long") for c in levels))

    def turn(x: Column, step: Column) -> Column:
        bit, axis = step[0].cast("long"), step[1]

        def turned(swap: Column) -> Column:
            return F.transform(x, lambda v, k: F.when((k == 0) | (k == axis), v.bitwiseXOR(swap)).otherwise(v))

        mirrored = F.transform(x, lambda v, k: F.when(k == 0, v.bitwiseXOR(bit - 1)).otherwise(v))
        swapped = _let(F.get(x, F.lit(0)).bitwiseXOR(F.get(x, axis)).bitwiseAND(bit - 1), turned)
        return F.when(F.get(x, axis).bitwiseAND(bit) != 0, mirrored).otherwise(swapped)

    def coded(x: Column) -> Column:
        """A Gray code: each axis also takes the bits of those before it."""
        return F.aggregate(x, F.array().cast("array<bigint>"), lambda made, v: F.concat(made, F.array(F.coalesce(F.try_element_at(made, F.lit(-1)), F.lit(0)).bitwiseXOR(v))))

    def placed(gray: Column) -> Column:
        masks = F.lit([1 << b for b in range(bits - 1, 0, -1)] or [1]).cast("array<bigint>")
        flip = F.aggregate(masks, F.lit(0).cast("long"), lambda t, bit: F.when(F.element_at(gray, -1).bitwiseAND(bit) != 0, t.bitwiseXOR(bit - 1)).otherwise(t))
        shifts = F.lit([[b, i] for b in range(bits - 1, -1, -1) for i in range(n)])
        return _let(flip, lambda t: F.aggregate(shifts, F.lit(0).cast("long"), lambda h, p: h * 2 + F.call_function("shiftright", F.get(gray, p[1]).bitwiseXOR(t), p[0]).bitwiseAND(F.lit(1).cast("long"))))

    return _let(coded(F.aggregate(steps, axes, turn)), placed)


def hilbert_shards(docs: DataFrame, dims: Sequence[str] = ("source", "lang", "n_chars"), shards: int = 24, bits: int = 5, id: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """The rows of docs in shards 0 to shards - 1 whose counts are at most one apart (the law `rows`).

    Returns the id, size (UTF-8 bytes of the text plus 8), text_crc32, law, shard, slot (place within the shard, from 0),
    grown_shard (null: another number of shards cuts the order anew), the dimensions, and the columns of `keep`, stored.
    Along the curve rows of one cell follow each other by id (null first), size and checksum; rows that
    agree in all of these are alike to the result. A null text has no bytes; a null dimension is a value
    of its own, before the others; repeated ids and texts are rows of their own; a very long text is a
    row like any other. Of fewer rows than shards each has a shard of its own. No rows give none. The text
    is read once; what is sorted has it only if `keep` names it. Dimensions and `keep` must not have names
    of MADE.
    """
    carried = list(dict.fromkeys([id, *dims, *keep]))
    if clash := sorted({c.lower() for c in carried} & set(MADE)):
        raise ValueError(f"columns named like those of the result: {', '.join(clash)}")
    bytes_of = F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))
    rows = cut(docs.select(*carried, (F.octet_length(bytes_of) + 8).cast("long").alias("size"), F.crc32(bytes_of).alias("text_crc32")))
    leveled, level = rows, []
    for dim in dims:
        name = unused(leveled, "level")
        found = levels(rows, dim, bits).select(F.col("value").alias(unused(leveled, "value")), F.col("level").alias(name))
        leveled = leveled.join(found, F.col(dim).eqNullSafe(F.col(found.columns[0])), "left").drop(found.columns[0])
        level.append(name)
    curve = unused(leveled, "curve")
    cells = leveled.select(*level).distinct()
    cells = cut(cells.select(*level, curve_index([F.col(c) for c in level], bits).alias(curve)))  # at most 2 ** (bits * len(dims))
    leveled = leveled.join(small(cells, cells.count()), level).drop(*level)
    place, total = unused(leveled, "place"), rows.count()
    placed = positions(leveled, [curve, id, "size", "text_crc32"], place)
    shard = F.expr(f"{place} * {shards} div {max(1, total)}")
    start = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    placed = placed.withColumn("shard", shard).withColumn("slot", F.col(place) - start)
    return placed.select(id, "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), *(c for c in carried if c != id))


def write_shards(found: DataFrame, path: str) -> None:
    """Writes rows of hilbert_shards (with the wanted columns in `keep`) into a folder for each shard, in order of their slots.

    The rows lie in ranges of the curve already, so each task writes its own stretch and nothing is
    shuffled; a large shard is several files, each again a run of the curve.
    """
    found.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_ranges(found: DataFrame, dims: Sequence[str] = ("source", "lang", "n_chars")) -> DataFrame:
    """(shard, rows, bytes, and for each dimension d: d_min, d_max, d_nulls): one row for each shard that has rows."""
    each = [f for d in dims for f in (F.min(d).alias(f"{d}_min"), F.max(d).alias(f"{d}_max"), F.count_if(F.col(d).isNull()).alias(f"{d}_nulls"))]
    return found.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *each)


def shards_within(ranges: DataFrame, **bounds: tuple) -> list[int]:
    """The shards that may have rows with d between low and high (both included) for every d=(low, high); at most as many numbers as there are shards."""
    for d, (low, high) in bounds.items():
        ranges = ranges.where((F.col(f"{d}_min") <= F.lit(high)) & (F.col(f"{d}_max") >= F.lit(low)))
    return sorted(r["shard"] for r in ranges.select("shard").collect())
