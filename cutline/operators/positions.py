"""Places of rows in a total order, over tables of any size: no window without partitions, no task with a whole value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutline.shared import fresh, stored


def positions(rows: DataFrame, order: list[str | Column], name: str = "position", weight: str | None = None) -> DataFrame:
    """The rows, stored, with how many rows come before each in the given order (nulls first); with `weight`, the sum of theirs.

    Rows are dealt by ranges of the order, sorted within each, numbered there, and moved up by what the
    earlier ranges hold; the only thing gathered is one total for each range. Rows that are equal in the
    order are told apart by where they were read, so that even a value which most rows have is dealt
    over many ranges; which of them comes first is open, so order by all that matters. No rows give none.
    """
    at, part, rank, before = (fresh(rows, x, name) for x in ("at", "part", "rank", "before"))
    spread = rows.withColumn(rank, F.monotonically_increasing_id())
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = spread.repartitionByRange(parts, *order, rank).sortWithinPartitions(*order, rank).withColumn(at, F.monotonically_increasing_id())
    # the id holds the number of the partition above 33 bits for the row within it
    kept = stored(ranged.withColumn(part, F.shiftright(at, 33)).withColumn(rank, F.col(at).bitwiseAND((1 << 33) - 1)).drop(at))
    if weight is None:
        totals = kept.groupBy(part).agg(F.count("*").alias(before))
    else:
        totals = kept.groupBy(part).agg(F.sum(weight).alias(before))
        kept = kept.withColumn(rank, F.sum(weight).over(Window.partitionBy(part).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # of one row for each range
    totals = totals.select(part, F.coalesce(F.sum(before).over(earlier), F.lit(0)).cast("long").alias(before))
    return kept.join(F.broadcast(totals), part).withColumn(name, F.col(before) + F.col(rank)).drop(part, rank, before)
