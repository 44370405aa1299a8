"""Sums at every level of a hierarchy, their shares and their places among their siblings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutline.shared import stored


def rollup_shares(rows: DataFrame, levels: list[str], value: str, top: int | None = None) -> DataFrame:
    """(levels, depth, n, total, share, place): one row for each group of the first 0, 1, ... levels, from one aggregate.

    depth says how many levels are given (the others are null, as may be a group's own value). share: percent of the
    parent's total, null where that is 0. place: 1 for the greatest total among the groups of a parent, then by name;
    with `top` only places up to it stay. Null values of `value` count as rows but add nothing. No rows give none.
    """
    mask = sum((1 << len(levels) - 1 - i) * F.grouping(c).cast("int") for i, c in enumerate(levels))
    sums = rows.rollup(*levels).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col(value).cast("decimal(38,4)")), F.lit(0).cast("decimal(38,4)")).alias("total"), mask.alias("mask"))
    depth = len(levels) - F.length(F.replace(F.bin("mask"), F.lit("0"), F.lit("")))
    sums = stored(sums.withColumn("depth", depth.cast("int")).where("n > 0").drop("mask"))
    # a parent and its children share the levels of the parent
    under = [F.when(F.col("depth") > i + 1, F.col(c)).alias(f"under_{i}") for i, c in enumerate(levels)]
    parents = sums.select((F.col("depth") + 1).alias("of"), *(F.col(c).alias(f"of_{i}") for i, c in enumerate(levels)), F.col("total").alias("whole"))
    rows = sums.select("*", *under)
    same = rows["depth"] == parents["of"]
    for i in range(len(levels)):
        same = same & F.col(f"under_{i}").eqNullSafe(F.col(f"of_{i}"))
    order = Window.partitionBy("depth", *(f"under_{i}" for i in range(len(levels)))).orderBy(F.desc("total"), *(F.asc_nulls_first(c) for c in levels))
    ranked = rows.withColumn("place", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("place") <= top)
    share = F.try_divide(F.col("total").cast("double") * 100, F.coalesce("whole", "total").cast("double"))
    return ranked.join(parents, same, "left").select(*levels, "depth", "n", F.col("total").cast("double").alias("total"), share.alias("share"), "place")
