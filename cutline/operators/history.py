"""What was known of a key at any time: observations that come in any order, and the intervals that they make.

Every observation is kept, also one that only confirms the value before it, since a later arrival may
fall between the two. Intervals are derived for the keys that a batch touches and stay for the others.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(left: DataFrame, right: DataFrame, on: list[str]) -> tuple[DataFrame, Column]:
    right = right.select(*(F.col(c).alias(f"_{c}") for c in on))
    same = F.lit(True)
    for c in on:
        same = same & left[c].eqNullSafe(right[f"_{c}"])
    return right, same


def observe(stored: DataFrame | None, batch: DataFrame, key: list[str], values: list[str], at: str, version: str) -> DataFrame:
    """(key, at, version, values): of observations of a key at one time the one with the greatest version, then the greatest values. Those without a time are left out; a batch that comes again changes nothing."""
    columns = [*key, at, version, *values]
    rows = batch.select(*columns) if stored is None else stored.select(*columns).unionByName(batch.select(*columns))
    best = rows.where(F.col(at).isNotNull()).groupBy(*key, at).agg(F.max(F.struct(version, *values)).alias("best"))
    return best.select(*key, at, "best.*")


def intervals(observations: DataFrame, key: list[str], values: list[str], at: str) -> DataFrame:
    """(key, values, valid_from, valid_to): the stretches in which a key's values were the same; valid_to is the beginning of the next, null for the last.

    Null values are values. A key has one observation at a time, so its window holds as many rows as there are times.
    """
    order = Window.partitionBy(*key).orderBy(at)
    state, before = F.struct(*values), F.lag(F.struct(*values)).over(order)
    rows = observations.select(*key, at, *values, (F.row_number().over(order) == 1).alias("first"), state.eqNullSafe(before).alias("same"))
    starts = rows.where("first or not same")
    return starts.select(*key, *values, F.col(at).alias("valid_from"), F.lead(at).over(order).alias("valid_to"))


def merge(old: DataFrame, observations: DataFrame, batch: DataFrame, key: list[str], values: list[str], at: str) -> DataFrame:
    """The intervals after a batch was observed: made anew for its keys, the old ones for all others."""
    touched = batch.select(*key).distinct()
    right, same = _same(old, touched, key)
    kept = old.join(right, same, "left_anti")
    right, same = _same(observations, touched, key)
    return kept.unionByName(intervals(observations.join(right, same, "left_semi"), key, values, at))


def as_of(found: DataFrame, time: str | datetime.date) -> DataFrame:
    """The intervals that hold at a time."""
    t = F.lit(str(time)).cast(found.schema["valid_from"].dataType)
    return found.where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))
