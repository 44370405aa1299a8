"""Matching rows of two tables that share a key when one number is close to another and one date follows another by some months.

A range join on a key alone pairs all rows of the key. Here each row of the right side is filed once,
under its key, a band of its number and a bucket of its month; each row of the left side is looked up in
the few bands and buckets that its ranges touch (two of each), so the join is one on equal values and
its work is that of the neighbourhoods. What is found is then held against the exact ranges.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.shared import small, stored


def _month(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date)


def _side(rows: DataFrame, names: dict[str, str], prefix: str) -> DataFrame:
    """(key, value, date, id): each key, value and date once, with its smallest id; rows that can match nothing are left out."""
    columns = [F.col(names["key"]).alias("key"), F.col(names["value"]).cast("double").alias("value"), F.col(names["date"]).cast("date").alias("date"), F.col(names["id"]).alias("id")]
    able = F.col("key").isNotNull() & (F.col("value") > 0) & (F.col("value") < float("inf")) & F.col("date").isNotNull()
    once = rows.select(*columns).where(able).groupBy("key", "value", "date").agg(F.min("id").alias("id"))
    return once.select(*(F.col(c).alias(f"{prefix}_{c}") for c in ("key", "value", "date", "id")))


def band_pairs(left: DataFrame, right: DataFrame, names: dict[str, str], share: float = 0.1, months: tuple[int, int] = (6, 36), heavy: int = 10_000) -> DataFrame:
    """(l_key, l_value, l_date, r_value, r_date, r_id) of each distinct left row and each right row of its key whose value is within `share` of the left's and whose date is months[0] to months[1] months later, both included.

    names: the columns called key, value, date and id (of both sides). Equal rows of a side stand
    for each other (the right one with the smallest id), so copies are never multiplied. Rows with a null key, value or date, a value
    that is not positive and finite, match nothing. A cell with more than `heavy` right rows is dealt
    into salted parts of that size; the left rows that look there look in every part.
    """
    first, last = months
    if not 0 < share < 1 or first > last:
        raise ValueError("the share must be between 0 and 1, and the first month not after the last")
    width, span = math.log((1 + share) / (1 - share)), last - first + 2
    band = lambda v: F.floor(F.log(v) / width)
    bucket = lambda d: F.floor(_month(d) / span)
    low, high = F.col("l_value") * (1 - share), F.col("l_value") * (1 + share)
    begin, end = F.add_months("l_date", first), F.add_months("l_date", last)
    filed = _side(right, names, "r").withColumns({"band": band(F.col("r_value")), "bucket": bucket(F.col("r_date"))})
    asked = _side(left, names, "l").drop("l_id").withColumn("band", F.explode(F.sequence(band(low), band(high))))
    asked = asked.withColumn("bucket", F.explode(F.sequence(bucket(begin), bucket(end))))
    cell = ["r_key", "band", "bucket"]
    crowded = stored(filed.groupBy(*cell).agg(F.count("*").alias("n")).where(F.col("n") > heavy))
    on = (F.col("l_key") == F.col("r_key")) & (asked["band"] == filed["band"]) & (asked["bucket"] == filed["bucket"])
    if crowded.take(1):
        parts = small(crowded.select(*cell, F.ceil(F.col("n") / heavy).cast("int").alias("parts")))
        filed = filed.join(parts, cell, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("r_id", "r_value", "r_date"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
        asked = asked.join(parts.withColumnRenamed("r_key", "l_key"), ["l_key", "band", "bucket"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0))))).drop("parts")
        on = (F.col("l_key") == F.col("r_key")) & (asked["band"] == filed["band"]) & (asked["bucket"] == filed["bucket"]) & (asked["salt"] == filed["salt"])
    near = F.col("r_value").between(low, high) & F.col("r_date").between(begin, end)
    return asked.join(filed, on).where(near).select("l_key", "l_value", "l_date", "r_value", "r_date", "r_id")


def best_matches(left: DataFrame, right: DataFrame, names: dict[str, str], share: float = 0.1, months: tuple[int, int] = (6, 36), heavy: int = 10_000) -> DataFrame:
    """Every left row (key, value, date, id as named) with match_id, match_value, match_date and n_matches: of its band_pairs the one with the nearest value, then the earliest date, then the smallest id.

    n_matches counts distinct matching rows; rows without a match have nulls and 0. The best is a grouped
    minimum that combines before it is shuffled, so no row's candidates are gathered.
    """
    pairs = band_pairs(left, right, names, share, months, heavy)
    order = F.struct(F.abs(F.col("r_value") - F.col("l_value")).alias("off"), "r_date", "r_id", "r_value")
    best = pairs.groupBy("l_key", "l_value", "l_date").agg(F.min(order).alias("best"), F.count("*").alias("n"))
    key, value, date, id = (names[x] for x in ("key", "value", "date", "id"))
    rows = left.select(F.col(key), F.col(value), F.col(date), F.col(id))
    found = rows.join(best, (rows[key] == best["l_key"]) & (rows[value].cast("double") == best["l_value"]) & (rows[date].cast("date") == best["l_date"]), "left")
    return found.select(key, value, date, id, F.col("best.r_id").alias("match_id"), F.col("best.r_value").alias("match_value"), F.col("best.r_date").alias("match_date"), F.coalesce("n", F.lit(0)).cast("long").alias("n_matches"))
