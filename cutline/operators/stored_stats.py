"""A stored aggregate that is kept current by months: count, mean, least, greatest and percentiles of groups.

What is stored is not the result but a state that can be merged: sums, a sketch of the values (KLL), and
for groups of few rows the values themselves; one row for each group and period, in a folder for each
period. A refresh makes the states of the periods that changed and replaces their folders; the other
periods' rows are not read, and the result is merged from states. Percentiles are exact for a group that
never has over `exact` rows in a period, else by the sketch, which is off by about 0.3 percent of the ranks.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.shared import small, stored

EXACT, SKETCH = 1000, 1024


def state(rows: DataFrame, by: list[str], value: str, period: str, exact: int = EXACT) -> DataFrame:
    """(by, period, n, total, low, high, sketch, ordered): one row for each group and period. Null and nan values do not count.

    The sums and sketches combine before their shuffle, whatever the size of a group; only rows of groups
    with up to `exact` rows in the period are gathered.
    """
    v = F.col(value).cast("double")
    whole = rows.where(F.col(period).isNotNull() & v.isNotNull() & ~F.isnan(v)).select(*by, F.col(period).cast("date").alias("period"), F.col(value).cast("decimal(38,4)").alias("exactly"), v.alias("v"))
    keys = [*by, "period"]
    sums = stored(whole.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("exactly").alias("total"), F.min("v").alias("low"), F.max("v").alias("high"), F.kll_sketch_agg_double("v", F.lit(SKETCH)).alias("sketch")))

    def alike(right: DataFrame) -> tuple[DataFrame, list[Column]]:
        return right.select(*(F.col(c).alias(f"of_{c}") for c in keys), *(c for c in right.columns if c not in keys)), [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in keys]

    few, same = alike(sums.where(F.col("n") <= exact).select(*keys))
    values = whole.join(small(few), same, "left_semi").groupBy(*keys).agg(F.array_sort(F.collect_list("v")).alias("ordered"))
    values, same = alike(values)
    return sums.join(values, same, "left").select(*sums.columns, "ordered")


def build(rows: DataFrame, path: str, by: list[str], value: str, period: str, exact: int = EXACT) -> None:
    """Stores the states of all rows, in place of what the folder has."""
    state(rows, by, value, period, exact).write.mode("overwrite").partitionBy("period").parquet(path)


def refresh(rows: DataFrame, path: str, periods: list[datetime.date], by: list[str], value: str, period: str, exact: int = EXACT) -> None:
    """Stores the states of the given periods anew; those of others stay, and their rows are not read if `rows` is stored by period.

    Doing it again changes nothing. A period of which no rows are left is emptied.
    """
    if not periods:
        return
    made = state(rows.where(F.col(period).isin(periods)), by, value, period, exact)
    # a row without values for each period, so that each folder is replaced
    empty = {"period": F.col("period"), "n": F.lit(0).cast("long")}
    nothing = rows.sparkSession.createDataFrame([(p,) for p in periods], "period date").select(*(empty.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in made.schema))
    made.unionByName(nothing).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(path)


def _percentile(p: float) -> Column:
    """Between the two values around the place (n - 1) * p, in proportion; by the sketch where not all values are held."""
    place = (F.col("n") - 1) * F.lit(float(p))
    low = F.floor(place).cast("int")
    a, b = F.get("ordered", low), F.coalesce(F.get("ordered", low + 1), F.get("ordered", low))
    return F.when(F.col("exact"), a + (b - a) * (place - low)).otherwise(F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))))


def view(spark: SparkSession, path: str, by: list[str], percentiles: dict[str, float] | None = None) -> DataFrame:
    """(by, n, mean, low, high, exact, and a column for each of `percentiles`, default the median) of each group over all stored periods."""
    held = spark.read.parquet(path).where("n > 0")
    merged = held.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch").alias("sketch"), F.bool_and(F.col("ordered").isNotNull()).alias("exact"), F.array_sort(F.flatten(F.collect_list("ordered"))).alias("ordered"))
    wanted = {"median": 0.5} if percentiles is None else percentiles
    return merged.select(*by, "n", (F.col("total").cast("double") / F.col("n")).alias("mean"), "low", "high", "exact", *(_percentile(p).alias(name) for name, p in wanted.items()))
