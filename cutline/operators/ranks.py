"""Ranks and histograms over whole tables, from the counts of their values.

Values are counted first, which takes the weight out of common ones, and the counts are put in order by
ranges (see positions), so no window runs over a whole table and no value's rows meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.operators.positions import positions
from cutline.shared import fresh, small, stored


def below(rows: DataFrame, value: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(by, value, n, below, total): each value that is not null, its rows, the rows of its group with smaller values, and all of the group's; stored.

    With `weight`, a row stands for so many.
    """
    by = by or []
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    placed = positions(counts, [*by, "value"], "below", weight="n")
    if not by:
        total = placed.agg(F.sum("n")).first()[0]
        return stored(placed.withColumn("total", F.lit(total or 0).cast("long")))
    groups = stored(placed.groupBy(*by).agg(F.sum("n").alias("total"), F.min("below").alias("start")))
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in by]
    groups = groups.select(*(F.col(c).alias(f"of_{c}") for c in by), "total", "start")
    found = placed.join(small(groups), same)
    return stored(found.withColumn("below", F.col("below") - F.col("start")).select(*by, "value", "n", "below", "total"))


def percent_rank(rows: DataFrame, value: str, by: list[str] | None = None, name: str = "percent_rank") -> DataFrame:
    """The rows with `rank` (1 and the number of smaller values in the group) and their percent rank: smaller values by the other rows, 0 for a lone row.

    Null values have null ranks and do not count. Equal values have one rank.
    """
    by = by or []
    if clash := {"rank", name} & set(rows.columns):
        raise ValueError(f"columns named like those of the result: {', '.join(sorted(clash))}")
    found = below(rows, value, by)
    of = {c: fresh(rows, f"of_{c}") for c in [*by, "value", "below", "total"]}
    found = small(found.select(*(F.col(c).alias(n) for c, n in of.items())))
    same = [F.col(c).eqNullSafe(F.col(of[c])) for c in by] + [F.col(value) == F.col(of["value"])]
    share = F.when(F.col(of["total"]) > 1, F.col(of["below"]) / (F.col(of["total"]) - 1)).when(F.col(of["total"]) == 1, F.lit(0.0))
    return rows.join(found, same, "left").withColumns({"rank": F.col(of["below"]) + 1, name: share}).drop(*of.values())


def equal_width(rows: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """(bin, low, high, n) of `bins` ranges of one width from the least to the greatest finite value, the last one closed; empty ranges too.

    Where all values are equal there is one range, of no width; nulls, nan and infinite values are left out.
    """
    if bins < 1:
        raise ValueError("bins must be 1 or more")
    v = F.col(value).cast("double")
    finite = rows.select(v.alias("v")).where("v is not null and not isnan(v) and abs(v) < double('infinity')")
    low, high = finite.agg(F.min("v"), F.max("v")).first()
    if low is None:
        return rows.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    bins = bins if high > low else 1
    width = (high - low) / bins
    place = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)) if width else F.lit(0)
    counts = finite.groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    edge = lambda i: F.lit(low) + F.lit(width) * i
    return every.join(F.broadcast(counts), "bin", "left").select("bin", edge(F.col("bin")).alias("low"), F.when(F.col("bin") == bins - 1, F.lit(high)).otherwise(edge(F.col("bin") + 1)).alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def equal_depth(rows: DataFrame, value: str, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """(by, bin, low, high, n): values in ranges that hold about as many rows each; a value's rows stay in one range, so there may be fewer than `bins`."""
    if bins < 1:
        raise ValueError("bins must be 1 or more")
    by = by or []
    found = below(rows, value, by).withColumn("bin", F.expr(f"cast(below * {bins} div total as int)"))
    return found.groupBy(*by, "bin").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("n").alias("n"))


def yearly_trend(rows: DataFrame, value: str, date: str | Column, by: list[str]) -> DataFrame:
    """(by, year, n, mean, change, change_percent): the mean of each year of a group against that of the group's year before; null where there is none."""
    year = F.year(F.col(date) if isinstance(date, str) else date)
    each = rows.where(F.col(value).isNotNull()).groupBy(*by, year.alias("year")).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(20,4)")).alias("total")).where("year is not null")
    each = stored(each.withColumn("mean", F.col("total").cast("double") / F.col("n")).drop("total"))
    before = each.select(*(F.col(c).alias(f"of_{c}") for c in by), (F.col("year") + 1).alias("of_year"), F.col("mean").alias("was"))
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in by] + [F.col("year") == F.col("of_year")]
    rows = each.join(before, same, "left")
    return rows.select(*by, "year", "n", "mean", (F.col("mean") - F.col("was")).alias("change"), F.try_divide((F.col("mean") - F.col("was")) * 100, F.col("was")).alias("change_percent"))


def cost_adjusted(rows: DataFrame, costs: DataFrame, place: str, value: str, by: list[str] | None = None) -> DataFrame:
    """The rows with `adjusted` (the value at a cost of living of 100, to the cent), and the percent ranks within the group of both: `nominal_rank`, `adjusted_rank`.

    costs: (place, cost); of several costs of a place the highest counts. Where the place is null or has no
    cost above 0, the adjusted value and its rank are null, and the row does not count among the others'.
    The rows are read twice, to count and to be ranked: give stored ones if they are dear.
    """
    if clash := {"adjusted", "rank", "nominal_rank", "adjusted_rank"} & set(rows.columns):
        raise ValueError(f"columns named like those of the result: {', '.join(sorted(clash))}")
    by = by or []
    known = stored(costs.where("cost > 0").groupBy(F.col(place).alias("place")).agg(F.max("cost").alias("cost")))
    # the rows' groups, places and values, under names of ours; each is ranked once, however many rows have it
    names = [f"by{i}" for i in range(len(by))]
    each = stored(rows.groupBy(*(F.col(c).alias(n) for c, n in zip(by, names, strict=True)), F.col(place).alias("at"), F.col(value).alias("v")).agg(F.count("*").alias("n")).where("v is not null"))
    each = each.join(small(known), F.col("at") == F.col("place"), "left").withColumn("adjusted", F.round(F.col("v") * 100 / F.col("cost"), 2)).drop("place", "cost")
    for of, name in (("v", "nominal_rank"), ("adjusted", "adjusted_rank")):
        found = below(each, of, names, weight="n").withColumnsRenamed({c: f"of_{c}" for c in [*names, "n"]})
        same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in names] + [F.col(of) == F.col("value")]
        share = F.when(F.col("total") > 1, F.col("below") / (F.col("total") - 1)).when(F.col("total") == 1, F.lit(0.0))
        each = each.join(small(found), same, "left").withColumn(name, share).drop(*found.columns)
    mine = {c: fresh(rows, f"of_{c}") for c in [*names, "at", "v"]}
    ranked = stored(each.drop("n").withColumnsRenamed(mine))
    same = [F.col(c).eqNullSafe(F.col(mine[n])) for c, n in zip([*by, place], [*names, "at"], strict=True)] + [F.col(value) == F.col(mine["v"])]
    return rows.join(small(ranked), same, "left").drop(*mine.values())
