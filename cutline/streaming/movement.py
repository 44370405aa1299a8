"""How far each series' cutoff moved from month to month, its trend, and the wait that follows: over a whole table, and as months arrive.

The stream keeps the last months of each series as state. A month that comes late changes its own row
and the next ones, which are given out again; the sink keeps one row for each series and month.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cutline.operators.series import SERIES
from cutline.shared import stored

#: A trend is the mean of so many movements.
TREND = 3
#: So many months of a series are kept as state: a late month changes TREND rows after it, each of which looks TREND rows back.
KEPT = 2 * TREND + 1
_OUT = ", ".join(f"{c} string" for c in SERIES) + ", publication_date date, cutoff_date date, moved_days int, trend_days double, late boolean"


def estimates(rows: DataFrame, submission: str | datetime.date) -> DataFrame:
    """Rows of movements with gap_days (from the cutoff to the date asked for, 0 once it is reached) and wait_months (gap by trend; null where nothing moves forward)."""
    gap = F.greatest(F.datediff(F.lit(str(submission)).cast("date"), "cutoff_date"), F.lit(0))
    wait = F.when(gap == 0, F.lit(0.0)).when(F.col("trend_days") > 0, gap / F.col("trend_days"))
    return rows.withColumns({"gap_days": gap, "wait_months": wait})


def movement(points: DataFrame, submission: str | datetime.date) -> DataFrame:
    """(series, publication_date, cutoff_date, moved_days, trend_days, gap_days, wait_months) of each point.

    moved_days: from the cutoff of the month before; null for the first and where either has none.
    trend_days: the mean of the last three movements that are known. A series has one point a month, so
    a window over it holds no more rows than there are months.
    """
    order = Window.partitionBy(*SERIES).orderBy("publication_date")
    rows = points.select(*SERIES, "publication_date", "cutoff_date").withColumn("moved_days", F.datediff("cutoff_date", F.lag("cutoff_date").over(order)))
    rows = rows.withColumn("trend_days", F.avg("moved_days").over(order.rowsBetween(1 - TREND, 0)))
    return estimates(rows, submission)


def _rows(points: list[tuple], start: int) -> list[tuple]:
    """(month, cutoff, moved, trend) of the points from `start` on."""
    moved: list[int | None] = [None]
    moved += [(b[1] - a[1]).days if a[1] is not None and b[1] is not None else None for a, b in zip(points, points[1:], strict=False)]
    known = [[m for m in moved[max(0, i - TREND + 1) : i + 1] if m is not None] for i in range(len(points))]
    return [(*points[i], moved[i], sum(known[i]) / len(known[i]) if known[i] else None) for i in range(start, len(points))]


def _take(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """New rows of a series: those of the months that came and of the months that they change."""
    epoch = datetime.date(1970, 1, 1)
    number = lambda d: None if d is None or pd.isna(d) else (d - epoch).days
    date = lambda n: None if n is None else epoch + datetime.timedelta(n)
    months, cuts, forgotten = state.get if state.exists else ([], [], -1)
    points = dict(zip(months, cuts, strict=True))
    came = {number(m): number(c) for batch in batches for m, c in zip(batch["publication_date"], batch["cutoff_date"], strict=True)}
    made, changed = [], []
    for m in sorted(came):
        # the row of a month looks TREND points back: with fewer of them left it can't be told
        told = forgotten < 0 or m in points or m > forgotten and sum(x < m for x in points) >= TREND
        if m in points and forgotten >= 0 and sum(x < m for x in points) < TREND and came[m] != points[m]:
            told = False
        if not told:
            made.append((date(m), date(came[m]), None, None, True))
        elif points.get(m, m) != came[m] or m not in points:
            points[m] = came[m]
            changed.append(m)
    if changed:
        order = sorted(points)
        at = order.index(min(changed))
        all_rows = _rows([(date(m), date(points[m])) for m in order], at)
        wanted = {j for m in changed for j in range(order.index(m), order.index(m) + TREND + 1)}
        made += [(*row, False) for j, row in enumerate(all_rows, at) if j in wanted]
        if len(order) > KEPT:
            forgotten = max(forgotten, order[-KEPT - 1])
            order = order[-KEPT:]
        state.update((order, [points[m] for m in order], forgotten))
    out = pd.DataFrame([(*key, *r) for r in made], columns=[*SERIES, "publication_date", "cutoff_date", "moved_days", "trend_days", "late"])
    yield out.astype({"moved_days": "Int32", "trend_days": "Float64", "late": "boolean"})


def movements_as_they_come(points: DataFrame) -> DataFrame:
    """A stream of points as a stream of movement rows; a later row of a series and month replaces an earlier one.

    A month may come in any order while the TREND months before it are among the KEPT that are held; one
    that comes later still is given out once with late = true and changes nothing: the table has to be built anew for it.
    """
    rows = points.select(*SERIES, "publication_date", "cutoff_date").where("publication_date is not null")
    return rows.groupBy(*SERIES).applyInPandasWithState(_take, _OUT, "months array<int>, cuts array<int>, forgotten int", "append", GroupStateTimeout.NoTimeout)


def keep_current(points: DataFrame, path: str, checkpoint: str, late: str | None = None) -> None:
    """Takes in all points that the stream has now: the table at `path` has one row for each series and month. late: a folder for months that came too late.

    Each batch replaces the years that it touches as a whole, so one that is run again changes nothing.
    """
    schema = _OUT.replace(", late boolean", "") + ", year int"

    def take(batch: DataFrame, number: int) -> None:
        rows = stored(batch)
        if late:
            rows.where("late").drop("late").write.mode("overwrite").parquet(f"{late}/batch={number}")
        new = rows.where("not late").drop("late").withColumn("year", F.year("publication_date"))
        spark: SparkSession = batch.sparkSession
        years = [r[0] for r in new.select("year").distinct().collect()]
        if not years:
            return
        try:
            old = spark.read.schema(schema).parquet(path).where(F.col("year").isin(years))
            old.take(0)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = spark.createDataFrame([], schema)
        same: Column = F.lit(True)
        named = new.select(*(F.col(c).alias(f"n_{c}") for c in [*SERIES, "publication_date"]))
        for c in [*SERIES, "publication_date"]:
            same = same & F.col(c).eqNullSafe(F.col(f"n_{c}"))
        merged = stored(old.join(named, same, "left_anti").unionByName(new))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)

    movements_as_they_come(points).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read(spark: SparkSession, path: str, submission: str | datetime.date) -> DataFrame:
    """The table that keep_current holds, with the columns of movement."""
    return estimates(spark.read.parquet(path).drop("year"), submission)
