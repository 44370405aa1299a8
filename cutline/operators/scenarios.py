"""How long a wait may be if cutoffs go on moving as they did in some period, or faster or slower."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.operators.series import SERIES

#: (name, the rate it starts from, what that is multiplied by): the best or the latest period's.
SCENARIOS = [("optimistic", "best", 1.0), ("current", "latest", 1.0), ("pessimistic", "latest", 0.5), ("doubled quota", "latest", 2.0)]
YEARS = 5


def period_rates(points: DataFrame, years: int = YEARS) -> DataFrame:
    """(series, period, n, first_date, last_date, last_cutoff, months_per_year): movement of each series in each period of `years` years (by its first year) that has points with a cutoff.

    months_per_year is null where a period has one such point. From one aggregate.
    """
    dated = points.where(F.col("cutoff_date").isNotNull())
    point = F.struct("publication_date", "cutoff_date")
    ends = dated.groupBy(*SERIES, (F.floor(F.year("publication_date") / years) * years).cast("int").alias("period")).agg(F.count("*").alias("n"), F.min(point).alias("a"), F.max(point).alias("z"))
    days = F.datediff("z.publication_date", "a.publication_date")
    rate = F.when(days > 0, F.datediff("z.cutoff_date", "a.cutoff_date") * 12.0 / days)
    return ends.select(*SERIES, "period", "n", F.col("a.publication_date").alias("first_date"), F.col("z.publication_date").alias("last_date"), F.col("z.cutoff_date").alias("last_cutoff"), rate.alias("months_per_year"))


def wait_scenarios(points: DataFrame, submission: str | datetime.date, scenarios: list[tuple[str, str, float]] = SCENARIOS, years: int = YEARS) -> DataFrame:
    """(series, scenario, last_cutoff, gap_months, months_per_year, wait_years) of each series and scenario.

    gap_months: from the last cutoff to the date asked for, of 30.4375 days, 0 if it is reached, when the wait is 0 too. The wait is null where nothing moves forward.
    """
    rates = period_rates(points, years)
    moving = F.col("months_per_year").isNotNull()
    one = rates.groupBy(*SERIES).agg(F.max("months_per_year").alias("best"), F.max_by("months_per_year", F.when(moving, F.col("period"))).alias("latest"), F.max_by("last_cutoff", "period").alias("last_cutoff"))
    gap = F.greatest(F.datediff(F.lit(str(submission)).cast("date"), "last_cutoff"), F.lit(0)) / F.lit(30.4375)
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("scenario"), (F.col(base) * F.lit(float(by))).alias("months_per_year")) for name, base, by in scenarios)))
    rows = one.select(*SERIES, "last_cutoff", gap.alias("gap_months"), each.alias("s")).select(*SERIES, "s.scenario", "last_cutoff", "gap_months", "s.months_per_year")
    return rows.withColumn("wait_years", F.when(F.col("gap_months") == 0, F.lit(0.0)).when(F.col("months_per_year") > 0, F.col("gap_months") / F.col("months_per_year")))


def reform_impact(points: DataFrame, submission: str | datetime.date, years: int = YEARS, model: str = "all") -> DataFrame:
    """(series, wait_before, wait_after, change_years, outcome): each series' wait at its own latest rate, and at the latest rate that `model`'s series of the same category, action and class has, as if limits by country were gone.

    outcome: winner or loser by whether the wait becomes shorter or longer (one that never ends is longer than any), same, or null where the model has no such series.
    """
    waits = wait_scenarios(points, submission, [("now", "latest", 1.0)], years)
    keys = [c for c in SERIES if c != "country"]
    models = waits.where(F.col("country") == model).select(*(F.col(c).alias(f"of_{c}") for c in keys), F.col("months_per_year").alias("rate"))
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in keys]
    rows = waits.join(models, same, "left")
    after = F.when(F.col("gap_months") == 0, F.lit(0.0)).when(F.col("rate") > 0, F.col("gap_months") / F.col("rate"))
    rows = rows.select(*SERIES, F.col("wait_years").alias("wait_before"), F.when(F.col("of_visa_class_label").isNotNull(), after).alias("wait_after"), F.col("of_visa_class_label").isNotNull().alias("known"))
    never = F.lit(float("inf"))
    b, a = F.coalesce("wait_before", never), F.coalesce("wait_after", never)
    outcome = F.when(F.col("known"), F.when(a < b, "winner").when(a > b, "loser").otherwise("same"))
    return rows.select(*SERIES, "wait_before", "wait_after", (F.col("wait_after") - F.col("wait_before")).alias("change_years"), outcome.alias("outcome"))
