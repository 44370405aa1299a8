"""Cutoff series by class, and when a given date will be reached."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.functions.vocabulary import FAMILY_LABELS, add_months, bulletin_url, employment_class, family_class, lookup, months_between

SERIES = ["visa_category", "country", "action_type", "visa_class_label"]
PROJECTION = ["status", "message", "estimated_date", "months_to_wait", "avg_progress_days_per_month", "method"]
EPOCH = datetime.date(2000, 1, 1)
# The messages of a projection.
REACHED = "Your application date has already been reached!"
REACHED_BY_TREND = "Your application date has already been reached (based on historical trend)!"
NO_MOVEMENT = "No forward progress detected in recent months."
ESTIMATE = ("Estimated processing in ", " months", " (based on long-term trend)")


def display(rows: DataFrame) -> DataFrame:
    """Rows of recognised classes with their normalised class (`label_key`) and label; others are dropped."""
    employment = F.col("visa_category") == "employment_based"
    key = F.when(employment, employment_class(F.col("visa_class"))).otherwise(family_class(F.col("visa_class")))
    rows = rows.withColumn("label_key", key)
    known = F.when(employment, (F.col("label_key") != "") & (F.col("label_key") != F.col("visa_class"))).otherwise(F.col("label_key").isin(*FAMILY_LABELS))
    return rows.where(known).withColumn("visa_class_label", F.when(employment, F.col("label_key")).otherwise(lookup(F.col("label_key"), FAMILY_LABELS)))


def effective_cutoff() -> Column:
    return F.when(F.col("is_current"), F.col("publication_date")).when(F.col("is_unavailable"), F.lit(None).cast("date")).otherwise(F.col("cutoff_date"))


def points(cutoffs: DataFrame) -> DataFrame:
    """One point per series and month; of several spellings of a class the first in order wins (a grouped minimum)."""
    first = F.min_by(F.struct(effective_cutoff().alias("cutoff_date"), "visa_class"), "visa_class")
    rows = display(cutoffs).groupBy(*SERIES, "label_key", "publication_date").agg(first.alias("p"))
    return rows.select(*SERIES, "label_key", "publication_date", F.col("p.cutoff_date").alias("cutoff_date"), F.col("p.visa_class").alias("raw_class"))


def with_urls(points: DataFrame, bulletins: DataFrame) -> DataFrame:
    """Points with the url of their month's bulletin, stored or made from the month."""
    stored = bulletins.groupBy("publication_date").agg(F.min("url").alias("url"))
    return points.join(stored, "publication_date", "left").withColumn("url", bulletin_url(F.col("url"), F.col("publication_date")))


def _gathered(points: DataFrame) -> list[Column]:
    """Aggregates of a series (a point a month): its class, and the points in order of their months."""
    parts = [c for c in ("publication_date", "cutoff_date", "url") if c in points.columns]
    employment = F.col("visa_category") == "employment_based"
    return [F.min(F.when(employment, F.col("raw_class")).otherwise(F.col("label_key"))).alias("visa_class"), F.array_sort(F.collect_list(F.struct(*parts))).alias("points")]


def series(points: DataFrame) -> DataFrame:
    """One row per series: its class and the points (with urls if they have them) in order of their months."""
    return points.groupBy(*SERIES).agg(*_gathered(points)).select(*SERIES, "visa_class", "points")


def projection(points: DataFrame, submission: str | datetime.date) -> DataFrame:
    """One row per series: status, message, estimated_date, months_to_wait, avg_progress_days_per_month, method; status null where there are under two points.

    The recent rate comes from the last 12 points that have a cutoff; without progress there, from a
    regression over all of them. Estimated dates beyond year 9999 are null.
    """
    return projected_series(points, submission).select(*SERIES, *PROJECTION)


def projected_series(points: DataFrame, submission: str | datetime.date) -> DataFrame:
    """One row per series: visa_class, points, last_cutoff and the columns of projection, all from one aggregate."""
    sub = F.lit(str(submission)).cast("date")
    x, y = F.datediff("publication_date", F.lit(EPOCH)).cast("long"), F.datediff("cutoff_date", F.lit(EPOCH)).cast("long")
    s = points.groupBy(*SERIES).agg(
        *_gathered(points),
        F.count("*").alias("n_dates"),
        F.count("cutoff_date").alias("n"),
        F.sum(F.when(F.col("cutoff_date").isNotNull(), x)).alias("sx"),
        F.sum(y).alias("sy"),
        F.sum(x * y).alias("sxy"),
        F.sum(F.when(F.col("cutoff_date").isNotNull(), x * x)).alias("sxx"),
    )
    s = s.withColumn("recent", F.filter("points", lambda p: p["cutoff_date"].isNotNull()))
    s = s.withColumns({"a": F.get("recent", F.greatest(F.lit(0), F.col("n") - 12).cast("int")), "z": F.try_element_at("recent", F.lit(-1))}).drop("recent")
    months = months_between(F.col("a.publication_date"), F.col("z.publication_date"))
    s = s.withColumns({
        "last_pub": F.col("z.publication_date"),
        "last_cut": F.col("z.cutoff_date"),
        "rate": F.datediff("z.cutoff_date", "a.cutoff_date") / F.when(months == 0, 1).otherwise(months).cast("double"),
        "den": F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"),
    })
    s = s.withColumn("slope", F.when((F.col("n") >= 6) & (F.col("den") != 0), (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")).cast("double") / F.col("den").cast("double")))
    s = s.withColumn("icpt", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n"))
    days = lambda v: F.date_add(F.lit(EPOCH), v.cast("int"))
    up = F.col("slope") > 0
    reach = F.when(up, (F.datediff(sub, F.lit(EPOCH)) - F.col("icpt")) / F.col("slope"))
    wait = F.when(F.col("rate") > 0, F.datediff(sub, "last_cut") / F.col("rate"))
    s = s.withColumns({
        "trend": F.when(up, days(F.col("slope") * F.datediff("last_pub", F.lit(EPOCH)) + F.col("icpt"))),
        "hist": F.when(F.abs(reach) < 2_900_000, days(reach)),
        "wait": F.when(wait < 2_000_000_000, F.floor(wait).cast("int")),
    })
    s = s.withColumn("hist_wait", F.greatest(F.lit(0), months_between(F.col("last_pub"), F.col("hist"))))
    kind = (
        F.when((F.col("n_dates") < 2) | (F.col("n") < 2), None)
        .when(F.col("last_cut") >= sub, "current")
        .when(F.col("rate") > 0, "projected")
        .when(up & (F.col("trend") >= sub), "trend_current")
        .when(up, "projected_historical")
        .otherwise("no_movement")
    )
    s = s.withColumn("kind", kind)
    case = lambda **by: F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in by.items()))
    near = F.when(F.col("wait") < 95_000, add_months(F.col("last_pub"), F.col("wait")))
    end = lambda d: F.when(d <= F.lit(datetime.date(9999, 12, 31)), d)
    text = lambda w, tail: F.concat(F.lit(ESTIMATE[0]), w.cast("string"), F.lit(ESTIMATE[1] + tail))
    return s.select(
        *SERIES,
        "visa_class",
        "points",
        F.col("last_cut").alias("last_cutoff"),
        F.when(F.col("kind") == "trend_current", "current").otherwise(F.col("kind")).alias("status"),
        case(
            current=F.lit(REACHED),
            trend_current=F.lit(REACHED_BY_TREND),
            no_movement=F.lit(NO_MOVEMENT),
            projected=text(F.col("wait"), ""),
            projected_historical=text(F.col("hist_wait"), ESTIMATE[2]),
        ).alias("message"),
        case(projected=end(near), projected_historical=end(F.col("hist"))).alias("estimated_date"),
        case(current=F.lit(0), trend_current=F.lit(0), projected=F.col("wait"), projected_historical=F.col("hist_wait")).cast("int").alias("months_to_wait"),
        case(projected=F.bround("rate", 1), projected_historical=F.bround(F.col("slope") * 30, 1)).alias("avg_progress_days_per_month"),
        case(projected_historical=F.lit("historical_regression")).alias("method"),
    )
