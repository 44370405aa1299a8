"""The traces of charts, as rows. A chart is one category, country and action; its classes are its series."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutline.functions.vocabulary import shown_date

# The colours of the classes, in order.
PALETTE = ["#0d6efd", "#198754", "#dc3545", "#ffc107", "#6f42c1", "#fd7e14", "#20c997", "#e83e8c"]
CHART = ["visa_category", "country", "action_type"]


def trace_index(series: DataFrame) -> DataFrame:
    """The series (rows of projected_series) with has_projection, width (traces of a class), first_trace, place and color, in order of their labels within each chart."""
    rows = series.withColumn("has_projection", F.col("estimated_date").isNotNull() & F.col("last_cutoff").isNotNull()).withColumn("width", F.col("has_projection").cast("int") + 1)
    order = Window.partitionBy(*CHART).orderBy("visa_class_label")
    rows = rows.withColumns({"first_trace": (F.sum("width").over(order) - F.col("width")).cast("int"), "place": F.row_number().over(order) - 1})
    return rows.withColumn("color", F.element_at(F.array(*map(F.lit, PALETTE)), (F.col("place") % len(PALETTE) + 1).cast("int")))


def traces(series: DataFrame, submission: str | datetime.date) -> DataFrame:
    """(chart's columns, trace_idx, kind, visa_class_label, x, y, color): history of each class, its projection if there is one, and the line of the date itself.

    The line goes from the first class's first month to the furthest estimate (or that class's last
    month). All rows of a class are made from its one row, so nothing is joined.
    """
    sub, whole = F.lit(str(submission)).cast("date"), Window.partitionBy(*CHART)
    rows = trace_index(series)
    rows = rows.withColumns({"line_trace": F.sum("width").over(whole).cast("int"), "furthest": F.max(F.when(F.col("has_projection"), F.col("estimated_date"))).over(whole)})
    last = F.element_at("points", -1)["publication_date"]

    def row(trace, kind: str, x, y, color=F.col("color"), label=F.col("visa_class_label")):
        return F.struct(trace.alias("trace_idx"), F.lit(kind).alias("kind"), label.alias("visa_class_label"), x.alias("x"), y.alias("y"), color.alias("color"))

    def line(x):
        return row(F.col("line_trace"), "priority", x, sub, F.lit("red"), F.lit(None).cast("string"))

    history = F.transform("points", lambda p: row(F.col("first_trace"), "history", p["publication_date"], p["cutoff_date"]))
    ahead = F.array(*(row(F.col("first_trace") + 1, "projection", x, y) for x, y in ((last, F.col("last_cutoff")), (F.col("estimated_date"), sub))))
    lines = F.array(line(F.element_at("points", 1)["publication_date"]), line(F.coalesce("furthest", last)))
    every = F.concat(history, F.when(F.col("has_projection"), ahead).otherwise(F.array()), F.when(F.col("place") == 0, lines).otherwise(F.array()))
    return rows.select(*CHART, F.explode(every).alias("t")).select(*CHART, "t.*")


def shown(rows: DataFrame, classes: list[str]) -> DataFrame:
    """Traces of the chosen classes, and the priority line."""
    return rows.where(F.col("visa_class_label").isin(*classes) | (F.col("kind") == "priority"))


def visible_range(rows: DataFrame) -> DataFrame:
    """x and y ranges of each chart, in milliseconds, of all traces but the priority line, widened by 5 percent."""
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp")).cast("double")
    r = rows.where("kind <> 'priority'").groupBy(*CHART).agg(F.min(ms("x")).alias("a"), F.max(ms("x")).alias("b"), F.min(ms("y")).alias("c"), F.max(ms("y")).alias("d"))
    wide = lambda low, high: ((F.col(high) - F.col(low)) * 0.05)
    return r.select(*CHART, (F.col("a") - wide("a", "b")).alias("x_min"), (F.col("b") + wide("a", "b")).alias("x_max"), (F.col("c") - wide("c", "d")).alias("y_min"), (F.col("d") + wide("c", "d")).alias("y_max"))


def cards(series: DataFrame) -> DataFrame:
    """The series (rows of projected_series) that have an estimated date, for which alone a card is shown."""
    return series.where("estimated_date is not null")


def documents(series: DataFrame, submission: str | datetime.date) -> DataFrame:
    """One row per chart: chart_json (its traces in order), trace_info (JSON of each class's traces and colour), priority_date_trace_idx, submission_date_formatted.

    A trace has trace_idx, kind, name (null for the line of the date), color, x and y; dates are written YYYY-MM-DD, and a month without a cutoff has a null y.
    """
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    keys = [*CHART, "trace_idx", "kind", "visa_class_label", "color"]
    points = traces(series, submission).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("p"))
    axis = lambda name: F.transform("p", lambda point: day(point[name]))
    trace = F.struct("trace_idx", "kind", F.col("visa_class_label").alias("name"), "color", axis("x").alias("x"), axis("y").alias("y"))
    charts = points.groupBy(*CHART).agg(F.to_json(F.array_sort(F.collect_list(trace))).alias("chart_json"))
    indices = F.when(F.col("has_projection"), F.array(F.col("first_trace"), F.col("first_trace") + 1)).otherwise(F.array("first_trace"))
    info = F.struct("place", F.struct("visa_class", F.col("visa_class_label").alias("label"), "color", indices.alias("trace_indices")).alias("of"))
    classes = trace_index(series).groupBy(*CHART).agg(F.array_sort(F.collect_list(info)).alias("info"), F.sum("width").cast("int").alias("priority_date_trace_idx"))
    shown = shown_date(F.lit(str(submission)).cast("date"))
    return charts.join(classes, CHART).select(*CHART, "chart_json", F.to_json(F.transform("info", lambda i: i["of"])).alias("trace_info"), "priority_date_trace_idx", shown.alias("submission_date_formatted"))


# What a request asks for where it does not say.
DEFAULTS = {"visa_category": "family_sponsored", "country": "all", "action_type": "final_action"}


def requests(asked: DataFrame, series: DataFrame) -> DataFrame:
    """The rows asked, with what is missing of DEFAULTS filled in, the number of classes that the chart has, and has_data."""
    full = asked.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default)) for c, default in DEFAULTS.items()})
    counts = series.groupBy(*CHART).agg(F.count("*").alias("classes"))
    rows = full.join(counts, CHART, "left").withColumn("classes", F.coalesce("classes", F.lit(0)).cast("long"))
    return rows.withColumn("has_data", F.col("classes") > 0)
