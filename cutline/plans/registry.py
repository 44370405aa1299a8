"""All queries of the library by name, with SQL of the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.functions import vocabulary as v
from cutline.operators import chart, reports, series, store
from cutline.plans import analytics, sql
from cutline.sources import bindings, pages
from cutline.sources.bindings import bulletins, cells, cutoffs

SUBMISSION = "1993-06-01"
#: The chart and report queries look at one category, country and action.
ONE = "visa_category = 'employment_based' AND country = 'china' AND action_type = 'final_action'"
FLAGSHIP = "projection"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.points(cutoffs(spark, sf_dir))


def _chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.projected_series(series.points(cutoffs(spark, sf_dir).where(ONE)), SUBMISSION)


def projection(spark, sf_dir):
    return series.projection(_points(spark, sf_dir), SUBMISSION)


def class_points(spark, sf_dir):
    return _points(spark, sf_dir).select(*series.SERIES, "publication_date", "cutoff_date", "raw_class")


def class_series(spark, sf_dir):
    rows = series.series(_points(spark, sf_dir))
    return rows.select(*series.SERIES, "visa_class", F.size("points").cast("long").alias("n_points"), F.element_at("points", 1)["publication_date"].alias("first_date"), F.element_at("points", -1)["publication_date"].alias("last_date"), F.element_at("points", -1)["cutoff_date"].alias("last_cutoff"))


def cutoff_facts(spark, sf_dir):
    return cutoffs(spark, sf_dir).select(*store.FACT)


def series_join(spark, sf_dir):
    rows = cutoffs(spark, sf_dir).where(ONE).join(bulletins(spark, sf_dir), "publication_date")
    return rows.select("publication_date", "visa_class", "cutoff_value", v.bulletin_url(F.col("url"), F.col("publication_date")).alias("url"))


def upsert_cutoffs(spark, sf_dir):
    every = cells(spark, sf_dir)
    typed = every.select(*bindings.KEY, "row_ix", *(c.alias(n) for n, c in v.cutoff_columns(F.col("value"), F.col("publication_date"), iso=True).items()))
    old = store.upsert_cutoffs(typed.select(*store.FACT).limit(0), typed.where("row_ix % 4 <> 0"), ["row_ix"])
    return store.upsert_cutoffs(old, typed.where("row_ix % 4 = 0"), ["row_ix"])


def upsert_bulletins(spark, sf_dir):
    stored = bulletins(spark, sf_dir).where("month(publication_date) % 2 = 0").withColumn("url", F.when(F.month("publication_date") == 4, "").otherwise(F.col("url")))
    return store.upsert_bulletins(stored, bulletins(spark, sf_dir).select("publication_date", F.concat(F.lit("https://example.org/new/"), F.date_format("publication_date", "yyyyMM")).alias("url")))


def new_bulletins(spark, sf_dir):
    months = bulletins(spark, sf_dir)
    return store.new_bulletins(months, months.where("month(publication_date) <= 6")).select("publication_date", "url")


def new_bulletins_preview(spark, sf_dir):
    return reports.preview(new_bulletins(spark, sf_dir))


def series_with_projection(spark, sf_dir):
    """The points of every series with their urls, and the series' projection; ordered by label and month."""
    rows = series.projected_series(series.with_urls(_points(spark, sf_dir), bulletins(spark, sf_dir)), SUBMISSION)
    rows = rows.select(*series.SERIES, "visa_class", *series.PROJECTION, F.explode("points").alias("p")).select(*series.SERIES, "visa_class", *series.PROJECTION, "p.*")
    return rows.orderBy(*series.SERIES, "publication_date")


def trace_index(spark, sf_dir):
    return chart.trace_index(_chart(spark, sf_dir)).select("visa_class_label", "first_trace", "has_projection", "color")


def chart_traces(spark, sf_dir):
    return chart.traces(_chart(spark, sf_dir), SUBMISSION).drop(*chart.CHART)


def all_chart_traces(spark, sf_dir):
    return chart.traces(series.projected_series(_points(spark, sf_dir), SUBMISSION), SUBMISSION).select(*chart.CHART, "trace_idx", "kind", "visa_class_label", "x", "y", "color")


def shown_traces(spark, sf_dir):
    return chart.shown(chart_traces(spark, sf_dir), ["EB-1: Priority Workers", "EB-3: Other Workers"])


def visible_range(spark, sf_dir):
    return chart.visible_range(chart.traces(_chart(spark, sf_dir), SUBMISSION)).drop(*chart.CHART)


def chart_json(spark, sf_dir):
    return chart.documents(series.projected_series(_points(spark, sf_dir), SUBMISSION), SUBMISSION)


def projection_cards(spark, sf_dir):
    return chart.cards(series.projected_series(_points(spark, sf_dir), SUBMISSION)).select(*series.SERIES, *series.PROJECTION)


def chart_requests(spark, sf_dir):
    """Customers as visitors who ask for a category, a country and an action, or leave some of them out."""
    k = F.col("c_custkey")
    given = lambda c, rest, values: F.when(k % rest == 0, F.lit(None)).when(k % rest == 1, "").otherwise(F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))).alias(c)
    asked = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", given("visa_category", 5, ["family_sponsored", "employment_based"]), given("country", 7, ["all", "china", "india", "nowhere"]), given("action_type", 4, ["final_action", "filing", "dates_for_filing"]))
    return chart.requests(asked, series.series(_points(spark, sf_dir)))


def priority_line(spark, sf_dir):
    return chart_traces(spark, sf_dir).where("kind = 'priority'").select("x", "y")


def link_discovery(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.links(table, "https://example.org", contains="th", ends="e")


def index_links(spark, sf_dir):
    return pages.links(bindings.index_pages(spark, sf_dir), "https://example.org")


def _spread(spark: SparkSession, sf_dir: str, column: str, texts: list[tuple]) -> DataFrame:
    """(o_orderkey, column): the texts dealt over all orders."""
    every = F.array(*(F.lit(t) for (t,) in texts))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.element_at(every, (F.col("o_orderkey") % len(texts) + 1).cast("int")).alias(column))


NAMES = [(x,) for x in ("1st", "1 st", "2nd", "3rd", "3rd Other Workers", "4th", "4th Religious", "5th Set Aside: (Rural - 20%)", "5th Set Aside: (Rural: NR, RR - 20%)", "5th Set Aside: (High Unemployment - 10%)", "5th Set Aside: Infrastructure (2%, including RI)", "5th Set Aside: (Infrastructure - 2%)", "RURAL (20%)", "High Unemployment (10%, including NH, RH)", "Unknown Visa Class XYZ", "EB-1", "Infrastructure (2%, including RI)", "5th Unreserved (C5, T5, and all others)", "5th Non-Regional Center (C5 and T5)", "5th Targeted Employ-ment Areas", "5th Pilot Programs", "EB5", "EB1", "Other Workers", "Certain RELIGIOUS Workers", "Schedule A Workers", "Iraqi & Afghani Translators", "Foo  Bar", "A - B", "C", "current 5")]
HEADERS = [(x,) for x in ("CHINA-mainland born", "CHINA", "INDIA", " india ", "MEXICO", "Philippines", "EL SALVADOR GUATEMALA HONDURAS", "All Chargeability Areas Except Those Listed", "All Chargeability  Areas\nExcept Those Listed", "ALL AREAS", "DOMINICAN REPUBLIC", "")]
CELLS = [(x,) for x in ("01DEC14", "01APR01", "C", "U", "01DEC98", "01JAN69", "01JAN68", "01dec14", "1DEC14", "31FEB20", "01SEPT20", "", "NA", "2016-11-08")]
FAMILY = [(x,) for x in ("1st", "1 st", "2A", "2 A", "2B", "3rd", "4th", "F4", "X")]
LINES = [(x,) for x in ("  multiple   spaces  ", "line\nbreak\nhere", "tab\ttab\ttab", "a\xa0b", "")]
DATES = [(x,) for x in ("01/15/2024", "1/5/2024", "2024-01-01", "2024-1-1", "invalid-date", "", "13/01/2024", "2024-02-30")]


def employment_class(spark, sf_dir):
    return _spread(spark, sf_dir, "name", NAMES).withColumn("display", v.employment_class(F.col("name")))


def family_class(spark, sf_dir):
    return _spread(spark, sf_dir, "name", FAMILY).withColumn("display", v.family_class(F.col("name")))


def country_from_header(spark, sf_dir):
    return _spread(spark, sf_dir, "header", HEADERS).withColumn("country", v.country_from_header(F.col("header")))


def cell_dates(spark, sf_dir):
    rows = _spread(spark, sf_dir, "cell", CELLS).withColumn("published", F.lit("2025-12-01").cast("date"))
    return rows.select("o_orderkey", "cell", *(c.alias(n) for n, c in v.cutoff_columns(F.col("cell"), F.col("published")).items()))


def month_math(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("date").alias("a"), F.col("o_custkey"))
    rows = orders.withColumn("b", F.date_add("a", (F.col("o_custkey") * 37 % 900 - 300).cast("int")))
    return rows.select("o_orderkey", "a", "b", v.months_between(F.col("a"), F.col("b")).alias("months"), v.add_months(F.col("a"), F.lit(3)).alias("later"))


def submission_dates(spark, sf_dir):
    return _spread(spark, sf_dir, "given", DATES).withColumn("submission", v.submission_date(F.col("given"), F.lit("2025-12-01").cast("date")))


def bulletin_urls(spark, sf_dir):
    return bulletins(spark, sf_dir).select("publication_date", v.bulletin_url(F.col("url"), F.col("publication_date")).alias("url"))


def normalize_text(spark, sf_dir):
    return _spread(spark, sf_dir, "line", LINES).withColumn("clean", v.normalize(F.col("line")))


def masked_dates(spark, sf_dir):
    typed = F.col("typed")
    return _spread(spark, sf_dir, "typed", TYPED).select("o_orderkey", "typed", v.masked_date(typed).alias("masked"), v.is_valid_date(typed).alias("valid"))


def unpivot_cells(spark, sf_dir):
    return pages.unpivot(_parsed(spark, sf_dir)).select(*store.FACT)


def table_extract(spark, sf_dir):
    return _parsed(spark, sf_dir).where("table_ix is not null").select("url", "publication_date", "table_ix", "title", "row_ix", F.array_join("cells", "|").alias("cells"))


def page_outcomes(spark, sf_dir):
    return pages.outcomes(_parsed(spark, sf_dir))


def page_counters(spark, sf_dir):
    return pages.run_counters(pages.outcomes(_parsed(spark, sf_dir)))


TYPED = [(x,) for x in ("01/15/2024", "1/5/2024", "01152024", "0115", "1", "13/01/2024", "02/30/2024", "02/29/2024", "01/32/2024", "12/31/1989", "01/01/2031", "abc", "", "2024-01-01")]
MODERN = "<p>x</p><u>FINAL ACTION DATES FOR FAMILY-SPONSORED PREFERENCE CASES</u><table><tr><td>Family- Sponsored</td><td>All Chargeability Areas Except Those Listed</td><td>CHINA-mainland born</td><td>DOMINICAN REPUBLIC</td></tr><tr><td>F1</td><td>01DEC14</td><td>C</td><td>U</td></tr><tr><td>F2A</td><td>U</td></tr></table><u>Other</u><table><tr><td>a</td><td>b</td></tr></table>"
LEGACY = "<table><tr><td>Family</td><td>All Chargeability Areas Except Those Listed</td><td>INDIA</td></tr><tr><td>1<sup>st</sup></td><td>01APR01</td><td>NA</td></tr></table>"


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the tables in all months' pages."""
    return pages.tables(bindings.bulletin_pages(spark, sf_dir))


QUERIES = {f.__name__: f for f in (projection, class_points, class_series, cutoff_facts, series_join, upsert_cutoffs, upsert_bulletins, new_bulletins, new_bulletins_preview, series_with_projection, trace_index, chart_traces, all_chart_traces, shown_traces, visible_range, chart_json, projection_cards, chart_requests, priority_line, link_discovery, index_links, employment_class, family_class, country_from_header, cell_dates, month_math, submission_dates, bulletin_urls, normalize_text, masked_dates, unpivot_cells, table_extract, page_outcomes, page_counters)}
QUERIES |= {name: (lambda spark, sf_dir, f=f: f(cutoffs(spark, sf_dir), bulletins(spark, sf_dir))) for name, f in reports.REPORTS.items()}
QUERIES |= analytics.QUERIES
#: The texts that are dealt over the orders, and the column that holds them.
TEXTS = {"employment_class": ("name", NAMES), "family_class": ("name", FAMILY), "country_from_header": ("header", HEADERS), "cell_dates": ("cell", CELLS), "submission_dates": ("given", DATES), "normalize_text": ("line", LINES), "masked_dates": ("typed", TYPED)}
ORACLE_SQL = sql.queries(SUBMISSION, ONE, TEXTS) | analytics.ORACLE_SQL
