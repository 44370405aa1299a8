"""The driver's order tables read as bulletins and cutoffs, so that every query runs on tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.functions.vocabulary import TITLES, cutoff_columns

KEY = ["publication_date", "visa_category", "visa_class", "action_type", "country"]
_FAMILY = ["1st,2A,2B,3rd,4th", "1 st,2 A,2 B,3 rd,4 th", "F1,F2A,F2B,F3,X"]
_EMPLOYMENT = ["1st,2nd,3rd,4th,5th Set Aside: (Rural - 20%)", "1 st,2 nd,3 rd,4 th,5th Unreserved (C5, T5, and all others)", "EB1,EB2,Other Workers,Certain Religious Workers,Foo  Bar"]
_COUNTRIES = "all,china,india,mexico,philippines,el_salvador_guatemala_honduras"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: a cell of a bulletin; row_ix orders cells of the same key."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    names = lambda rows: F.split(F.element_at(F.array(*map(F.lit, rows)), (F.col("o_orderkey") % 3 + 1).cast("int")), ",(?=[^ ])")
    digit = F.substring("o_orderpriority", 1, 1).cast("int")
    employment = F.col("o_custkey") % 2 == 0
    published = F.trunc(F.col("o_orderdate").cast("date"), "month")
    date = F.date_format(F.date_sub(published, F.floor(F.col("o_totalprice") / 100).cast("int")), "yyyy-MM-dd")
    return orders.select(
        published.alias("publication_date"),
        F.when(employment, "employment_based").otherwise("family_sponsored").alias("visa_category"),
        F.when(employment, F.element_at(names(_EMPLOYMENT), digit)).otherwise(F.element_at(names(_FAMILY), digit)).alias("visa_class"),
        F.when(F.col("o_orderstatus") == "F", "final_action").when(F.col("o_orderstatus") == "O", "filing").alias("action_type"),
        F.element_at(F.split(F.lit(_COUNTRIES), ","), (F.floor(F.col("o_custkey") / 2) % 6 + 1).cast("int")).alias("country"),
        F.when(F.col("o_orderkey") % 11 == 0, "U").when(F.col("o_orderkey") % 7 == 0, "C").when(F.col("o_orderkey") % 13 == 0, "NA").otherwise(date).alias("value"),
        F.col("o_orderkey").alias("row_ix"),
    ).where(F.col("action_type").isNotNull())


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of the rows of a key, the last in the given order: a grouped maximum, so rows combine before the shuffle."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*key, "_row.*")


def cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed fact table: the last cell of each key."""
    rows = last_wins(cells(spark, sf_dir), KEY, ["row_ix"])
    return rows.withColumns(cutoff_columns(F.col("value"), F.col("publication_date"), iso=True)).drop("value")


def bulletins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months with orders and the two after the last, without cutoffs; every third has no stored URL."""
    months = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("publication_date")).distinct()
    later = months.agg(F.max("publication_date").alias("m")).where("m is not null").select(F.explode(F.array(F.add_months("m", 1), F.add_months("m", 2))).alias("publication_date"))
    url = F.when(F.month("publication_date") % 3 != 0, F.concat(F.lit("https://example.org/"), F.date_format("publication_date", "yyyy-MM")))
    return months.union(later).select("publication_date", url.alias("url"))


#: The countries' headers in the order of their columns.
HEADERS = {"all": "All Chargeability Areas Except Those Listed", "china": "CHINA-mainland born", "el_salvador_guatemala_honduras": "EL SALVADOR GUATEMALA HONDURAS", "india": "INDIA", "mexico": "MEXICO", "philippines": "PHILIPPINES"}


def bulletin_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, content, publication_date): the months as pages of HTML with a table for each category and action that has cutoffs."""
    facts = cutoffs(spark, sf_dir)
    shown = F.when(F.length("cutoff_value") == 10, F.upper(F.date_format("cutoff_date", "ddMMMyy"))).otherwise(F.col("cutoff_value"))
    table = ["publication_date", "visa_category", "action_type"]
    by_class = facts.groupBy(*table, "visa_class").agg(F.map_from_entries(F.collect_list(F.struct("country", shown))).alias("cells"))
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), cell(F.col("visa_class")), *(cell(F.coalesce(F.try_element_at("cells", F.lit(c)), F.lit(""))) for c in HEADERS), F.lit("</tr>"))
    head = "".join(f"<td>{h}</td>" for h in ("Class", *HEADERS.values()))
    title = F.create_map(*(F.lit(x) for t, (category, action) in TITLES.items() for x in (f"{category} {action}", t)))[F.concat_ws(" ", "visa_category", "action_type")]
    rows = by_class.groupBy(*table).agg(F.array_sort(F.collect_list(F.struct("visa_class", row.alias("html")))).alias("rows"))
    joined = lambda c: F.array_join(F.transform(c, lambda r: r["html"]), "")
    html = F.concat(F.lit("<p><u>"), title, F.lit(f"</u></p><table><tr>{head}</tr>"), joined("rows"), F.lit("</table>"))
    content = rows.groupBy("publication_date").agg(joined(F.array_sort(F.collect_list(F.struct("visa_category", "action_type", html.alias("html"))))).alias("content"))
    url = F.concat(F.lit("visa-bulletin-for-"), F.lower(F.date_format("publication_date", "MMMM-yyyy")), F.lit(".html"))
    return bulletins(spark, sf_dir).join(content, "publication_date", "left").select(url.alias("url"), F.coalesce("content", F.lit("<p>No tables yet.</p>")).alias("content"), "publication_date")


def index_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(html): for each year a page of links to its months, some of them twice, some absolute, some without a month."""
    month = F.col("publication_date")
    file = F.concat(F.lit("visa-bulletin-for-"), F.date_format(month, "MMMM-yyyy"), F.lit(".html"))
    at = lambda start: F.concat(F.lit(f'<a class="x" href="{start}'), file, F.lit('">x</a>'))
    link = F.when(F.month(month) % 3 == 0, F.concat(at("/a/"), at("https://example.org/a/"))).when(F.month(month) % 3 == 1, at("b/")).otherwise(F.concat(at("/a/"), F.lit('<a href="/about.html">x</a>')))
    lost = F.concat(F.lit("<a href='/a/visa-bulletin-for-"), F.year(month), F.lit(".html'>x</a>"))
    return bulletins(spark, sf_dir).groupBy(F.year(month).alias("year")).agg(F.concat(F.array_join(F.array_sort(F.collect_list(link)), ""), F.first(lost)).alias("html")).select("html")
