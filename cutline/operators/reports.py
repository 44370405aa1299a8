"""The reports over the facts and the bulletins; each takes (cutoffs, bulletins)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutline.functions.vocabulary import CATEGORIES, COUNTRIES, DESCRIPTION, LICENSE, TITLE, TITLE_OF_ALL, employment_class, lookup


def summary_bulletins(facts: DataFrame, months: DataFrame) -> DataFrame:
    return months.agg(F.count("*").alias("n"), F.min("publication_date").alias("first"), F.max("publication_date").alias("last"))


def summary_total(facts: DataFrame, months: DataFrame) -> DataFrame:
    return facts.agg(F.count("*").alias("n"))


def summary_by_category(facts: DataFrame, months: DataFrame) -> DataFrame:
    return facts.groupBy("visa_category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "visa_category")


def status_distribution(facts: DataFrame, months: DataFrame) -> DataFrame:
    """Counts of current, unavailable and dated cutoffs, and their percentages (null for no rows)."""
    dated = ~F.col("is_current") & ~F.col("is_unavailable")
    counts = facts.agg(F.count("*").alias("total"), F.count_if("is_current").alias("current"), F.count_if("is_unavailable").alias("unavailable"), F.count_if(dated).alias("dated"))
    share = lambda c: F.round(F.try_divide(F.col(c) * 100.0, F.col("total")), 1).alias(f"{c}_percent")
    return counts.select("*", share("current"), share("unavailable"), share("dated"))


def bulletin_counts(facts: DataFrame, months: DataFrame) -> DataFrame:
    """Months with their numbers of cutoffs, 0 too; counted before the join, so the fact is shuffled once as counts."""
    counts = facts.groupBy("publication_date").agg(F.count("*").alias("n"))
    return months.join(counts, "publication_date", "left").select("publication_date", F.coalesce("n", F.lit(0)).cast("long").alias("n")).orderBy(F.desc("publication_date"))


def recent_records(facts: DataFrame, months: DataFrame) -> DataFrame:
    rows = facts.join(months, "publication_date").select("publication_date", "visa_category", "visa_class", "action_type", "country", "cutoff_value")
    return rows.orderBy(F.desc("publication_date"), "visa_category", "visa_class", "action_type", "country").limit(5)


def point_query(facts: DataFrame, months: DataFrame, search: str = "f1 china") -> DataFrame:
    """The latest 20 cutoffs of `class country`; dates where there are some, else the value; a mark for current ones.

    The class is the first word, in upper case; the other words, in lower case, are the country's code. Fewer than two words are a ValueError.
    """
    parts = search.upper().split()
    if len(parts) < 2:
        raise ValueError("search for a class and a country, as in 'F1 China'")
    country = " ".join(parts[1:]).lower()
    rows = facts.where((F.col("visa_class") == parts[0]) & (F.col("country") == country)).join(months.select("publication_date"), "publication_date")
    shown = F.coalesce(F.date_format("cutoff_date", "yyyy-MM-dd"), "cutoff_value")
    rows = rows.select("publication_date", "visa_category", "action_type", shown.alias("cutoff"), F.when(F.col("is_current"), "✓").otherwise("").alias("mark"))
    return rows.orderBy(F.desc("publication_date"), "visa_category", "action_type").limit(20)


def distinct_classes(facts: DataFrame, months: DataFrame) -> DataFrame:
    return facts.where("visa_category = 'employment_based'").select("visa_class").distinct().orderBy("visa_class")


def dedup_employment_classes(facts: DataFrame, months: DataFrame) -> DataFrame:
    """Display names with the spelling of their newest month (of several the smallest); empty names and C and U are left out."""
    rows = facts.where("visa_category = 'employment_based'").where(~F.col("visa_class").isin("", "C", "U", "c", "u")).withColumn("display", employment_class(F.col("visa_class"))).where("display <> ''")
    newest = rows.groupBy("display", "visa_class").agg(F.max("publication_date").alias("d"))
    return newest.groupBy("display").agg(F.min_by("visa_class", F.struct((-F.unix_date("d")).alias("d"), "visa_class")).alias("visa_class")).orderBy("display")


def column_widths(facts: DataFrame, months: DataFrame) -> DataFrame:
    columns = ["publication_date", "visa_category", "visa_class", "action_type", "country", "cutoff_value"]
    return facts.agg(*(F.max(F.length(F.col(c).cast("string"))).alias(c) for c in columns))


def refresh_summary(facts: DataFrame, months: DataFrame) -> DataFrame:
    """Of each month, whether it was taken in: counts of months with and without cutoffs, and of rows."""
    per_month = bulletin_counts(facts, months)
    return per_month.agg(F.count_if(F.col("n") > 0).alias("succeeded"), F.count_if(F.col("n") == 0).alias("failed"), F.sum("n").alias("rows"))


def sitemap_urls(facts: DataFrame, months: DataFrame, base: str = "https://example.org") -> DataFrame:
    """(url, last_month, n): the fixed pages, and those of each category and of each of its countries with the latest month and the number of cutoffs shown there."""
    spark = facts.sparkSession
    counts = facts.groupBy("visa_category", "country").agg(F.max("publication_date").alias("last"), F.count("*").alias("n"))
    wanted = [(c, k, f"{base}/{c.replace('_', '-')}/" + (f"{k}/" if k else "")) for c in CATEGORIES for k in ("", *COUNTRIES) if k != "all"]
    pages = spark.createDataFrame(wanted, "c string, k string, url string")
    shown = pages.join(F.broadcast(pages.sparkSession.createDataFrame([(k, x) for k in COUNTRIES for x in ({k, ""} - {"all"})], "country string, k string")), "k")
    shown = shown.join(counts, (shown["c"] == counts["visa_category"]) & (shown["country"] == counts["country"]), "left")
    shown = shown.groupBy("url").agg(F.max("last").alias("last_month"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    fixed = spark.createDataFrame([(f"{base}/{x}",) for x in ("", "faq/", "about/", "contact/")], "url string")
    return fixed.select("url", F.lit(None).cast("date").alias("last_month"), F.lit(None).cast("long").alias("n")).unionByName(shown)


def seo_metadata(facts: DataFrame, months: DataFrame, today: str = "2025-12-01", site: str = "Cutline", base: str = "https://example.org") -> DataFrame:
    """Title, description and structured data (JSON) of the page of each category and country; an unknown country is its own label."""
    day = F.lit(today).cast("date")
    country = F.coalesce(lookup(F.col("country"), COUNTRIES), F.col("country"))
    rows = facts.select("visa_category", "country").distinct()
    rows = rows.withColumns({"category_display": lookup(F.col("visa_category"), CATEGORIES), "country_display": country})
    general = (F.col("country") == "all") & (F.col("visa_category") == "family_sponsored")
    title = F.when(general, F.format_string(TITLE_OF_ALL, F.year(day))).otherwise(F.format_string(TITLE, "country_display", "category_display", F.date_format(day, "MMMM"), F.year(day)))
    rows = rows.withColumns({"page_title": title, "page_description": F.format_string(DESCRIPTION, "country_display", "category_display")})
    text = F.lit
    data = F.struct(
        text("https://schema.org").alias("@context"),
        text("Dataset").alias("@type"),
        F.col("page_title").alias("name"),
        F.col("page_description").alias("description"),
        F.struct(text("Organization").alias("@type"), text(site).alias("name"), text(base).alias("url")).alias("creator"),
        F.concat(text("visa bulletin, "), "country_display", text(", "), "category_display", text(", priority date, immigration, green card")).alias("keywords"),
        day.cast("string").alias("dateModified"),
        F.lit(True).alias("isAccessibleForFree"),
        text(LICENSE).alias("license"),
        F.struct(text("DataDownload").alias("@type"), F.concat(text(base + "/"), F.replace("visa_category", text("_"), text("-")), text("/"), "country", text("/")).alias("contentUrl"), text("text/html").alias("encodingFormat")).alias("distribution"),
    )
    return rows.select("visa_category", "country", "page_title", "page_description", F.to_json(data).alias("structured_data"))


def status_lines(facts: DataFrame, months: DataFrame) -> DataFrame:
    """The status distribution as lines of a report: name, count with thousands, percent (0.0 where there are no rows)."""
    rows = status_distribution(facts, months)
    line = lambda name, c: F.concat(F.rpad(F.lit(name), 19, " "), F.format_string("%,6d records (%.1f%%)", c, F.coalesce(F.try_divide(100.0 * F.col(c), F.col("total")), F.lit(0.0))))
    return rows.select(F.posexplode(F.array(line("Current (C):", "current"), line("Unavailable (U):", "unavailable"), line("With dates:", "dated"))).alias("place", "line"))


def category_lines(facts: DataFrame, months: DataFrame) -> DataFrame:
    return summary_by_category(facts, months).select(F.format_string("%-20s: %,6d records", "visa_category", "n").alias("line"))


def bulletin_lines(facts: DataFrame, months: DataFrame) -> DataFrame:
    return bulletin_counts(facts, months).select(F.format_string("%-15s %-,10d", F.col("publication_date").cast("string"), "n").alias("line"))


def headings(searches: DataFrame, search: str) -> DataFrame:
    """The rows with the heading of each point query: the class in upper case, and the country with a capital after every other character than a letter; null for fewer than two words."""
    words = F.split(F.trim(F.upper(search)), r"\s+")
    country = F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), " ")
    parts = F.regexp_extract_all(country, F.lit(r"[^\p{L}]*\p{L}+|[^\p{L}]+$"), F.lit(0))
    titled = F.array_join(F.transform(parts, lambda p: F.concat(F.regexp_extract(p, r"^[^\p{L}]*", 0), F.initcap(F.regexp_extract(p, r"\p{L}+$", 0)))), "")
    return searches.withColumn("heading", F.when(F.size(words) >= 2, F.concat(F.element_at(words, 1), F.lit(" - "), titled, F.lit(" (Last 20 bulletins)"))))


def point_heading(facts: DataFrame, months: DataFrame) -> DataFrame:
    """(search, heading, n) of the point query for each class and country that there are cutoffs of."""
    searches = facts.groupBy(F.concat_ws(" ", F.lower("visa_class"), "country").alias("search")).agg(F.count("*").alias("n"))
    return headings(searches, "search").select("search", "heading", "n")


def preview(months: DataFrame, most: int = 5) -> DataFrame:
    """(place, line): the newest months by name, then how many more there are."""
    names = months.orderBy(F.desc("publication_date")).limit(most)
    names = names.select(F.row_number().over(Window.orderBy(F.desc("publication_date"))).alias("place"), F.date_format("publication_date", "MMMM yyyy").alias("line"))  # of `most` rows
    more = months.agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.lit(most + 1).alias("place"), F.format_string("... and %d more", F.col("n") - most).alias("line"))
    return names.unionByName(more)


REPORTS = {f.__name__: f for f in (summary_bulletins, summary_total, summary_by_category, status_distribution, bulletin_counts, recent_records, point_query, distinct_classes, dedup_employment_classes, column_widths, refresh_summary, sitemap_urls, seo_metadata, status_lines, category_lines, bulletin_lines, point_heading)}
