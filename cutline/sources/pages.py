"""Bulletin pages: links to them, their months, and the tables in their HTML."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.functions.vocabulary import FAMILY_LEGACY, TITLES, absolute_url, cell_date, country_from_header, cutoff_columns, month_of_name

LAYOUT = "url string, publication_date date, page_ix long, table_ix int, title string, headers array<string>, row_ix int, cells array<string>, error string"


#: The value of an anchor's href, in quotes of either kind or bare.
_HREF = r"""(?i)<a\s(?:[^>"']|"[^"]*"|'[^']*')*?(?<=[\s"'])href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
#: The entities that occur in links; the ampersand last, so that nothing is decoded twice.
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&#38;": "&", "&amp;": "&"}


def _unescaped(value: Column) -> Column:
    """An attribute's value without its quotes and entities."""
    value = F.trim(F.regexp_replace(value, r"""^["']|["']$""", ""))
    for entity, meant in _ENTITIES.items():
        value = F.replace(value, F.lit(entity), F.lit(meant))
    return value


def links(pages: DataFrame, base: str, contains: str = "visa-bulletin-for", ends: str = ".html", html: str = "html") -> DataFrame:
    """(url, publication_date): distinct absolute links of the pages, newest month first (without a month last)."""
    attributes = F.regexp_extract_all(F.col(html), F.lit(_HREF), 1)
    hrefs = pages.select(F.explode(F.transform(attributes, _unescaped)).alias("href")).where(F.col("href").contains(contains) & F.col("href").endswith(ends)).distinct()
    urls = hrefs.select(absolute_url(F.col("href"), base).alias("url"))
    return urls.withColumn("publication_date", month_of_name(F.col("url"))).orderBy(F.desc_nulls_last("publication_date"), "url")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(url, content, publication_date) of the saved pages in a folder, by their names; files without a month are passed over."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("url"), F.col("value").alias("content"))
    return files.withColumn("publication_date", month_of_name(F.col("url"))).where("publication_date is not null")


class _Tables(HTMLParser):
    """Collects the tables of a page: the underlined texts before each, and its rows of (tag, text) cells."""

    def __init__(self):
        super().__init__()
        self.underlined: list[str] = []
        self.tables: list[tuple[list[str], list[list[tuple[str, str]]]]] = []
        self._open: list[int] = []
        self._u: list[str] | None = None
        self._cells: list[tuple[str, list[str], int, int]] = []

    def handle_starttag(self, tag, attrs):
        if tag == "u":
            self._u = []
        elif tag == "table":
            self.tables.append((list(self.underlined), []))
            self._open.append(len(self.tables) - 1)
        elif tag == "tr" and self._open:
            for i in self._open:
                self.tables[i][1].append([])
        elif tag in ("td", "th") and self._open:
            for i in self._open:
                if not self.tables[i][1]:
                    self.tables[i][1].append([])
                self.tables[i][1][-1].append((tag, []))

    def handle_endtag(self, tag):
        if tag == "u" and self._u is not None:
            self.underlined.append(" ".join(x for x in self._u if x))
            self._u = None
        elif tag == "table" and self._open:
            self._open.pop()

    def handle_data(self, data):
        text = data.strip()
        if self._u is not None:
            self._u.append(text)
        if text:
            for i in self._open:
                rows = self.tables[i][1]
                if rows and rows[-1]:
                    rows[-1][-1][1].append(text)


def _clean(text: str) -> str:
    return " ".join(text.replace("\xa0", " ").split())


def page_tables(html: str) -> list[tuple[str, list[list[str]]]]:
    """(title, rows) of a page's tables, the first row holding the headers.

    The title is the underlined text before the table, `earlier than` being passed over; it is given up
    at the twentieth such text, whatever that says. A page without
    any such table is read by the older layout: the first cell names the kind of class.
    """
    parser = _Tables()
    parser.feed(html or "")
    found = []
    for before, rows in parser.tables:
        title = next((t for t in map(_clean, reversed(before[-19:])) if t != "earlier than"), None)
        data = [[" ".join(text) for tag, text in row if tag == "td"] for row in rows]
        if title in TITLES and data and len(data[0]) > 1:
            found.append((title, [row for row in data if row]))
    if found:
        return found
    kinds = {"family": "FINAL ACTION DATES FOR FAMILY-SPONSORED PREFERENCE CASES", "employment": "FINAL ACTION DATES FOR EMPLOYMENT-BASED PREFERENCE CASES"}
    for _, rows in parser.tables:
        if len(rows) < 2 or not rows[0]:
            continue
        headers = [_clean(" ".join(text)) for _, text in rows[0]]
        kind = next((k for k in kinds if k in headers[0].lower()), None)
        if kind is None:
            continue
        body = [[" ".join(text) for tag, text in row if tag == "td"] for row in rows[1:]]
        body = [[FAMILY_LEGACY.get(r[0], r[0]) if kind == "family" else r[0], *r[1:]] for r in body if len(r) > 1]
        if body:
            found.append((kinds[kind], [headers, *body]))
    return found


def tables(pages: DataFrame, url: str = "url", content: str = "content", parse: Callable[[str], list[tuple[str, list[list[str]]]]] = page_tables) -> DataFrame:
    """One row per table row (row_ix 0: headers) of each page; HTML is parsed in Python, a batch of pages at a time.

    Each row carries its page's month and its table's headers, and page_ix tells pages of one url apart,
    so nothing is joined later. A page without tables gives one row without table_ix; one that cannot be
    parsed gives such a row with its error, and the other pages go on.
    """
    names = [x.split()[0] for x in LAYOUT.split(", ")]

    def page(url: str, published, page_ix: int, html: str) -> list[tuple]:
        try:
            found = parse(html)
        except Exception as e:  # whatever is wrong with a page is its own outcome
            return [(url, published, page_ix, None, None, None, None, None, f"{type(e).__name__}: {e}")]
        rows = [(url, published, page_ix, t, title, body[0], r, cells, None) for t, (title, body) in enumerate(found) for r, cells in enumerate(body)]
        return rows or [(url, published, page_ix, None, None, None, None, None, None)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [row for given in zip(*(batch[c] for c in ("url", "publication_date", "page_ix", "content")), strict=True) for row in page(*given)]
            made = pd.DataFrame(rows, columns=names)
            yield made.astype({"table_ix": "Int32", "row_ix": "Int32"})

    columns = [F.col(url).alias("url"), F.col("publication_date"), F.monotonically_increasing_id().alias("page_ix"), F.col(content).alias("content")]
    return pages.select(*columns).mapInPandas(run, LAYOUT)


def unpivot(rows: DataFrame) -> DataFrame:
    """Cutoff cells of the tables: one row per class and country that the header names; cells without a header (or the reverse) are dropped."""
    body = rows.where("row_ix > 0")
    cells = body.select("*", F.posexplode("cells").alias("col_ix", "value")).where((F.col("col_ix") > 0) & (F.col("col_ix") < F.size("headers")))
    cells = cells.withColumn("country", country_from_header(F.element_at("headers", F.col("col_ix") + 1))).where("country is not null")
    kind = lambda i: F.create_map(*(F.lit(x) for t, v in TITLES.items() for x in (t, v[i])))[F.col("title")]
    first = F.element_at("cells", 1)
    return cells.select("publication_date", kind(0).alias("visa_category"), F.coalesce(F.date_format(cell_date(first), "yyyy-MM-dd"), first).alias("visa_class"), kind(1).alias("action_type"), "country", "page_ix", "table_ix", "row_ix", "col_ix", *(c.alias(n) for n, c in cutoff_columns(F.col("value"), F.col("publication_date")).items()))


def outcomes(rows: DataFrame) -> DataFrame:
    """(url, publication_date, tables, rows, error) of each page that was parsed."""
    each = rows.groupBy("page_ix", "url", "publication_date").agg(F.count_if(F.col("row_ix") == 0).alias("tables"), F.count_if(F.col("row_ix") > 0).alias("rows"), F.max("error").alias("error"))
    return each.drop("page_ix")


def run_counters(outcomes: DataFrame) -> DataFrame:
    """(pages, succeeded, failed, rows, exit_status) of a run: 1 where a page failed, else 0."""
    failed = F.count_if(F.col("error").isNotNull())
    return outcomes.agg(F.count("*").alias("pages"), F.count_if(F.col("error").isNull()).alias("succeeded"), failed.alias("failed"), F.coalesce(F.sum("rows"), F.lit(0).cast("long")).alias("rows"), F.when(failed > 0, 1).otherwise(0).alias("exit_status"))
