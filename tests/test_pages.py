import datetime

from pyspark.sql import functions as F

from cutline.plans.registry import LEGACY, MODERN
from cutline.sources import pages

TITLE = "FINAL ACTION DATES FOR FAMILY-SPONSORED PREFERENCE CASES"
DAY = datetime.date(2023, 3, 1)


def _tables(spark, rows, **given):
    return pages.tables(spark.createDataFrame(rows, "url string, content string, publication_date date"), **given)


def test_the_twentieth_underline_is_one_too_many():
    page = lambda n, title=TITLE: f"<u>{title}</u>" + "<u>earlier than</u>" * n + "<table><tr><td>a</td><td>INDIA</td></tr><tr><td>F1</td><td>C</td></tr></table>"
    assert pages.page_tables(page(0)) and pages.page_tables(page(18))
    assert not pages.page_tables(page(19)) and not pages.page_tables(page(20))
    assert not pages.page_tables(page(2, "other"))


def test_legacy_tables():
    head = "<table><tr><td>Family</td><td>INDIA</td></tr>"
    rows = lambda *names: "".join(f"<tr><td>{n}</td><td>C</td></tr>" for n in names)
    ((_, body),) = pages.page_tables(head + rows("1st", "2 A", "2  A", "F9") + "</table>")
    assert [r[0] for r in body[1:]] == ["F1", "F2A", "2  A", "F9"]
    assert not pages.page_tables(head + "</table>") and not pages.page_tables(head + "<tr><td>only</td></tr></table>")


def test_links(spark):
    html = """<A class="a>b" HREF="/x/visa-bulletin-for-may-2020.html">x</A> <a href=/y/visa-bulletin-for-june-2020.html>y</a>
      <a data-href="/no/visa-bulletin-for-no.html" href='z/visa-bulletin-for-a&amp;b.html'>z</a> <a href="/w/visa-bulletin-for-july-2020.html#top">w</a> <a>none</a> <area href="/visa-bulletin-for-x.html">"""
    found = pages.links(spark.createDataFrame([(html,), (None,), (html,)], "html string"), "https://e.org", ends="")
    assert [(r["url"], str(r["publication_date"])) for r in found.collect()] == [("https://e.org/w/visa-bulletin-for-july-2020.html#top", "2020-07-01"), ("https://e.org/y/visa-bulletin-for-june-2020.html", "2020-06-01"), ("https://e.org/x/visa-bulletin-for-may-2020.html", "2020-05-01"), ("https://e.org/z/visa-bulletin-for-a&b.html", "None")]


def test_pages_of_one_url_stay_apart(spark):
    rows = _tables(spark, [("x", MODERN, DAY), ("x", MODERN, DAY), ("x", LEGACY, datetime.date(2003, 3, 1))])
    assert pages.unpivot(rows).count() == 3 + 3 + 2
    assert rows.select("page_ix").distinct().count() == 3


def test_a_bad_page_is_its_own_outcome(spark):
    def parse(html):
        if html == "bad":
            raise ValueError("no page")
        return pages.page_tables(html)

    rows = _tables(spark, [("a", "bad", DAY), ("b", MODERN, DAY), ("c", None, DAY), (None, "", None)], parse=parse)
    found = {r["url"]: (r["tables"], r["rows"], r["error"]) for r in pages.outcomes(rows).collect()}
    assert found == {"a": (0, 0, "ValueError: no page"), "b": (1, 2, None), "c": (0, 0, None), None: (0, 0, None)}
    assert pages.unpivot(rows).count() == 3
    assert pages.run_counters(pages.outcomes(rows)).first().asDict() == {"pages": 4, "succeeded": 3, "failed": 1, "rows": 2, "exit_status": 1}
    assert pages.run_counters(pages.outcomes(rows.where("false"))).first()["rows"] == 0


def test_pages_are_parsed_once(spark):
    plan = pages.unpivot(_tables(spark, [("x", MODERN, DAY)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Exchange" not in plan


def test_scan(spark, tmp_path):
    (tmp_path / "visa-bulletin-for-march-2023.html").write_text(MODERN)
    (tmp_path / "about.html").write_text(MODERN)
    rows = pages.scan(spark, str(tmp_path))
    assert [(r["url"], r["publication_date"]) for r in rows.collect()] == [("visa-bulletin-for-march-2023.html", DAY)]
    assert pages.unpivot(pages.tables(rows)).where(F.col("visa_class") == "F1").count() == 2


def test_cells_of_both_layouts(spark):
    rows = _tables(spark, [("m", MODERN, DAY), ("l", LEGACY, datetime.date(2003, 3, 1))])
    cells = {(r["visa_class"], r["country"], r["cutoff_value"], str(r["cutoff_date"]), r["is_current"], r["is_unavailable"]) for r in pages.unpivot(rows).collect()}
    assert cells == {("F1", "all", "2014-12-01", "2014-12-01", False, False), ("F1", "china", "C", "2023-03-01", True, False), ("F2A", "all", "U", "None", False, True), ("F1", "all", "2001-04-01", "2001-04-01", False, False), ("F1", "india", "NA", "None", False, False)}
    heads = {(r["url"], r["title"], tuple(r["cells"])) for r in rows.where("row_ix = 0").collect()}
    assert heads == {("m", TITLE, ("Family- Sponsored", "All Chargeability Areas Except Those Listed", "CHINA-mainland born", "DOMINICAN REPUBLIC")), ("l", TITLE, ("Family", "All Chargeability Areas Except Those Listed", "INDIA"))}
