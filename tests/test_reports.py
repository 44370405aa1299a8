import pytest

from cutline.operators import chart, reports
from cutline.operators.store import FACT
from cutline.plans import registry


def test_no_facts(spark):
    facts = spark.createDataFrame([], "publication_date date, visa_category string, visa_class string, action_type string, country string, cutoff_value string, cutoff_date date, is_current boolean, is_unavailable boolean")
    assert facts.columns == FACT
    lines = [r["line"] for r in reports.status_lines(facts, facts.select("publication_date")).orderBy("place").collect()]
    assert lines == ["Current (C):            0 records (0.0%)", "Unavailable (U):        0 records (0.0%)", "With dates:             0 records (0.0%)"]
    for search in ("", "f1"):
        with pytest.raises(ValueError):
            reports.point_query(facts, facts, search)
    assert reports.point_heading(facts, facts).count() == 0
    given = spark.createDataFrame([("",), ("f1",), (None,), (" f1  el salvador ",), ("eb el_salvador's 2nd",)], "s string")
    assert [r["heading"] for r in reports.headings(given, "s").collect()] == [None, None, None, "F1 - El Salvador (Last 20 bulletins)", "EB - El_Salvador'S 2Nd (Last 20 bulletins)"]
    assert {r["n"] for r in reports.sitemap_urls(facts, facts).collect()} == {None, 0}


def test_charts_of_nothing(spark):
    points = registry._points(spark, "/root/testdata/sf0.001").where("false")
    made = registry.series.projected_series(points, "2000-01-01")
    assert chart.documents(made, "2000-01-01").count() == 0 and chart.cards(made).count() == 0
    asked = spark.createDataFrame([(1, None, "", "filing")], "id int, visa_category string, country string, action_type string")
    assert chart.requests(asked, made).first().asDict() == {"id": 1, "visa_category": "family_sponsored", "country": "all", "action_type": "filing", "classes": 0, "has_data": False}
