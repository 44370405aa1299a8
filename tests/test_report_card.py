import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cutline.operators import report_card
from cutline.shared import stored

SCHEMA = "employer string, source string, role string, year int, certified boolean, wage double, days int, location string"


def _record(e, source="PERM", role="r", year=2000, certified=True, wage=100.0, days=100, location="x"):
    return (e, source, role, year, certified, wage, days, location)


def _rows(spark):
    rows = [_record("big", year=y, wage=150.0) for y in (1996, 1997, 1998, 1999) for _ in range(2)] + [_record("big", wage=150.0, days=d) for d in (170, 180, 400)] + [_record("big", "H-1B", year=1990)] * 20
    rows += [_record("mid", certified=False, wage=100.0), _record("mid", year=1999, certified=True, wage=None, days=None), _record("mid", "H-1B", year=1998, role=None, wage=0.0)]
    rows += [_record(None, "other", None, None, None, None, None, None)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_cards(spark):
    _, rows = _rows(spark)
    found = {r["employer"]: r for r in report_card.cards(rows, 2000).collect()}
    big, mid, none = found["big"], found["mid"], found[None]
    assert (big["n"], big["volume"], big["approval"], big["years"], big["conversion"]) == (31, 3, 100.0, 5, 55.0)
    assert (big["processing"], big["processing_grade"]) == (100.0, "A") and (big["volume_grade"], big["approval_grade"], big["conversion_grade"]) == ("F", "A", "A")
    assert (big["consistency_grade"], big["salary"], big["salary_grade"]) == ("A", 1.0, "A") and big["score"] == (0 * 25 + 4 * 25 + 4 * 30 + 4 * 20) / 100 and big["overall"] == "B"
    # the role of nulls is one of its own, and a usual wage of 0 tells nothing
    assert (mid["n"], mid["volume"], mid["years"], mid["consistency_grade"], mid["salary"]) == (3, 1, 3, "D", 0.0)
    assert (none["n"], none["volume"], none["salary"], none["salary_grade"], none["conversion"], none["processing_grade"], none["consistency_grade"]) == (1, 0, None, None, None, None, "F")
    assert none["score"] == 0.0 and none["overall"] == "F"
    assert report_card.cards(rows.where("false"), 2000).count() == 0
    assert [(r["place"], r["employer"]) for r in report_card.ranking(report_card.cards(rows, 2000), least=1, top=2).orderBy("place").collect()] == [(1, "big"), (2, "mid")]
    assert report_card.compare(report_card.cards(rows, 2000), ["mid", "no"]).count() == 1
    with pytest.raises(ValueError):
        report_card.compare(rows, list("abcdef"))


def test_ranges_are_half_open(spark):
    rows = spark.createDataFrame([(x,) for x in (None, 4.999, 5.0, 19.9, 20.0, 100.0, 499.0, 500.0)], "v double")
    assert [r[0] for r in rows.select(report_card.grade(F.col("v"), report_card.VOLUME)).collect()] == [None, "F", "D", "D", "C", "B", "B", "A"]
    days = spark.createDataFrame([(x,) for x in (None, 0, 179, 180, 269, 270, 364, 365, 540, 541)], "v int")
    assert [r[0] for r in days.select(report_card._under(F.col("v"), report_card.PROCESSING)).collect()] == [None, "A", "A", "B", "B", "C", "C", "D", "D", "F"]
    units = spark.createDataFrame([("Hour",), (" year ",), ("MONTH",), ("day",), (None,)], "u string")
    assert [r[0] for r in units.select(report_card.annual(F.lit(2.0), F.col("u"))).collect()] == [4160.0, 2.0, 24.0, None, None]


def test_stats(spark):
    data = [(g, float(v)) for g, n in (("a", 5), ("b", 6), (None, 1)) for v in range(n)] + [("a", 3.0)] * 7 + [("a", None), ("c", None), ("b", float("nan"))]
    rows = spark.createDataFrame(data, "g string, v double")
    found = {r["g"]: tuple(r)[1:] for r in report_card.stats(rows, "v", ["g"]).collect()}
    for g in ("a", "b", None):
        own = [v for k, v in data if k == g and v is not None and v == v]
        assert found[g] == (len(own), statistics.fmean(own), min(own), max(own), statistics.median(own))
    assert set(found) == {"a", "b", None}
    own = [v for _, v in data if v is not None and v == v]
    assert report_card.stats(rows, "v").first()["median"] == statistics.median(own)
    assert tuple(report_card.stats(rows.where("false"), "v").first()) == (0, None, None, None, None)


def test_profiles(spark):
    rows, table = _rows(spark)
    found = {(r["employer"], r["kind"], r["value"]): (r["n"], r["share"], r["place"]) for r in report_card.profile(table).collect()}
    assert found["big", "role", "r"] == (31, 100.0, 1) and found["big", "year", "1990"][::2] == (20, 1) and found[None, "location", None] == (1, 100.0, 1)
    assert found["mid", "role", None] == (1, 100 / 3, 2) and sum(n for (e, kind, _), (n, _, _) in found.items() if kind == "year") == len(rows)
    assert {k[:2] for k in found if k[1] == "role"} == {("big", "role"), ("mid", "role"), (None, "role")}
    assert report_card.profile(table, top=1).where("employer = 'mid' and kind = 'role'").count() == 1


def test_receipt_ranges(spark):
    cases = spark.createDataFrame([(0, "F", 10), (99, "O", None), (100, "F", 30), (150, "X", 50), (None, "F", 1)], "receipt long, status string, days int")
    assert sorted(map(tuple, report_card.receipt_ranges(cases, 100, ["F", "O"]).collect())) == [(0, 0, 99, 2, 0.5, 0.5, 10.0), (1, 100, 150, 2, 0.5, 0.0, 40.0)]


def test_profiles_count_by_employer(spark, monkeypatch):
    """Records are dealt by employer before they are counted; an employer of most records is counted right."""
    rows = spark.range(3000).selectExpr("if(id % 3 < 2, 0, id % 50) AS employer", "concat('r', id % 7) AS role", "cast(2000 + id % 5 AS int) AS year", "id % 4 AS location", "cast(id AS double) AS wage")
    plans = []
    monkeypatch.setattr(report_card, "stored", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df))
    found = {(r["employer"], r["kind"], r["value"]): r["n"] for r in report_card.profile(rows, top=7).collect()}
    assert any("RebalancePartitions [employer" in p for p in plans)
    want = Counter()
    for r in rows.collect():
        want.update((r["employer"], kind, str(r[kind])) for kind in ("role", "year", "location"))
    assert found == want
