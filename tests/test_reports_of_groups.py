import datetime

import pytest

from cutline.operators import rollups, scenarios
from cutline.operators.series import SERIES
from cutline.sources import delimited

D = datetime.date


def test_rollup_with_nulls_zeros_and_ties(spark):
    rows = spark.createDataFrame([("a", "x", 10.0), ("a", "y", 30.0), ("a", None, 10.0), (None, "x", 50.0), ("b", "x", 0.0), ("b", "y", None)], "g string, h string, v double")
    found = {(r["g"], r["h"], r["depth"]): (r["n"], r["total"], r["share"], r["place"]) for r in rollups.rollup_shares(rows, ["g", "h"], "v").collect()}
    assert found[None, None, 0] == (6, 100.0, 100.0, 1)
    assert found["a", None, 1] == (3, 50.0, 50.0, 2) and found[None, None, 1] == (1, 50.0, 50.0, 1) and found["b", None, 1] == (2, 0.0, 0.0, 3)
    assert found["a", "y", 2] == (1, 30.0, 60.0, 1) and found["a", None, 2] == (1, 10.0, 20.0, 2) and found["a", "x", 2] == (1, 10.0, 20.0, 3)
    assert found["b", "x", 2] == (1, 0.0, None, 1) and found["b", "y", 2] == (1, 0.0, None, 2) and found[None, "x", 2] == (1, 50.0, 100.0, 1)
    assert len(found) == 1 + 3 + 6
    top = rollups.rollup_shares(rows, ["g", "h"], "v", top=1)
    assert {(r["g"], r["h"], r["depth"]) for r in top.collect()} == {k for k, x in found.items() if x[3] == 1}
    top = rollups.rollup_shares(rows, ["g", "h"], "v", top=1)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()  # what can't be among the first goes before the shuffle
    assert rollups.rollup_shares(rows.where("false"), ["g", "h"], "v").count() == 0


def test_scenarios(spark):
    schema = ", ".join(f"{c} string" for c in SERIES) + ", publication_date date, cutoff_date date"
    point = lambda s, p, c: ("e", "all", "final", s, p, c)
    rows = [point("x", D(2011, 1, 1), D(2000, 1, 1)), point("x", D(2014, 1, 1), D(2002, 1, 1)), point("x", D(2015, 1, 1), D(2002, 2, 1)), point("x", D(2016, 1, 1), D(2002, 4, 1)), point("x", D(2016, 2, 1), None), point("x", D(2021, 1, 1), D(2003, 1, 1)), point("back", D(2011, 1, 1), D(2005, 1, 1)), point("back", D(2012, 1, 1), D(2004, 1, 1)), point("none", D(2012, 1, 1), None), point("there", D(2012, 1, 1), D(2015, 1, 1))]
    points = spark.createDataFrame(rows, schema)
    rates = {(r["visa_class_label"], r["period"]): (r["n"], r["months_per_year"]) for r in scenarios.period_rates(points).collect()}
    best, latest = 731 * 12.0 / 1096, 59 * 12.0 / 365
    assert rates == {("x", 2010): (2, best), ("x", 2015): (2, latest), ("x", 2020): (1, None), ("back", 2010): (2, -366 * 12.0 / 365), ("there", 2010): (1, None)}
    found = {(r["visa_class_label"], r["scenario"]): (r["months_per_year"], r["wait_years"]) for r in scenarios.wait_scenarios(points, "2010-01-01").collect()}
    gap = (D(2010, 1, 1) - D(2003, 1, 1)).days / 30.4375
    assert found["x", "optimistic"] == (best, gap / best) and found["x", "current"] == (latest, gap / latest) and found["x", "pessimistic"][1] == gap / (latest * 0.5)
    assert found["back", "current"][1] is None and found["there", "current"] == (None, 0.0) and ("none", "current") not in found


def test_delimited(spark, tmp_path):
    schema = "id long, name string, price double, day date"
    for year, lines in (("2020", ["id,name,price,day", '1,"a, b",2.5,2020-01-01', "2,c,x,2020-01-01", "3,d", "4,e,1,2020-02-30", "5,,3,", "", "6,f,1,2020-01-01,more", "x,g,1,"]), ("2021", ["id,name,price,day", "7,h,,2021-01-01"])):
        (tmp_path / f"year={year}").mkdir()
        (tmp_path / f"year={year}" / "rows.csv").write_text("\n".join(lines) + "\n")
    rows = delimited.read(spark, str(tmp_path), schema, required=["name"])
    assert sorted(map(tuple, delimited.accepted(rows).collect())) == [(1, "a, b", 2.5, D(2020, 1, 1), 2020), (7, "h", None, D(2021, 1, 1), 2021)]
    bad = {(r["reason"], r["line"]) for r in delimited.rejected(rows).collect()}
    assert bad == {("malformed", x) for x in ("2,c,x,2020-01-01", "3,d", "4,e,1,2020-02-30", "6,f,1,2020-01-01,more", "x,g,1,")} | {("missing name", "5,,3,")}
    # of two columns as of all: what is not asked for still counts
    assert sorted(r["id"] for r in delimited.accepted(rows).select("id", "year").collect()) == [1, 7]
    (tmp_path / "year=2020" / "rows.csv").write_bytes(b"\xff\xfe")
    (tmp_path / "year=2020" / ".rows.csv.crc").unlink(missing_ok=True)
    one = rows.where("year = 2021")
    assert [r["id"] for r in one.collect()] == [7]
    assert "PartitionFilters: [isnotnull(year" in one._jdf.queryExecution().executedPlan().toString()


def test_delimited_rejects_everything_it_must(spark, tmp_path):
    (tmp_path / "a.csv").write_text("not,a,row\n")
    rows = delimited.read(spark, str(tmp_path), "id long, v long", header=False)
    assert delimited.accepted(rows).count() == 0 and delimited.rejected(rows).count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        delimited.read(spark, str(tmp_path / "nothing"), "id long")
