import datetime
import random
import shutil
import statistics

from cutline.operators import stored_stats

BY = ["employer", "source"]
MONTHS = [datetime.date(2020, m, 1) for m in range(1, 7)]


def _rows(spark, n, seed, months=MONTHS, employers=("a", "b", None)):
    r = random.Random(seed)
    data = [(r.choice(employers), r.choice(["h", "p"]), r.choice(months), round(r.uniform(1, 1000), 2)) for _ in range(n)]
    return data, spark.createDataFrame(data, "employer string, source string, month date, wage double")


def _view(spark, path, **given):
    return {(r["employer"], r["source"]): r for r in stored_stats.view(spark, path, BY, **given).collect()}


def test_a_refresh_is_a_full_build(spark, tmp_path):
    data, rows = _rows(spark, 600, 1)
    path, whole = str(tmp_path / "state"), str(tmp_path / "whole")
    stored_stats.build(rows.where("month < '2020-05-01'"), path, BY, "wage", "month")
    for _ in range(2):  # doing it again changes nothing
        stored_stats.refresh(rows, path, MONTHS[4:], BY, "wage", "month")
    stored_stats.build(rows, whole, BY, "wage", "month")
    assert _view(spark, path) == _view(spark, whole)
    for (e, s), r in _view(spark, path, percentiles={"p50": 0.5, "p0": 0.0, "p100": 1.0}).items():
        own = [x[3] for x in data if x[:2] == (e, s)]
        assert (r["n"], r["low"], r["high"], r["exact"]) == (len(own), min(own), max(own), True) and (r["p0"], r["p100"]) == (min(own), max(own))
        assert abs(r["p50"] - statistics.median(own)) < 1e-9 and abs(r["mean"] - statistics.fmean(own)) < 1e-6


def test_rows_of_other_periods_are_not_read(spark, tmp_path):
    """The base table's other months are taken away before the refresh, which then neither misses nor loses them."""
    _, rows = _rows(spark, 200, 2)
    base, path = str(tmp_path / "base"), str(tmp_path / "state")
    rows.write.partitionBy("month").parquet(base)
    stored_stats.build(spark.read.parquet(base), path, BY, "wage", "month")
    before = _view(spark, path)
    table = spark.read.parquet(base)
    plan = table.where(table["month"].isin(MONTHS[-1:]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    for m in MONTHS[:-1]:
        for file in (tmp_path / "base" / f"month={m}").glob("*.parquet"):
            file.write_bytes(b"nothing to read")
    stored_stats.refresh(table, path, MONTHS[-1:], BY, "wage", "month")
    assert _view(spark, path) == before


def test_corrected_and_vanished_months(spark, tmp_path):
    _, rows = _rows(spark, 300, 3)
    path, want = str(tmp_path / "state"), str(tmp_path / "want")
    stored_stats.build(rows, path, BY, "wage", "month")
    left = rows.where("month <> '2020-02-01'").where("month <> '2020-03-01' or wage > 500")
    stored_stats.refresh(left, path, MONTHS[1:3], BY, "wage", "month")
    stored_stats.build(left, want, BY, "wage", "month")
    assert _view(spark, path) == _view(spark, want)
    stored_stats.refresh(left, path, [], BY, "wage", "month")
    assert _view(spark, path) == _view(spark, want)
    shutil.rmtree(want)
    stored_stats.build(rows.where("false"), want, BY, "wage", "month")


def test_large_groups_are_sketched(spark, tmp_path):
    data, rows = _rows(spark, 8000, 4, employers=("big",))
    path = str(tmp_path / "state")
    stored_stats.build(rows, path, BY, "wage", "month", exact=100)
    for (e, s), r in _view(spark, path, percentiles={"p50": 0.5, "p90": 0.9}).items():
        own = sorted(x[3] for x in data if x[:2] == (e, s))
        assert not r["exact"] and r["n"] == len(own)
        for name, p in (("p50", 0.5), ("p90", 0.9)):
            assert abs(sum(x <= r[name] for x in own) / len(own) - p) < 0.01
