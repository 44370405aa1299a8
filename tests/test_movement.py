import datetime
import random

import pytest

from cutline.operators.series import SERIES
from cutline.streaming import movement

SCHEMA = ", ".join(f"{c} string" for c in SERIES) + ", publication_date date, cutoff_date date"
SUBMISSION = "2010-01-01"


def _points(months, seed=1, series=("x", "y")):
    r = random.Random(seed)
    cut = lambda m: None if r.random() < 0.15 else datetime.date(2000, 1, 1) + datetime.timedelta(40 * m + r.randrange(-30, 90))
    return [("e", "all", "final", s, datetime.date(2005 + m // 12, m % 12 + 1, 1), cut(m)) for s in series for m in range(months)]


def _run(spark, tmp_path, batches):
    folder, path, late = (str(tmp_path / x) for x in ("in", "table", "late"))
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        movement.keep_current(spark.readStream.schema(SCHEMA).parquet(folder), path, str(tmp_path / "checkpoint"), late)
    return sorted(map(tuple, movement.read(spark, path, SUBMISSION).select(*_columns()).collect()), key=str), late


def _columns():
    return [*SERIES, "publication_date", "cutoff_date", "moved_days", "trend_days", "gap_days", "wait_months"]


def _batch(spark, rows):
    return sorted(map(tuple, movement.movement(spark.createDataFrame(rows, SCHEMA), SUBMISSION).select(*_columns()).collect()), key=str)


def test_movement(spark):
    d = datetime.date
    rows = [("e", "all", "final", "x", d(2005, m, 1), c) for m, c in ((1, d(2000, 1, 1)), (2, d(2000, 1, 11)), (3, None), (4, d(2000, 3, 1)), (5, d(2000, 3, 31)), (6, d(2000, 3, 31)), (7, d(2011, 1, 1)))]
    found = {r["publication_date"].month: (r["moved_days"], r["trend_days"], r["gap_days"], r["wait_months"]) for r in movement.movement(spark.createDataFrame(rows, SCHEMA), SUBMISSION).collect()}
    gap = (d(2010, 1, 1) - d(2000, 3, 31)).days
    assert found[1] == (None, None, 3653, None) and found[2] == (10, 10.0, 3643, 364.3)
    assert found[5] == (30, 30.0, gap, gap / 30) and found[6] == (0, 15.0, gap, gap / 15) and found[7][2:] == (0, 0.0)


@pytest.mark.parametrize("seed", [1, 2])
def test_the_stream_gives_what_the_batch_gives(spark, tmp_path, seed):
    """Months come in four parts; some late by up to three months, some corrected, some twice."""
    rows = _points(20, seed)
    by = {}
    for x in rows:
        by.setdefault((x[4].year - 2005) * 12 + x[4].month - 1, []).append(x)
    parts = [[0, 1, 2, 4, 5, 6], [7, 3, 8, 9, 9], [11, 12, 13], [14, 15, 10, 17], [16, 19, 18]]
    batches = [[x for m in part for x in by[m]] for part in parts]
    corrected = [(*x[:5], datetime.date(2003, 3, 3)) for x in by[17]]
    got, late = _run(spark, tmp_path, [*batches, corrected])
    assert got == _batch(spark, [x for x in rows if x not in by[17]] + corrected)
    assert spark.read.parquet(late).count() == 0


def test_a_month_that_comes_too_late_is_told_and_changes_nothing(spark, tmp_path):
    rows = _points(20, 3, series=("x",))
    missing = [x for x in rows if x[4] == datetime.date(2005, 3, 1)]
    rest = [x for x in rows if x not in missing]
    got, late = _run(spark, tmp_path, [rest[:12], rest[12:], missing])
    assert got == _batch(spark, rest)
    assert [r["publication_date"] for r in spark.read.parquet(late).collect()] == [datetime.date(2005, 3, 1)]


def test_a_batch_that_is_run_again(spark, tmp_path):
    rows = _points(10)
    got, _ = _run(spark, tmp_path, [rows, rows])
    assert got == _batch(spark, rows)
