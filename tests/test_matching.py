import datetime
import random

import pytest
from pyspark.sql import functions as F

from cutline.operators import matching

NAMES = {"key": "k", "value": "v", "date": "d", "id": "i"}
SCHEMA = "k string, v double, d date, i long, l_key string, band string, n string"


def _later(d, months):
    m = d.year * 12 + d.month - 1 + months
    last = (datetime.date(m // 12 + (m % 12 == 11), (m + 1) % 12 + 1, 1) - datetime.timedelta(1)).day
    return datetime.date(m // 12, m % 12 + 1, min(d.day, last))


def _brute(left, right, share, months):
    out = []
    for k, v, d, i, *_ in left:
        found = {}
        for rk, rv, rd, ri, *_ in right:
            if None not in (k, v, d, rk, rv, rd) and k == rk and v > 0 and rv > 0 and v * (1 - share) <= rv <= v * (1 + share) and _later(d, months[0]) <= rd <= _later(d, months[1]):
                found[rv, rd] = min(ri, found.get((rv, rd), ri))
        best = min(((abs(rv - v), rd, ri, rv) for (rv, rd), ri in found.items()), default=(None,) * 4)
        out.append((k, v, d, i, best[2], best[3], best[1], len(found)))
    return sorted(out, key=str)


def _rows(n, seed, keys=4):
    r = random.Random(seed)
    day = lambda: datetime.date(2000, 1, 1) + datetime.timedelta(r.randrange(2500))
    return [(r.choice("abcd"[:keys]), round(10 ** r.uniform(1, 2), 1), day(), i, "x", "y", "z") for i in range(n)]


@pytest.mark.parametrize("share, months, heavy", [(0.1, (6, 36), 10_000), (0.3, (0, 5), 2), (0.02, (-3, 3), 1), (0.1, (6, 6), 3)])
def test_same_as_all_pairs(spark, share, months, heavy):
    left, right = _rows(150, 1), _rows(200, 2)
    odd = [(None, 10.0, datetime.date(2001, 1, 31), 900, "", "", ""), ("a", None, datetime.date(2001, 1, 31), 901, "", "", ""), ("a", 0.0, datetime.date(2001, 1, 31), 902, "", "", ""), ("a", -5.0, datetime.date(2001, 1, 31), 903, "", "", ""), ("a", 20.0, None, 904, "", "", ""), ("a", 20.0, datetime.date(2001, 8, 31), 905, "", "", ""), ("a", 18.0, datetime.date(2002, 2, 28), 906, "", "", ""), ("a", 22.0, datetime.date(2004, 8, 31), 907, "", "", "")]
    left, right = left + odd, right + odd + odd[5:] + right[:20]
    got = matching.best_matches(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), NAMES, share, months, heavy)
    want = _brute(left, right, share, months)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert any(r[-1] for r in want)


def test_bounds_are_included_at_the_end_of_a_month(spark):
    left = spark.createDataFrame([("a", 20.0, datetime.date(2001, 8, 31), 1, "", "", "")], SCHEMA)
    right = spark.createDataFrame([("a", 20.0 * 0.9, datetime.date(2002, 2, 28), 2, "", "", ""), ("a", 20.0 * 1.1, datetime.date(2004, 8, 31), 3, "", "", ""), ("a", 20.0, datetime.date(2004, 9, 1), 4, "", "", "")], SCHEMA)
    assert matching.best_matches(left, right, NAMES).first()["n_matches"] == 2


def test_copies_of_a_hot_key_are_not_multiplied(spark):
    """20,000 equal filings and 20,000 equal answers: one pair, not 400 million."""
    rows = lambda d: spark.range(20_000).select(F.lit("hot").alias("k"), F.lit(50.0).alias("v"), F.lit(d).cast("date").alias("d"), F.col("id").alias("i"))
    assert matching.band_pairs(rows("2001-01-01"), rows("2002-01-01"), NAMES).count() == 1
    found = matching.best_matches(rows("2001-01-01"), rows("2002-01-01"), NAMES)
    assert found.where("match_id = 0 and n_matches = 1").count() == 20_000


def test_cells_and_no_product(spark):
    rows = spark.createDataFrame(_rows(50, 3), SCHEMA)
    plan = matching.best_matches(rows, rows, NAMES)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert matching.best_matches(rows.where("false"), rows, NAMES).count() == 0
    assert matching.best_matches(rows, rows.where("false"), NAMES).where("match_id is null and n_matches = 0").count() == 50
    with pytest.raises(ValueError):
        matching.band_pairs(rows, rows, NAMES, share=1.0)
