import bisect
import datetime
import random

import pytest
from pyspark.sql import functions as F

from cutline.operators import ranks

SCHEMA = "g string, v double, value string, below string, total string, n string"


def _rows(spark, n, seed=1, distinct=15):
    r = random.Random(seed)
    data = [(r.choice(["a", "b", None]), None if r.random() < 0.1 else float(r.randrange(distinct)), "x", "y", "z", "w") for _ in range(n)]
    return data, spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.mark.parametrize("n, by", [(0, None), (1, None), (200, None), (200, ["g"])])
def test_percent_rank(spark, n, by):
    data, rows = _rows(spark, n)
    got = ranks.percent_rank(rows, "v", by).collect()
    want = []
    for g, v, *rest in data:
        own = [x[1] for x in data if (not by or x[0] == g) and x[1] is not None]
        less = None if v is None else sum(x < v for x in own)
        want.append((g, v, *rest, None if v is None else less + 1, None if v is None else less / (len(own) - 1) if len(own) > 1 else 0.0))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_percent_rank_of_one_hot_value(spark):
    rows = spark.range(4000).select(F.when(F.col("id") < 3000, F.lit(7)).otherwise(F.col("id")).alias("v"))
    got = ranks.percent_rank(rows, "v")
    assert got.where("v = 7").agg(F.count("*"), F.max("rank")).first()[:] == (3000, 1)
    assert got.where("v = 3999").first()["percent_rank"] == 1.0
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        ranks.percent_rank(rows.withColumn("rank", F.lit(1)), "v")


def test_equal_width(spark):
    data, rows = _rows(spark, 300)
    found = [tuple(r) for r in ranks.equal_width(rows, "v", 4).orderBy("bin").collect()]
    assert [r[:3] for r in found] == [(0, 0.0, 3.5), (1, 3.5, 7.0), (2, 7.0, 10.5), (3, 10.5, 14.0)]
    assert [r[3] for r in found] == [sum(x[1] is not None and (low <= x[1] < high or x[1] == high == 14.0) for x in data) for _, low, high, _ in found]
    one = spark.createDataFrame([(5.0,), (5.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert [tuple(r) for r in ranks.equal_width(one, "v").collect()] == [(0, 5.0, 5.0, 2)]
    assert ranks.equal_width(one.where("v is null"), "v").count() == 0
    gap = spark.createDataFrame([(0.0,), (10.0,)], "v double")
    assert [r["n"] for r in ranks.equal_width(gap, "v", 5).orderBy("bin").collect()] == [1, 0, 0, 0, 1]


def test_equal_depth(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    found = [tuple(r) for r in ranks.equal_depth(rows, "v", 8).orderBy("bin").collect()]
    assert found == [(i, 125 * i, 125 * i + 124, 125) for i in range(8)]
    hot = rows.union(spark.range(3000).select(F.lit(500).cast("long")))
    found = ranks.equal_depth(hot, "v", 8).orderBy("bin").collect()
    assert sum(r["n"] for r in found) == 4000 and sum(r["low"] <= 500 <= r["high"] for r in found) == 1
    data, grouped = _rows(spark, 200)
    assert ranks.equal_depth(grouped, "v", 3, ["g"]).agg(F.sum("n")).first()[0] == sum(x[1] is not None for x in data)
    assert ranks.equal_depth(rows.where("false"), "v").count() == 0


def test_yearly_trend_over_a_gap(spark):
    day = lambda y: datetime.date(y, 5, 1)
    rows = spark.createDataFrame([("a", 10.0, day(2001)), ("a", 30.0, day(2001)), ("a", 25.0, day(2002)), ("a", 1.0, day(2004)), (None, 0.0, day(2001)), (None, 4.0, day(2002)), ("a", None, day(2003))], "g string, v double, d date")
    found = {(r["g"], r["year"]): (r["n"], r["mean"], r["change"], r["change_percent"]) for r in ranks.yearly_trend(rows, "v", "d", ["g"]).collect()}
    assert found == {("a", 2001): (2, 20.0, None, None), ("a", 2002): (1, 25.0, 5.0, 25.0), ("a", 2004): (1, 1.0, None, None), (None, 2001): (1, 0.0, None, None), (None, 2002): (1, 4.0, 4.0, None)}


def test_values_at_the_cost_of_living(spark):
    data = [("a", "x", 100.0), ("a", "y", 90.0), ("a", "z", 80.0), ("a", None, 70.0), ("a", "free", 60.0), ("a", "x", None), ("b", "y", 90.0), (None, "y", 45.0), (None, "x", 90.0)]
    rows = spark.createDataFrame(data, "g string, place string, v double")
    costs = spark.createDataFrame([("x", 200.0), ("y", 90.0), ("y", 50.0), ("z", 50.0), ("free", 0.0), (None, 3.0), ("nowhere", 70.0)], "place string, cost double")
    found = sorted((tuple(r) for r in ranks.cost_adjusted(rows, costs, "place", "v", ["g"]).collect()), key=str)
    assert found == sorted([
        ("a", "x", 100.0, 50.0, 1.0, 0.0), ("a", "y", 90.0, 100.0, 0.75, 0.5), ("a", "z", 80.0, 160.0, 0.5, 1.0), ("a", None, 70.0, None, 0.25, None), ("a", "free", 60.0, None, 0.0, None),
        ("a", "x", None, None, None, None), ("b", "y", 90.0, 100.0, 0.0, 0.0), (None, "y", 45.0, 50.0, 0.0, 1.0), (None, "x", 90.0, 45.0, 1.0, 0.0),
    ], key=str)
    assert ranks.cost_adjusted(rows.where("false"), costs, "place", "v").count() == 0
    with pytest.raises(ValueError, match="adjusted"):
        ranks.cost_adjusted(rows.withColumn("adjusted", F.lit(1)), costs, "place", "v")


def test_hot_place_and_group_at_the_cost_of_living(spark):
    """A third of the rows have one value, place and group; ranks are those of a sorted list."""
    r = random.Random(6)
    data = [(i, "p0", 50.0) if i % 3 == 0 else (i, f"p{r.randrange(9)}", float(r.randrange(1000))) for i in range(3000)]
    costs = {f"p{i}": 60.0 + 10 * i for i in range(8)}
    rows = spark.createDataFrame(data, "id long, place string, v double").repartition(4)
    found = {x["id"]: x for x in ranks.cost_adjusted(rows, spark.createDataFrame(list(costs.items()), "place string, cost double"), "place", "v").collect()}
    adjusted = sorted(x["adjusted"] for x in found.values() if x["adjusted"] is not None)
    assert len(found) == 3000 and len(adjusted) == sum(p in costs for _, p, _ in data)
    for i, p, v in data:
        if p in costs:
            assert found[i]["adjusted"] == pytest.approx(v * 100 / costs[p], abs=0.006)
            assert found[i]["adjusted_rank"] == bisect.bisect_left(adjusted, found[i]["adjusted"]) / (len(adjusted) - 1)
        else:
            assert found[i]["adjusted"] is None and found[i]["adjusted_rank"] is None


def test_cost_adjusted_reads_the_rows_twice(spark):
    """Once to count their values and once to be ranked, for both ranks together."""
    seen = spark.sparkContext.accumulator(0)
    data = [("a" if i % 3 else None, f"p{i % 4}", float(i % 10)) for i in range(100)]
    made = spark.sparkContext.parallelize(data, 2).map(lambda x: (seen.add(1), x)[1])
    rows = spark.createDataFrame(made, "g string, place string, v double")
    costs = spark.createDataFrame([(f"p{i}", 80.0 + i) for i in range(3)], "place string, cost double")
    assert len(ranks.cost_adjusted(rows, costs, "place", "v", ["g"]).collect()) == 100 and seen.value <= 200
