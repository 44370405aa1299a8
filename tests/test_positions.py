import pytest
from pyspark.sql import functions as F

from cutline.operators.positions import positions


@pytest.mark.parametrize("n, hot", [(0, 0), (1, 1), (2000, 0), (2000, 1500)])
def test_places_of_a_sort(spark, n, hot):
    rows = spark.range(n, numPartitions=7).select("id", F.when(F.col("id") < hot, F.lit(5)).otherwise(F.when(F.col("id") % 9 > 0, F.col("id") * 7 % 31)).alias("part"), F.lit("x").alias("rank"))
    got = positions(rows, ["part", "id"])
    assert got.columns == ["id", "part", "rank", "position"]
    found = sorted((r["position"], r["id"]) for r in got.collect())
    want = sorted(((r["part"] is not None, r["part"] or 0), r["id"]) for r in rows.collect())
    assert found == [(k, i) for k, (_, i) in enumerate(want)]


def test_equal_rows_get_places_of_their_own(spark):
    rows = spark.range(900, numPartitions=6).select(F.lit(1).alias("v"))
    got = positions(rows, ["v"])
    assert sorted(r["position"] for r in got.collect()) == list(range(900))
    assert got.rdd.getNumPartitions() == 4 and max(got.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()) < 450


def test_sums_before(spark):
    rows = spark.range(300).select((F.col("id") * 13 % 300).alias("v"), (F.col("id") % 4).alias("w"))
    got = sorted((r["v"], r["w"], r["before"]) for r in positions(rows, ["v"], "before", weight="w").collect())
    total = 0
    for v, (_, w, before) in enumerate(got):
        assert got[v][0] == v and before == total
        total += w


def test_no_task_gets_all_rows(spark):
    plan = positions(spark.range(100), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") == 1 and "Window" in plan  # over the totals only
