import zlib

import pytest
from oracle import compare
from pyspark.sql import functions as F
from small import docs, odd_rows

from cutline.llm import hilbert_sharding as h
from cutline.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("dims, bits", [(1, 4), (2, 1), (2, 4), (3, 3), (4, 2)])
def test_neighbours_on_the_curve_differ_by_one_step(spark, dims, bits):
    cells = spark.range(1 << dims * bits).select(*(F.shiftright("id", bits * i).bitwiseAND((1 << bits) - 1).alias(f"x{i}") for i in range(dims)))
    by = {r[-1]: r[:-1] for r in cells.select("*", h.curve_index([F.col(c) for c in cells.columns], bits)).collect()}
    assert sorted(by) == list(range(len(by)))
    assert all(sum(abs(a - b) for a, b in zip(by[i], by[i + 1], strict=True)) == 1 for i in range(len(by) - 1))


def _law(rows, shards):
    counts = [sum(r["shard"] == s for r in rows) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))


def test_odd_rows(spark):
    given = [*odd_rows(), *[(50, "again")] * 30, *[(None, None)] * 3]
    rows = h.hilbert_shards(docs(spark, given), shards=7, keep=["text", "fp", "part"]).collect()
    _law(rows, 7)
    by = lambda r: (r[0] or -1, r[1] or "", r[1] is None)
    assert sorted(((r["doc_id"], r["text"]) for r in rows), key=by) == sorted(given, key=by)
    for r in rows:
        data = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"], r["fp"]) == (len(data) + 8, zlib.crc32(data), "rows", None, "fp")


def test_fewer_rows_than_shards_and_none(spark):
    few = docs(spark, [(1, "a"), (2, None)])
    rows = h.hilbert_shards(few, shards=24).collect()
    _law(rows, 24)
    assert h.hilbert_shards(few.where("false")).count() == 0
    with pytest.raises(ValueError):
        h.hilbert_shards(few.withColumn("slot", F.lit(1)), keep=["slot"])
    with pytest.raises(ValueError):
        h.hilbert_shards(few, bits=30)


def test_a_hot_value_and_null_dimensions(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.when(F.col("id") % 2 > 0, F.col("id").cast("string"))).alias("source"), F.lit(None).cast("string").alias("lang"), (F.col("id") % 50).alias("n_chars"))
    _law(h.hilbert_shards(rows, shards=24).collect(), 24)


def test_shards_are_boxes(spark):
    """Over a grid of two dimensions a query of a quarter of each meets few of 64 shards; in order of ids it would meet a quarter of them."""
    rows = spark.range(1 << 14).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), (F.col("id") % 128).alias("a"), F.shiftright("id", 7).alias("b"))
    ranges = h.shard_ranges(h.hilbert_shards(rows, ["a", "b"], 64, bits=6), ["a", "b"])
    assert ranges.count() == 64 and ranges.agg(F.sum("rows")).first()[0] == 1 << 14
    assert len(h.shards_within(ranges, a=(0, 31), b=(96, 127))) == 4
    assert len(h.shards_within(ranges, a=(10, 10))) <= 12


def test_written_shards(spark, tmp_path):
    found = h.hilbert_shards(docs(spark, odd_rows()), shards=4, keep=["text"])
    h.write_shards(found, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.select(found.columns).collect())) == sorted(map(str, found.collect()))
    assert sorted(p.name for p in (tmp_path / "out").glob("shard=*")) == [f"shard={s}" for s in range(4)]


def test_no_python_on_the_way(spark):
    plan = h.hilbert_shards(docs(spark, odd_rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_same_as_sql(spark):
    compare(spark, QUERIES["op11_hilbert_sharding"], ORACLE_SQL["op11_hilbert_sharding"], "/root/testdata/sf0.001")
