import math
import random

import numpy as np
import pytest
from oracle import compare

from cutline.llm import queries, topk_search


def brute(rows, asked, k, scale=256):
    sound = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(scale * x) for x in v]
            sound[i] = min(q, sound.get(i, q))
    out = set()
    for q in {i for i, _ in asked} & set(sound):
        best = sorted((-sum(a * b for a, b in zip(sound[q], v, strict=True)), i) for i, v in sound.items() if i != q and len(v) == len(sound[q]))[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("scale", [256.0, 2.0, 1e8])
def test_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(topk_search, "BLOCK", 30)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 9)
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(200)] + [(300 + i, [1.0] * 6) for i in range(9)]
    rows += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, [1.0] * 6), (5, [9.0] * 6), (500, [1.0, 2.0]), (501, [3.0, 1.0])]
    table = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, embedding array<double>, block int, score int")
    asked = [x for x in rows if x[0] is not None and x[0] % 5 == 0]
    got = topk_search.top_k(table, table.where("vec_id % 5 = 0"), k=4, scale=scale).collect()
    assert {(x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in got} == brute(rows, asked, 4, scale)


def test_fewer_than_k_and_empty(spark):
    table = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk_search.top_k(table, k=5).collect())) == [(1, 1, 2, 131072), (2, 1, 1, 131072)]
    assert topk_search.top_k(table.limit(0), k=5).count() == 0


def test_bounds_stop_early():
    r = np.random.default_rng(1)
    x = r.integers(-256, 256, (3000, 8))
    rows, found, scores = topk_search.search_block(x[:50], np.arange(50), x, np.arange(3000), 3)
    every = x[:50] @ x.T
    every[np.arange(50), np.arange(50)] = -(10**9)
    for q in range(50):
        order = np.lexsort((np.arange(3000), -every[q]))[:3]
        assert found[rows == q].tolist() == order.tolist() and scores[rows == q].tolist() == every[q][order].tolist()


def test_same_as_sql(spark):
    compare(spark, queries.QUERIES["op1_topk_search"], queries.ORACLE_SQL["op1_topk_search"], "/root/testdata/sf0.001")


def test_rows_that_repeat_an_id_are_candidates(spark, tmp_path, monkeypatch):
    """As in the SQL of the query: every row but those of the query's own id."""
    monkeypatch.setattr(topk_search, "BLOCK", 30)
    r = random.Random(3)
    rows = [(i % 70, [r.gauss(0, 1) for _ in range(4)]) for i in range(160)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    q = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    want = []
    for query in (0, 50):
        scores = sorted((-sum(a * b for a, b in zip(x, v, strict=True)), i) for j, x in q if j == query for i, v in q if i != query)[:5]
        want += [(query, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)]
    got = queries.op1_topk_search(spark, str(tmp_path)).collect()
    assert sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in got) == sorted(want)
