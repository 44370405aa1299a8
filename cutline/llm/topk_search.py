"""Exact top-k search by inner product: sorted lists that are only read in order (no random access).

Every component of the vectors has a list, sorted by value. A query reads a list from the top where
its own component is positive and from the bottom where it is negative, so that what it reads adds
less and less. Having read all lists down to some depth, it knows of each vector the sum over what
was read; what was not read adds at most what the list shows at that depth (upper bound) and at
least what the list's far end shows (lower bound). A vector whose upper bound is below the k-th
lower bound is an outsider. When so few are left that reading on costs more than it rules out, the
remaining scores are resolved.

Vectors are dealt into blocks; each block of queries meets each block of vectors in one task, whose
lists are sorted once for all of its queries. A block gives at most k rows per query, and those meet
in a grouped top-k. Bounds of many queries against a block are matrix products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Vectors, and queries, of a block.
BLOCK, QUERY_BLOCK = 8_192, 4_096
#: Shares of a list that are read before the bounds are looked at again.
DEPTHS = (0.125, 0.25, 0.5, 0.75)
#: Vectors left per query (times k) at which their scores are resolved.
LEFT = 20
#: Queries whose bounds are held at once.
AT_ONCE = 128


def _type(a: np.ndarray, b: np.ndarray) -> type:
    """A number type in which every inner product is exact."""
    bound = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    return np.float32 if bound < 1 << 23 else np.float64 if bound < 1 << 52 else object


def search_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, vector_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the query, row of the vector, score) of each query's k best; ties to the smaller id; a vector of the query's own id takes no part."""
    n = len(vectors)
    kind = _type(queries, vectors)
    if kind is object:  # integers beyond 2**52: bounds in floating point would not be exact
        up = down = np.zeros((0, 0))
    else:
        lists = np.sort(vectors, axis=0).astype(kind)  # of component d: lists[:, d]
        x = vectors.astype(kind)
        up, down = np.maximum(queries, 0).astype(kind), np.minimum(queries, 0).astype(kind)
    rows, found, scores = [], [], []

    def resolve(q: int, left: np.ndarray) -> None:
        exact = vectors[left].astype(object) @ queries[q].astype(object) if kind is object else vectors[left] @ queries[q]
        order = np.lexsort((vector_ids[left], -exact.astype(np.int64)))[:k]
        rows.append(np.full(len(order), q))
        found.append(left[order])
        scores.append(exact[order].astype(np.int64))

    if kind is object:
        for q in range(len(queries)):
            resolve(q, np.flatnonzero(vector_ids != query_ids[q]))
    position = np.argsort(vector_ids)
    by_id = vector_ids[position]
    open_ = np.arange(len(queries)) if kind is not object else np.zeros(0, int)
    for depth in (*DEPTHS, 1.0):
        if not len(open_):
            break
        at = min(n, max(1, round(depth * n)))
        high, low = lists[n - at], lists[at - 1]  # what the lists show, read from the top and from the bottom
        most, least = np.maximum(x, high), np.where(x >= high, x, lists[0])
        most_down, least_down = np.minimum(x, low), np.where(x <= low, x, lists[-1])
        still = []
        for part in np.split(open_, range(AT_ONCE, len(open_), AT_ONCE)):
            upper = up[part] @ most.T + down[part] @ most_down.T
            lower = up[part] @ least.T + down[part] @ least_down.T
            low_own, high_own = (np.searchsorted(by_id, query_ids[part], side) for side in ("left", "right"))
            for i in np.flatnonzero(high_own > low_own).tolist():
                own = position[low_own[i] : high_own[i]]
                upper[i, own] = lower[i, own] = -np.inf
            bar = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(part), -np.inf, kind)
            inside = upper >= bar[:, None]
            for i, count in enumerate(inside.sum(axis=1).tolist()):
                if at == n or count <= LEFT * k:
                    left = np.flatnonzero(inside[i])
                    resolve(int(part[i]), left[vector_ids[left] != query_ids[part[i]]])
                else:
                    still.append(int(part[i]))
        open_ = np.array(still, int)
    empty = np.zeros(0, np.int64)
    return (np.concatenate(x) if x else empty for x in (rows, found, scores))


def _quantised(vectors: DataFrame, vec_id: str, embedding: str, scale: float, every_row: bool) -> DataFrame:
    """(vec_id, v, dim): integer vectors, of every row or one per id."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    sound = F.col(embedding).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.col(vec_id).isNotNull()
    ints = vectors.where(sound).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))
    kept = ints if every_row else ints.groupBy("vec_id").agg(F.min("v").alias("v"))
    return kept.withColumn("dim", F.size("v"))


def top_k(vectors: DataFrame, queries: DataFrame | None = None, k: int = 5, scale: float = 256.0, vec_id: str = "vec_id", embedding: str = "embedding", every_row: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, or all if fewer.

    Components x become floor(scale * x). A query's own id is not among its candidates; ties go to the
    smaller id. Null ids and vectors that are null or hold null or non-finite components take no part;
    vectors of different lengths don't meet; of rows that repeat an id, the vector that sorts first
    counts, or with every_row all do: each is a candidate of its own, and queries of one id share their k
    ranks. Queries without candidates and empty tables give no rows; other columns are not read.
    """
    candidates = cut(_quantised(vectors, vec_id, embedding, scale, every_row))
    asked = cut(_quantised(queries, vec_id, embedding, scale, every_row)) if queries is not None else candidates
    blocks = max(1, -(-candidates.count() // BLOCK))
    query_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    deal = lambda df, n, name: df.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
    left = deal(candidates, blocks, "block").withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = deal(asked, query_blocks, "query_block").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        shape = lambda t: (t.column("vec_id").to_numpy(), t.column("v").combine_chunks().flatten().to_numpy().astype(np.int64).reshape(len(t), -1) if len(t) else np.zeros((0, 0), np.int64))
        (ids, x), (query_ids, q) = shape(a), shape(b)
        if not len(ids) or not len(query_ids) or not x.shape[1]:
            rows = found = scores = np.zeros(0, np.int64)
            if len(ids) and len(query_ids):  # vectors without components: every score is 0
                pairs = [(i, j) for i in range(len(query_ids)) for j in [c for c in np.argsort(ids).tolist() if ids[c] != query_ids[i]][:k]]
                rows, found = (np.array([p[s] for p in pairs], np.int64) for s in (0, 1))
                scores = np.zeros(len(pairs), np.int64)
        else:
            rows, found, scores = search_block(q, query_ids, x, ids, k)
        return pa.table({"query_id": pa.array(query_ids[rows] if len(rows) else [], pa.int64()), "vec_id": pa.array(ids[found] if len(found) else [], pa.int64()), "score": pa.array(scores, pa.int64())})

    keys = ["dim", "block", "query_block"]
    met = left.select(*keys, "vec_id", "v").groupBy(*keys).cogroup(right.select(*keys, "vec_id", "v").groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
