import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from oracle import compare
from small import docs, odd_rows

from cutline.llm import exact_dedup, queries


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out, kept = [], set()
    for (i, _), t in zip(rows, norm, strict=True):
        ids = [d for (d, _), x in zip(rows, norm, strict=True) if x == t]
        keep = min((d for d in ids if d is not None), default=None)
        first = i == keep and t not in kept
        if first:
            kept.add(t)
        out.append((i, keep, len(ids), first, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows):
    assert sorted((tuple(x) for x in exact_dedup.exact_duplicates(docs(spark, rows)).collect()), key=str) == brute(rows)


def test_odd_rows(spark):
    check(spark, odd_rows())


def test_large_groups_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_GROUP", 3)
    check(spark, [(i, "same  text") for i in range(40)] + [(i, "other\ttext") for i in range(40, 60)] + odd_rows())


def test_too_many_groups_to_broadcast(spark):
    """Texts of repeated fingerprints are found by a filter and a shuffle."""
    rows = [(i, f"text {i // 2}") for i in range(0, 400, 3)] + [(i, f"text  {i // 3}") for i in range(500, 600)] + odd_rows()
    got = exact_dedup.exact_duplicates(docs(spark, rows), direct=0)
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(rows)
    assert exact_dedup.exact_duplicates(docs(spark, [(1, "a"), (2, "b")]), direct=0).count() == 2
    assert exact_dedup.exact_duplicates(docs(spark, []), direct=0).count() == 0


@pytest.mark.parametrize("most", [1 << 30, 1 << 16])
def test_filter_passes_all_that_was_put_in_and_little_else(spark, most):
    r = np.random.default_rng(1)
    fp, size = r.integers(0, 1 << 62, 20_000), r.integers(0, 1000, 20_000)
    groups = spark.createDataFrame(pa.table({"fp": fp[:5000], "size": size[:5000]}))
    marks = exact_dedup.bloom_filter(groups, 5000, most)
    passed = exact_dedup._marked(marks, fp, size)
    assert passed[:5000].all() and passed[5000:].mean() < 0.04
    assert len(marks) * 8 == min(most, 1 << 17)


def test_empty(spark):
    assert exact_dedup.exact_duplicates(docs(spark, [])).count() == 0


def test_hashes_combine():
    r = random.Random(1)
    for n, m in ((0, 0), (2, 4), (2, 3), (200_000, 100_001), (65_536, 65_536), (131_072, 7)):
        a, b = r.randbytes(n), r.randbytes(m)
        assert exact_dedup.combine(exact_dedup.polynomial(a), exact_dedup.polynomial(b), (m + 1) // 2) == exact_dedup.polynomial(a + b)


def test_huge_texts_are_hashed_piece_by_piece(spark):
    long = " ".join(f"w{i * i}" for i in range(40_000))  # some 350 KB
    texts = [long, long.replace(" ", " \n"), long + "x", "y" + long, long[:-1], long, " " * 300_000, " ", "ab", None]
    rows = [(20 - i, t) for i, t in enumerate(texts)] + [(None, long), (20, long)]
    huge = 200_000
    found = exact_dedup.exact_duplicates(docs(spark, rows), huge=huge)
    assert sorted((tuple(x) for x in found.collect()), key=str) == brute(rows)
    found = exact_dedup.huge_fingerprints(docs(spark, [r for r in rows if len(r[1] or "") > huge]).select("text"))
    norm = {exact_dedup.normalised(t.encode()) for t in texts if len(t or "") > huge}
    assert {tuple(x) for x in found.collect()} == {(hashlib.sha256(t).hexdigest(), len(t), exact_dedup._fp(t)) for t in norm}


def test_equal_fingerprints_of_different_texts():
    rows = [(1, b"aa"), (2, b"bb"), (3, b"aa"), (4, b"cc"), (4, b"cc"), (5, b"bb")]
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "fp": 1, "size": 2, "part": 0, "parts": 2, "of_part": None, "of_class": None, "data": t} for i, t in rows])
    found = [x for b in exact_dedup._compare(iter([batch])) for x in b.to_pylist()]
    assert [x["class"] for x in found] == [0, 1, 0, 2, 2, 1]
    assert [x["data"] for x in found] == [b"aa", b"bb", None, b"cc", None, None]
    assert [x["again"] for x in found] == [False, False, False, False, True, False]


def test_same_as_sql(spark):
    compare(spark, queries.QUERIES["op3_exact_dedup"], queries.ORACLE_SQL["op3_exact_dedup"], "/root/testdata/sf0.01")
