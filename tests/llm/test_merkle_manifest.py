import hashlib

import pytest
from oracle import compare
from pyspark.sql import functions as F
from small import EXTRA, SCHEMA, odd_rows, words

from cutline.llm.merkle_manifest import manifest
from cutline.llm.queries import ORACLE_SQL, QUERIES

H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def _leaf(*values):
    return H("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in values))


def _fold(nodes, fanout):
    """(root, proofs): of each node the [(left, right)] from the bottom up."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for p, i in zip(proofs, at, strict=True):
            run, k = runs[i // fanout], i % fanout
            p.append(("".join(run[:k]), "".join(run[k + 1 :])))
        nodes, at = [H("".join(r)) for r in runs], [i // fanout for i in at]
    return nodes[0], proofs


def _brute(rows, fanout, changed):
    groups = {}
    for i, t, source in rows:
        rest = ("en", None if t is None else len(t))
        leaf, found = (_leaf(i, source, *rest, x) for x in (t, changed(i, t)))
        groups.setdefault(source, []).append((i is not None, i or 0, leaf, found, i))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _fold([x[2] for x in sorted(groups[s])], fanout) for s in order}
    root, upper = _fold([trees[s][0] for s in order], fanout)
    out = []
    for s, above in zip(order, upper, strict=True):
        for (_, _, leaf, found, i), proof in zip(sorted(groups[s]), trees[s][1], strict=True):
            h = found
            for left, right in proof + above:
                h = H(left + h + right)
            out.append((i, leaf, trees[s][0], root, H("".join(a + b for a, b in proof + above)), h, h == root))
    return sorted(out, key=str)


def _table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), *EXTRA) for i, t, s in rows], SCHEMA).repartition(5)


SOURCES = [None, "", "a", "Z", "é", "=a", "\U0001f600", "￮"]


@pytest.mark.parametrize("fanout", [2, 3, 7])
def test_same_as_plain_loops(spark, fanout):
    rows = [(i, t, SOURCES[k % len(SOURCES)]) for k, (i, t) in enumerate(odd_rows())]
    rows += [(1000 + k, f"{k}\nline", "hot") for k in range(90)] + [(k, None, "of nine") for k in range(9)] + [(5, "x\n", "alone"), (None, "y", "twice"), (None, "y", "twice")]
    found = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    changed = lambda i, t: t.replace("\n", "") if t is not None and i is not None and i % 2 == 0 else t
    got = sorted((tuple(r) for r in manifest(_table(spark, rows), found, fanout).collect()), key=str)
    want = _brute(rows, fanout, changed)
    assert got == want
    assert {r[-1] for r in want} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10])
def test_one_source(spark, n):
    rows = [(i, f"t{i}", "s") for i in range(n)]
    got = sorted((tuple(r) for r in manifest(_table(spark, rows)).collect()), key=str)
    assert got == _brute(rows, 3, lambda i, t: t)
    assert all(r[-1] for r in got) and all(r[2] == r[3] for r in got)


def test_no_rows_and_a_very_long_text(spark):
    assert manifest(_table(spark, [(1, "a", "s")]).where("false")).count() == 0
    rows = [(1, words(400_000, 1), "s"), (2, "", "s"), (3, None, "s")]
    assert sorted((tuple(r) for r in manifest(_table(spark, rows)).collect()), key=str) == _brute(rows, 3, lambda i, t: t)


def test_every_changed_row_is_found(spark):
    rows = [(i, f"text {i}", f"s{i % 3}") for i in range(40)]
    changed = F.when(F.col("doc_id") == 17, F.lit("other")).otherwise(F.col("text"))
    assert [r["doc_id"] for r in manifest(_table(spark, rows), changed).where("not verified").collect()] == [17]


def test_same_as_sql(spark):
    compare(spark, QUERIES["op13_merkle_manifest"], ORACLE_SQL["op13_merkle_manifest"], "/root/testdata/sf0.001")
