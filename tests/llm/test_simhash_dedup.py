import random
import re

import xxhash
from small import docs, odd_rows, words

from cutline.llm import simhash_dedup
from cutline.llm.components import connected_components


def slow_fingerprint(text):
    found = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or [b" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps):
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                up[root(i)] = root(j)
    least = {}
    for i, doc in enumerate(ids):
        r = root(i)
        least[r] = min((x for x in (doc, least.get(r)) if x is not None), default=None)
    return [least[root(i)] for i in range(len(fps))]


def check(spark, rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    found = slow_components([i for i, _ in rows], fps)
    want = sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, found, strict=True)), key=str)
    got = sorted((tuple(x) for x in simhash_dedup.near_duplicates(docs(spark, rows)).collect()), key=str)
    assert got == want


def test_brute_force_on_odd_rows(spark):
    check(spark, odd_rows())


def test_brute_force_on_documents(spark):
    check(spark, [(x["doc_id"], x["text"]) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])


def test_near_copies_of_near_copies(spark):
    text = words(400, 9).split()
    rows = []
    for i in range(40):
        text[random.Random(i).randrange(400)] = f"new{i}"
        rows.append((100 - i, " ".join(text)))
    check(spark, rows)


def test_empty(spark):
    assert simhash_dedup.near_duplicates(docs(spark, [])).count() == 0


def linked(spark, fps):
    """Labels by links() against labels by all pairs."""
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = {x["node"]: x["label"] for x in connected_components(simhash_dedup.links(table)).collect()}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = slow_components(signed, fps)
    assert [found.get(f, f) for f in signed] == want


def around(n, flips, seed, half=None):
    r = random.Random(seed)
    centre, out = r.getrandbits(64), set()
    while len(out) < n:
        x = centre
        for b in r.sample(range(half or 64), flips):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


def test_links_with_full_keys(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "HOT_KEY", 50)
    fps = around(150, 3, 1, half=32) + around(150, 5, 2, half=32) + around(60, 2, 3) + [0, (1 << 64) - 1, 1, 1 << 63]
    linked(spark, sorted(set(fps)))


def test_forest_deals_out_large_keys(monkeypatch):
    import numpy as np

    fps = np.array(around(2500, 4, 4, half=32), np.uint64)
    direct = simhash_dedup._Forest(fps)
    direct.compare(np.arange(len(fps)))
    dealt = simhash_dedup._Forest(fps)
    dealt.run(int(fps[0] >> np.uint64(32)) + (32 << 33))
    roots = lambda f: [f.root(i) for i in range(len(fps))]
    a, b = roots(direct), roots(dealt)
    assert len(set(a)) == len(set(b)) == len(set(zip(a, b, strict=True)))


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 50), (60, 61), (61, 60), (70, 62), (70, 61)]
    found = {x["node"]: x["label"] for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(31)} | {60: 60, 61: 60, 62: 60, 70: 60}
