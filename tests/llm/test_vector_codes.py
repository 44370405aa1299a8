import hashlib
import math

import numpy as np
import pytest
from oracle import compare

from cutline.llm import vector_codes as v
from cutline.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, of string"


def _table(spark, rows):
    return spark.createDataFrame([(*r, "c", "e", "o") for r in rows], SCHEMA).repartition(3)


def _nearest(x, book):
    d = [sum((int(a) - int(b)) ** 2 for a, b in zip(x, c, strict=True)) for c in book]
    return d.index(min(d)), min(d)


def _brute(rows, parts, entries, rounds):
    """{vec_id: (code, error, label_error)} and the books, by plain loops over integers."""
    whole = [(i, tuple(float(np.float32(x)) for x in e), k) for i, e, k in rows if e and all(x is not None and math.isfinite(x) for x in e)]
    first = sorted((r for r in whole if r[0] is not None), key=lambda r: (r[0], r[1]))
    whole = [(i, [math.floor(4096 * x) for x in e], k) for i, e, k in whole if len(e) == len(first[0][1])]
    first = [[math.floor(4096 * x) for x in e] for _, e, _ in first if len(e) == len(first[0][1])][:entries]
    w = len(first[0]) // parts
    books = [[e[p * w : p * w + w] for e in first] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            mine = [[] for _ in books[p]]
            for _, e, _ in whole:
                mine[_nearest(e[p * w : p * w + w], books[p])[0]].append(e[p * w : p * w + w])
            books[p] = [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else old for m, old in zip(mine, books[p], strict=True)]
    found = []
    for i, e, k in whole:
        best = [_nearest(e[p * w : p * w + w], books[p]) for p in range(parts)]
        found.append((i, k, "".join(f"{b:02x}" for b, _ in best), sum(d for _, d in best)))
    labels = {}
    for _, k, _, d in found:
        labels[k] = labels.get(k, 0) + d
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, k, c, d, labels[k], sha) for i, k, c, d in found), key=str), books


@pytest.mark.parametrize("scale", [1.0, 1e-3, 3e4])
def test_same_as_plain_loops(spark, scale):
    r = np.random.default_rng(5)
    rows = [(i, (r.normal(size=8) * scale).tolist(), int(i % 3) if i % 5 else None) for i in range(60)]
    rows += [(i, rows[i % 7][1], 1) for i in range(60, 90)]  # copies: ties of distances
    rows += [(90, None, 1), (91, [], 1), (92, [1.0] * 7 + [None], 1), (93, [1.0] * 7 + [math.nan], 1), (94, [1.0] * 7 + [math.inf], 1), (95, [1.0] * 16, 1), (None, rows[0][1], 1), (3, rows[4][1], 2), (3, rows[4][1], 2)]
    want, books = _brute(rows, 4, 8, 3)
    got = v.product_codes(_table(spark, rows), parts=4, entries=8, rounds=3)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    dim, fitted = v.fit(_table(spark, rows), parts=4, entries=8, rounds=3)
    assert dim == 8 and [b.tolist() for b in fitted] == books
    back = {r["vec_id"]: r["embedding"] for r in v.decoded(got, fitted).collect()}
    code = {w[0]: w[2] for w in want}[5]
    assert back[5] == [float(np.float32(x / 4096)) for p in range(4) for x in books[p][int(code[2 * p : 2 * p + 2], 16)]]


def test_nothing_and_little(spark):
    assert v.product_codes(_table(spark, [(1, None, 1), (2, [], 1), (None, [1.0] * 8, 1)])).count() == 0
    one = v.product_codes(_table(spark, [(1, [0.5] * 8, None)])).first()
    assert (one["code"], one["error"], one["label_error"]) == ("00" * 8, 0, 0)
    with pytest.raises(ValueError):
        v.product_codes(_table(spark, [(1, [0.5] * 7, None)]))


@pytest.mark.parametrize("size", [10, 4096, 1 << 22])
def test_nearest_where_float32_cannot_tell(size):
    """Entries a unit apart around far points: products of 24 bits round them together, integers tell them apart."""
    r = np.random.default_rng(size)
    base = r.integers(-size, size, 8)
    book = base + r.integers(-1, 2, (16, 8))
    x = np.concatenate([base + r.integers(-2, 3, (400, 8)), r.integers(-size, size, (400, 8)), book])
    index, d = v.nearest(x, book)
    assert [(i, e) for i, e in zip(index.tolist(), d.tolist(), strict=True)] == [_nearest(a, book) for a in x]


def test_nearest_of_equal_entries_is_the_first():
    book = np.array([[5, 5], [1, 2], [1, 2], [5, 5]])
    index, d = v.nearest(np.array([[1, 2], [5, 5], [3, 3]]), book)
    assert index.tolist() == [1, 0, 1] and d.tolist() == [0, 0, 5]


def test_few_entries_are_reckoned_twice(monkeypatch):
    """The product decides nearly all: of 16 entries hardly more than one is left to the integers."""
    seen = []
    plain = v._by_integers
    monkeypatch.setattr(v, "_by_integers", lambda x, book, row, entry: seen.append(len(row)) or plain(x, book, row, entry))
    r = np.random.default_rng(1)
    v.nearest(r.integers(-4096, 4096, (5000, 8)), r.integers(-4096, 4096, (16, 8)))
    assert seen[0] < 5010


def test_same_as_sql(spark):
    compare(spark, QUERIES["op12_vector_codes"], ORACLE_SQL["op12_vector_codes"], "/root/testdata/sf0.001")
