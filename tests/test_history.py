import datetime
import random

from cutline.operators import history
from cutline.shared import checkpoint_dir

KEY, VALUES = ["k"], ["v", "w"]
SCHEMA = "k string, at date, version long, v string, w int"
D = datetime.date


def _brute(rows):
    last = {}
    for k, at, version, *values in rows:
        last[k, at] = max(last.get((k, at), (-1,)), (version, *values), key=lambda x: x[0])
    out, open_ = [], {}
    for (k, at), (_, *values) in sorted(last.items(), key=lambda x: (x[0][0] is not None, x[0][0] or "", x[0][1])):
        if k in open_ and open_[k][0] == values:
            continue
        if k in open_:
            out.append((k, *open_[k][0], open_[k][1], at))
        open_[k] = (values, at)
    return sorted(out + [(k, *v, f, None) for k, (v, f) in open_.items()], key=str)


def test_batches_in_any_order_and_again(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), D(2020, 1, 1) + datetime.timedelta(r.randrange(40)), i, r.choice(["x", "y", None]), r.choice([1, 2])) for i in range(120)]
    parts = [[x for x in rows if x[2] % 4 == p] for p in (2, 0, 3, 1)]
    checkpoint_dir(spark)
    seen, found = None, None
    for part in [*parts, parts[0], [("c", D(2020, 1, 1), 1, "z", 1)], []]:
        batch = spark.createDataFrame(part, SCHEMA)
        seen = history.observe(seen, batch, KEY, VALUES, "at", "version").checkpoint()
        found = (history.intervals(seen, KEY, VALUES, "at") if found is None else history.merge(found, seen, batch, KEY, VALUES, "at")).checkpoint()
    want = _brute([*rows, ("c", D(2020, 1, 1), 1, "z", 1)])
    assert sorted(map(tuple, found.collect()), key=str) == want
    for day in (D(2019, 12, 31), D(2020, 1, 10), D(2020, 2, 9), D(2021, 1, 1)):
        got = sorted(map(tuple, history.as_of(found, day).collect()), key=str)
        assert got == [x for x in want if x[3] <= day and (x[4] is None or day < x[4])]


def test_a_late_value_between_two_that_agree(spark):
    """a on the 1st, a on the 5th, then b for the 3rd: a comes back on the 5th, which a table of intervals alone has forgotten."""
    first = spark.createDataFrame([("k", D(2020, 1, 1), 1, "a", 1), ("k", D(2020, 1, 5), 2, "a", 1), (None, None, 3, "n", 1)], SCHEMA)
    late = spark.createDataFrame([("k", D(2020, 1, 3), 3, "b", 1)], SCHEMA)
    seen = history.observe(None, first, KEY, VALUES, "at", "version")
    found = history.intervals(seen, KEY, VALUES, "at")
    assert found.count() == 1
    found = history.merge(found, history.observe(seen, late, KEY, VALUES, "at", "version"), late, KEY, VALUES, "at")
    assert [r["v"] for r in found.orderBy("valid_from").collect()] == ["a", "b", "a"]
