import random

from pyspark.sql import functions as F

from cutline.operators import names


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def _brute(forms, least):
    parent = {}
    for f, n in forms.items():
        near = [g for g in forms if g == f or len(f) >= least <= len(g) and _distance(f, g) == 1]
        parent[f] = min(near, key=lambda g: (-forms[g], g))
    root = dict(parent)
    while any(parent[r] != r for r in root.values()):
        root = {f: parent[r] for f, r in root.items()}
    return parent, root


def test_same_as_all_pairs(spark):
    r = random.Random(1)
    forms = {"".join(r.choice("abé") for _ in range(r.randrange(0, 7))): r.randrange(1, 6) for _ in range(150)} | {"x" * 300: 2, "x" * 301: 9, "ab \U0001f600a": 3, "ab \U0001f600b": 4}
    parent, root = _brute(forms, 4)
    rows = spark.createDataFrame(list(forms.items()), "form string, n long").repartition(3)
    found = names.parents(rows, 4)
    assert {x["form"]: x["parent"] for x in found.collect()} == parent
    assert {x["form"]: x["root"] for x in names.roots(found).collect()} == root
    assert len(set(root.values())) < len(forms)


def test_spellings(spark):
    given = ["Google LLC"] * 5 + ["google, inc."] * 2 + ["GOOGLE"] * 3 + ["Gogle Inc", "Goggle", None, "", "--", "Co", "Inc.", "IBM", "IBN", "Meta Co., Ltd."]
    rows = spark.createDataFrame([(g,) for g in given], "name string")
    found = {r["variation"]: (r["n"], r["canonical"]) for r in names.canonical_names(rows, "name").collect()}
    assert found["google, inc."] == (2, "Google LLC") and found["Gogle Inc"] == (1, "Google LLC") and found["Goggle"] == (1, "Google LLC")
    assert found["IBM"] == (1, "IBM") and found["IBN"] == (1, "IBN") and found["Co"] == (1, "Co")
    assert found[""] == (1, "") and found["--"] == (1, "") and None not in found
    both = names.with_variations(names.canonical_names(rows, "name")).where("canonical = 'Google LLC'").first()
    assert both["n"] == 12 and both["variations"] == ["GOOGLE", "Goggle", "Gogle Inc", "Google LLC", "google, inc."]
    assert names.canonical_names(rows.where("false"), "name").count() == 0


def test_many_names_a_letter_apart_make_no_pairs(spark):
    """10,000 names of one pattern: what is joined is one row for each letter of each name."""
    rows = spark.range(10_000).select(F.format_string("name%04d", "id").alias("form"), F.lit(1).cast("long").alias("n"))
    found = names.roots(names.parents(rows))
    assert found.where("root <> 'name0000'").count() == 0 and found.count() == 10_000
