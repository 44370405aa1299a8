import random

import pytest
from pyspark.sql import functions as F

from cutline.operators import text_index

COLUMNS = ["name", "sort"]


def _rows(spark):
    r = random.Random(3)
    letters = "abAB é1"
    word = lambda: None if r.random() < 0.05 else "".join(r.choice(letters) for _ in range(r.randrange(14)))
    data = [(i, word(), word()) for i in range(400)] + [(500, "100%_sure\\", "İstanbul"), (501, "x" * 20_000 + "needle", None), (502, "", "日本語の文")]
    return data, spark.createDataFrame(data, "id long, name string, sort string").repartition(4)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    data, rows = _rows(spark)
    path = str(tmp_path_factory.mktemp("index") / "i")
    text_index.add(rows.where("id < 200"), path, "id", COLUMNS, buckets=16)
    text_index.add(rows.where("id >= 200"), path, "id", COLUMNS, buckets=16)  # added to later
    return data, rows, path


@pytest.mark.parametrize("text", ["aba", "AbA", "é1a", "abab", "aaaa", "ab", "", "zzz", "%_s", "\\", "needle", "本語の", "b 1", "İst", "xxxxxxxxneedle"])
def test_same_as_contains(index, text):
    data, rows, path = index
    got = {r["id"] for r in text_index.search(rows, path, text, "id", COLUMNS, buckets=16).collect()}
    pattern = text.lower().replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    like = " or ".join(f"lower({c}) like :p" for c in COLUMNS)
    rows.createOrReplaceTempView("rows_of_index")
    want = {r["id"] for r in rows.sparkSession.sql(f"select id from rows_of_index where {like}", {"p": f"%{pattern}%"}).collect()}
    assert got == want
    if text.isascii() and text not in ("zzz", ""):
        assert got == {i for i, *texts in data if any(t is not None and text.lower() in t.lower() for t in texts)} and got


def test_only_its_own_folders_are_opened(spark, tmp_path):
    """With all other folders' files spoilt the search still finds what it did; its plan names the folders and pushes the trigrams down."""
    _, rows = _rows(spark)
    path = str(tmp_path / "i")
    text_index.add(rows, path, "id", COLUMNS, buckets=16)
    own = {f"bucket={text_index._bucket('needle'[i : i + 3], 16)}" for i in range(4)}
    for file in tmp_path.glob("i/*/bucket=*/*.parquet"):
        if file.parent.name not in own:
            file.write_bytes(b"nothing to read")
    one = text_index.candidates(rows, path, "needle", "id", COLUMNS, buckets=16)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(gram), EqualTo(gram," in plan
    assert [r["id"] for r in one.collect()] == [501]
    assert text_index.search(rows, path, "NEEDLE", "id", COLUMNS, buckets=16).count() == 1
    assert text_index.candidates(rows, path, "ab", "id", COLUMNS) is None


def test_a_trigram_of_most_rows_is_dealt_over_many_files(spark, tmp_path):
    rows = spark.range(5000).select("id", F.when(F.col("id") < 4900, "name").otherwise(F.concat(F.lit("name "), F.col("id"))).alias("name"))
    text_index.add(rows, str(tmp_path / "i"), "id", ["name"])
    hot = spark.read.parquet(str(tmp_path / "i" / "postings")).where("gram = 'nam'").groupBy(F.input_file_name()).count().collect()
    assert len(hot) > 1 and sum(r["count"] for r in hot) == 5000
    assert text_index.search(rows, str(tmp_path / "i"), "me 4999", "id", ["name"]).count() == 1


def test_many_texts_at_once_and_letters_that_grow(index):
    """One look at the index gives each text's rows; the trigrams of a text that lower case makes longer are all kept."""
    data, rows, path = index
    texts = ["aba", "é1a", "bul", "b", "", "needle", "zzz", "AbA"]
    found = text_index.search_each(rows, path, texts, "id", COLUMNS, buckets=16).collect()
    got = {t: sorted(r["id"] for r in found if r["looked_for"] == t) for t in texts}
    assert got == {t: sorted(r["id"] for r in text_index.search(rows, path, t, "id", COLUMNS, buckets=16).collect()) for t in texts}
    assert got["bul"] == [500] and got["zzz"] == [] and got["aba"] == got["AbA"] and len(got[""]) == sum(x is not None or y is not None for _, x, y in data)
