import math

import numpy as np
from small import docs, odd_rows

from cutline.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    table, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    learnt = labels.where("doc_id % 2 = 0")
    got = quality.importance(table, learnt).join(labels.where("doc_id % 2 = 1"), "doc_id").select("accepted", "quality").collect()
    good = [x["accepted"] for x in got if x["quality"] == 1]
    junk = [not x["accepted"] for x in got if x["quality"] == 0]
    assert len(good) > 10 and len(junk) > 5
    assert np.mean(good) > 0.95 and np.mean(junk) > 0.6


def test_sample_is_the_gumbel_top_k(spark):
    table, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    got = quality.importance(table, labels, share=0.3).collect()
    assert len(got) == table.count()
    accepted = sorted((x for x in got if x["accepted"]), key=lambda x: (-x["gumbel_key"], x["doc_id"]))
    k = round(0.3 * len(accepted))
    assert {x["doc_id"] for x in got if x["sampled"]} == {x["doc_id"] for x in accepted[:k]}


def test_weights_are_the_log_ratio(spark):
    texts = [(1, "good words here"), (2, "bad bad bad"), (3, "good words"), (4, None)]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 1), (3, None, 0)], "doc_id long, quality int, good int")
    got = {x["doc_id"]: x for x in quality.importance(docs(spark, texts), labels).collect()}
    grams = {i: quality.features([(t or "").encode()])[0] for i, t in texts}
    raw, target = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    for g in grams.values():
        np.add.at(raw, g, 1)
    np.add.at(target, grams[1], 1)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    for i, g in grams.items():
        assert math.isclose(got[i]["log_weight"], ratio[g].sum(), abs_tol=1e-9) and got[i]["n_features"] == len(g)
    assert got[1]["accepted"] and not got[2]["accepted"]


def test_features():
    found, sizes = quality.features([b"a b a b", b"", b"A!!", b"x"])
    assert sizes.tolist() == [7, 0, 3, 1]
    assert found[0] == found[2] and found[4] == found[6] and found[0] == found[7]


def test_cut():
    assert quality.best_cut(np.array([0.1, 0.2, 0.8, 0.9]), np.array([False, False, True, True])) == 0.5
    assert quality.best_cut(np.array([0.5, 0.5]), np.array([True, False])) == -math.inf
    assert quality.best_cut(np.zeros(0), np.zeros(0, bool)) == -math.inf


def test_repeated_ids_and_equal_rows_are_drawn_one_by_one(spark):
    """14 rows of a few ids, null too, and 600 equal rows: the sample has its exact size, and the largest keys."""
    given = [(i, f"text {k}") for k, i in enumerate([1, 1, 1, 2, 2, 2, 2, None, None, None, None, 3, 3, 3])] + [(9, "the same")] * 600
    none = spark.createDataFrame([], "doc_id long, quality int")
    for share, want in ((0.0, 0), (0.005, 3), (0.2, 123), (0.9, 553), (1.0, 614)):
        rows = quality.importance(docs(spark, given), none, share=share, text_hash=True).collect()
        assert sum(r["sampled"] for r in rows) == want and len(rows) == 614
        inside, outside = ([r["gumbel_key"] for r in rows if r["sampled"] == x] for x in (True, False))
        assert not inside or not outside or min(inside) >= max(outside)
    assert len({r["gumbel_key"] for r in rows}) == 15  # rows of one id have noise of their own
    assert {r["sampled"] for r in quality.importance(docs(spark, given), none, share=None).collect()} == {None}


def test_odd_rows_and_no_labels(spark):
    table = docs(spark, odd_rows())
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.importance(table, labels).collect()
    assert len(got) == len(odd_rows()) and all(x["accepted"] for x in got)
    assert all(x["log_weight"] == 0 for x in got)
    assert quality.importance(docs(spark, []), labels).count() == 0
