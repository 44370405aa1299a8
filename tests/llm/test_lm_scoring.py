import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from small import docs, odd_rows, words

from cutline.llm import lm_scoring, queries


def tokens(text):
    return [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]


def slow_model(train, prior=lm_scoring.PRIOR):
    """The same model, by recursion over dictionaries."""
    seqs = [["<s>", *tokens(t), "</s>"] for t in train]
    one = Counter(w for s in seqs for w in s[1:])
    many = Counter(tuple(s[i - k : i + 1]) for s in seqs for i in range(1, len(s)) for k in (1, 2) if i >= k)
    context = Counter(w for s in seqs for w in s[:-1])

    def p(words):
        if len(words) == 1:
            return (one[words[0]] - 0.5 if words[0] in one else 0.5 * len(one) + 0.5) / (sum(one.values()) + 0.5)
        of = context[words[0]] if len(words) == 2 else many[words[:-1]]
        return (many[words] + prior * p(words[1:])) / (of + prior)

    return lambda text: sum(math.log10(p(tuple(s[max(0, i - 2) : i + 1]))) for s in [["<s>", *tokens(text), "</s>"]] for i in range(1, len(s)))


def letters(seed, n=60):
    r = random.Random(seed)
    return [" ".join(r.choice("abcdefg") for _ in range(r.randrange(0, 30))) for _ in range(n)] + ["c a b"] * 9


@pytest.mark.parametrize("block", [2, 7, 100, lm_scoring.BLOCK])
def test_walk_is_the_backoff_model(spark, block):
    """Texts that are learnt from and others, words that are not known; texts go on in the next block, and blocks hold several texts."""
    rows = [*enumerate(letters(3)), (-1, "a b zzz c a b"), (-2, "zzz yyy"), (-3, "g " * 50), (-4, None), (-5, letters(4)[1])]
    got = {x["doc_id"]: x["score"] for x in lm_scoring.score(docs(spark, rows), F.col("doc_id") >= 0, block=block).collect()}
    slow = slow_model([t for i, t in rows if i >= 0])
    assert len(got) == len(rows)
    for i, t in rows:
        assert got[i] == pytest.approx(slow(t), abs=1e-9)


def automaton(sequences, least=1):
    """The automaton of one block that is all there is; words are numbers from 3 on."""
    flat = np.array([w for s in sequences for w in (int(lm_scoring._START), *s, int(lm_scoring._END))], np.uint64)
    words, ids = np.unique(flat, return_inverse=True)
    block = lm_scoring.Block(lm_scoring._sorted_packed(words), lm_scoring._packed(ids), np.ones(len(sequences), np.int64), np.array([len(s) + 1 for s in sequences]))
    one, two, three = block.counts(block.own)
    return block, lm_scoring.Automaton(block, one, np.where(two >= least, two, 0), three, int(one.sum()), int((one > 0).sum()), len(sequences))


def test_probabilities_add_up():
    r = np.random.default_rng(2)
    block, a = automaton([[int(x) for x in r.choice(range(3, 12), r.integers(0, 15))] for _ in range(200)])
    start = int(np.searchsorted(block.words, lm_scoring._START))
    unknown = 0.5 * (len(block.words) - 1 + 1) / (len(block.ids) - 200 + 0.5)
    assert len(a.fail) > 60
    end = int(np.searchsorted(block.words, lm_scoring._END))
    contexts = [0, *(1 + w for w in range(a.width) if w != end), *(1 + a.width + p for p in range(len(block.pairs)) if block.ids[block.first_pair[p]] != end)]
    for s in contexts:
        back, t = 0.0, s
        while t:
            back, t = back + a.back[t], a.fail[t]
        assert sum(10 ** a.walk(s, [w])[0] for w in range(a.width) if w != start) + unknown * 10**back == pytest.approx(1)


def test_failure_arcs_lead_to_shorter_contexts():
    block, a = automaton([[3, 4, 5], [4, 6], [3, 4, 5]])
    three, four, five, six = (int(np.searchsorted(block.words, np.uint64(x))) for x in (3, 4, 5, 6))
    pair = {(int(block.ids[i - 1]), int(block.ids[i])): 1 + a.width + k for k, i in enumerate(block.first_pair)}
    s = pair[three, four]
    assert a.fail[s] == 1 + four
    assert a.fail[1 + four] == 0
    assert s * a.width + five in a.arcs
    assert s * a.width + six not in a.arcs
    assert a.walk(s, [five])[1] == pair[four, five]
    assert a.walk(s, [six])[0] == pytest.approx(a.back[s] + a.walk(1 + four, [six])[0])
    assert a.walk(s, [three])[1] == 1 + three  # no arc but that of the empty context: its own one-word context follows
    total, state = a.walk(0, [three, four, five])
    steps = 0.0, 0
    for w in (three, four, five):
        more, to = a.walk(steps[1], [w])
        steps = steps[0] + more, to
    assert (pytest.approx(total), state) == steps


def base(rows, held):
    counts = Counter(w for (i, t), h in zip(rows, held, strict=True) if not h for w in [*tokens(t), b"</s>"])
    n, v = sum(counts.values()), len(counts)
    out = []
    for (i, t), h in zip(rows, held, strict=True):
        found = [*tokens(t), b"</s>"]
        out.append((i, h, len(found), sum(counts[w] > 0 for w in found), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in found), 4)))
    return sorted(out, key=str)


def facts(rows):
    return sorted(((x["doc_id"], x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 4)) for x in rows), key=str)


def test_base_score_and_held_out_texts(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op9_lm_scoring(spark, sf).collect()
    assert facts(got) == base(rows, [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows])
    # the model says more of unseen texts than counts of single words do
    unseen = [x for x in got if x["held_out"]]
    assert sum(x["score"] for x in unseen) > sum(x["base_score"] for x in unseen)
    assert all(x["score"] < 0 and math.isfinite(x["score"]) for x in got)


def test_odd_rows(spark):
    rows = odd_rows()
    held = [i is not None and i % 2 == 0 for i, _ in rows]
    table = docs(spark, rows).withColumn("held_out", F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False)))
    got = lm_scoring.score(table, ~F.col("held_out"), keep=["held_out"]).collect()
    assert facts(got) == base(rows, held)


def test_nothing_to_learn_from(spark):
    got = lm_scoring.score(docs(spark, [(1, "a b"), (2, None)]), F.lit(False)).collect()
    assert sorted((x["doc_id"], x["n_tokens"], x["n_known"], x["train_tokens"], x["base_score"]) for x in got) == [(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)]
    assert lm_scoring.score(docs(spark, []), F.lit(True)).count() == 0


def test_every_ngram_counts_at_every_size(spark):
    """N-grams that occur once are in the model however many tokens surround them."""
    r = random.Random(4)
    once = " ".join(f"rare{i}" for i in range(12))
    train = [once] + [" ".join(r.choice("abcdefgh") for _ in range(4000)) for _ in range(100)]
    got = {x["doc_id"]: x["score"] for x in lm_scoring.score(docs(spark, [*enumerate(train), (-1, "rare3 rare4 rare9 a zzz")]), F.col("doc_id") >= 0, block=50_000).collect()}
    slow = slow_model(train)
    for i, t in ((0, once), (-1, "rare3 rare4 rare9 a zzz"), (5, train[5])):
        assert got[i] == pytest.approx(slow(t), abs=1e-6)


def test_long_text_in_pieces(spark):
    """A text of many blocks, one without spaces, and rows that repeat both id and text."""
    long = words(30_000, 8, of=300)
    rows = [(1, long), (2, "x" * 2_000_000), (2, "x" * 2_000_000), (3, words(50, 9, of=300))]
    got = lm_scoring.score(docs(spark, rows), F.lit(True), block=1000).collect()
    assert facts([x.asDict() | {"held_out": False} for x in got]) == base(rows, [False] * 4)
    slow = slow_model([t for _, t in rows])
    assert sorted(x["score"] for x in got) == pytest.approx(sorted(slow(t) for _, t in rows), abs=1e-6)


def test_kept_columns_may_have_any_name(spark):
    names = ["train", "uid", "learn", "block", "facts", "pieces", "text", "kept0", "n_tokens", "count", "h"]
    table = docs(spark, [(1, "a b"), (2, None)]).drop("block", "count", "h")
    for x in set(names) - {"text"}:
        table = table.withColumn(x, F.concat(F.lit(x), F.col("doc_id").cast("string")))
    got = lm_scoring.score(table, F.col("train") == "train1", keep=names)
    assert got.columns == ["doc_id", *names, "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert sorted(tuple(x)[1:3] for x in got.collect()) == [("train1", "uid1"), ("train2", "uid2")]
    assert sorted(tuple(x)[-4:-2] for x in got.collect()) == [(1, 3), (3, 3)]


def test_nested_columns_and_a_null_condition(spark):
    table = docs(spark, [(1, "a b"), (None, "a")]).select("doc_id", "text", F.create_map(F.lit("k"), "doc_id").alias("m"), F.array(F.struct("lang")).alias("s"))
    got = lm_scoring.score(table, F.col("doc_id") > 0, keep=["m", "s"]).collect()
    assert sorted((x["train_tokens"], x["n_known"], x["m"]["k"], x["s"][0]["lang"]) for x in got if x["doc_id"]) == [(3, 3, 1, "en")]
    assert [(x["n_known"], x["m"]["k"]) for x in got if x["doc_id"] is None] == [(2, None)]
