import numpy as np
import public_tokenizers
import pytest
from small import docs, odd_rows

from cutline.llm import sentencepiece_codec as sp

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def best_score(v, text):
    """By a plain programme over characters and a dictionary of pieces."""
    t = text.replace(" ", "▁")
    t = "▁" + t if t and v.dummy_prefix else t
    pieces = {p.decode(): (0.0 if k == sp.USER_DEFINED else s) for p, s, k in zip(v.pieces, v.scores, v.kinds, strict=True) if k in (sp.NORMAL, sp.USER_DEFINED) and p}
    unknown = min(s for s, k in zip(v.scores, v.kinds, strict=True) if k == sp.NORMAL) - sp.UNKNOWN_PENALTY
    best = [0.0] + [-np.inf] * len(t)
    for i in range(len(t)):
        for j in range(i + 1, min(len(t), i + 60) + 1):
            if t[i:j] in pieces:
                best[j] = max(best[j], best[i] + pieces[t[i:j]])
        if t[i] not in pieces:
            best[i + 1] = max(best[i + 1], best[i] + unknown)
    return best[-1]


TEXTS = ["", " ", "a", "hello  world", " lead and trail ", "漢字\U0001f600é", "\n\t x", "zzzzqqq" * 9, "The quick brown fox.", "\x00\x01"]


def test_best_segmentation():
    v = sp.Vocabulary.read(MODEL)
    codec = sp.Codec(v)
    for text, (ids, score) in zip(TEXTS, codec.encode([t.encode() for t in TEXTS]), strict=True):
        assert score == pytest.approx(best_score(v, text)), text
        assert codec.decode(ids).decode() == text
        spelt = [v.pieces[i] for i in np.frombuffer(ids, "<i4")]
        assert score == pytest.approx(sum(codec.scores[v.pieces.index(p)] for p in spelt)) or any(p.startswith(b"<0x") for p in spelt)


def test_small_vocabulary():
    pieces = [b"<unk>", "▁".encode(), b"a", b"b", b"ab", "▁a".encode(), b"abb", "b▁a".encode()]
    for with_bytes in (False, True):
        more = [b"<0x%02X>" % b for b in range(256)] if with_bytes else []
        v = sp.Vocabulary(pieces + more, np.array([0, -2, -1.5, -1.7, -2.9, -2.1, -4, -2.2] + [0.0] * len(more)), [sp.UNKNOWN] + [sp.NORMAL] * 7 + [sp.BYTE] * len(more))
        codec = sp.Codec(v)
        for text in ("ab", "abb a", "aabb ab b a", "b aa", "abcé", "", "   "):
            ids, score = codec.encode([text.encode()])[0]
            assert score == pytest.approx(best_score(v, text))
            if with_bytes or text.strip("ab ") == "":
                assert codec.decode(ids).decode() == text


def test_double_array():
    keys = {k.encode(): i for i, k in enumerate(["a", "ab", "abc", "b", "é", "zz", "zyx"])}
    trie = sp.DoubleArray(keys)

    def look_up(key):
        s = 0
        for b in key:
            to = trie.base[s] + b + 1
            if trie.check[to] != s:
                return -1
            s = to
        return trie.value[s]

    assert all(look_up(k) == i for k, i in keys.items())
    assert all(look_up(k) == -1 for k in (b"c", b"z", b"zy", b"abcd", b"\xc3"))


def test_every_row_comes_back(spark):
    rows = odd_rows()
    got = sp.decode(sp.encode(docs(spark, rows), MODEL), MODEL).collect()
    assert sorted(((x["doc_id"], x["text"], x["decoded"]) for x in got), key=str) == sorted(((i, t, t or "") for i, t in rows), key=str)
    assert all(x["score"] == 0 and not x["ids"] for x in got if not x["text"])
    assert sp.encode(docs(spark, []), MODEL).count() == 0
