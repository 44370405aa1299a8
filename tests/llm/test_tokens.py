"""Packing and token files against the tokenizers library itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import pytest
from pyspark.sql import functions as F
from small import docs, odd_rows, words
from tokenizers import Tokenizer

from cutline.llm import packing, token_files, tokens
from cutline.llm.tokens import encoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a b", "A  B\n\nC", "it's 12,345!!", "É́ é <|endoftext|> x", "İstanbul ẞ", " x y\x1cz\x85", "tab\tnew\n line \r\n", "漢字かな\U0001f600‍", " <|startoftext|>", "x" * 3000, "ＡＢＣ ﬁ", "日\n本 語", "it 's we'll'd"]


def ids_of(path, text, end):
    return np.array([*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize(("path", "blanks"), [(WORD, False), (BYTE, True)])
def test_ids_are_the_librarys(path, blanks):
    encode, direct = encoder(open(path, encoding="utf-8").read(), blanks), Tokenizer.from_file(path)
    for _ in range(2):
        ids, sizes = encode([t.encode() for t in ODD])
        for text, found in zip(ODD, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
            assert found.tolist() == direct.encode(text, add_special_tokens=False).ids, text


def test_packing_is_whole(spark):
    rows = odd_rows() + [(1000 + i, words(1 + i * 7 % 900, i)) for i in range(150)]
    pieces = [x.asDict() for x in packing.pack(docs(spark, rows).repartition(2), WORD).collect()]
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"] > 0
    # every id of every row once, in order
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(ids_of(WORD, t, 1).tobytes())
    assert set(by_doc) == set(want)
    for i, texts in want.items():
        if len(texts) == 1:
            mine = sorted(by_doc[i], key=lambda p: p["start"])
            assert b"".join(bytes(p["ids"]) for p in mine) == texts[0]
            assert [p["start"] for p in mine] == np.cumsum([0, *(p["length"] for p in mine[:-1])]).tolist()
            assert {p["doc_tokens"] for p in mine} == {len(texts[0]) // 4}
        else:
            assert sorted(sum((list(bytes(p["ids"])) for p in by_doc[i]), [])) == sorted(sum(map(list, texts), []))
    # sequences without gaps, and hardly any padding
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append(p)
    padding = total = 0
    for s in sequences.values():
        s.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in s] == np.cumsum([0, *(p["length"] for p in s[:-1])]).tolist()
        n = sum(p["length"] for p in s)
        assert n <= 2048 and {p["sequence_length"] for p in s} == {n}
        total += n
        padding += 0 if n & (n - 1) == 0 else 2048 - n
    assert padding == 0 and total == sum(len(t) // 4 for ts in want.values() for t in ts)


def test_sum_of_squares_rule():
    r = np.random.default_rng(1)
    packer = packing.Packer(16)
    for _ in range(400):
        n = int(r.integers(1, 16))
        costs = []
        for level in range(16 - n, -1, -1):
            counts = packer.levels.copy()
            if level and not counts[level]:
                continue
            counts[level] -= bool(level)
            if level + n < 16:
                counts[level + n] += 1
            costs.append((int((counts**2).sum()), -level))
        assert packer.level_for(n) == -min(costs)[1]
        packer.add(1, bytes(4 * n))
        assert packer.levels.sum() == packer.open


@pytest.mark.parametrize("count", [1, 2, 40, 300])
def test_open_windows_are_finished_by_the_rule(count):
    r, packer, at_once = np.random.default_rng(count), packing.Packer(2048), 0
    texts = [np.full(n, i, "<u4").tobytes() for i, n in enumerate(r.integers(1, 900, count).tolist())]
    for i, ids in enumerate(texts):
        packer.add(i, ids)
    packer.finish()
    assert not packer.open and not packer.levels.any()
    sizes = [sum(len(p[2]) // 4 for p in w) for w in packer.done]
    assert all(n & (n - 1) == 0 and 0 < n <= 2048 for n in sizes)
    pieces = sorted((p for w in packer.done for p in w), key=lambda p: p[:2])
    for i, ids in enumerate(texts):
        mine = [p for p in pieces if p[0] == i]
        assert b"".join(p[2] for p in mine) == ids
        assert [p[1] for p in mine] == np.cumsum([0, *(len(p[2]) // 4 for p in mine[:-1])]).tolist()
        at_once += len(mine) == 1
    assert count < 40 or at_once > 0.6 * count  # few documents are cut


def test_open_windows_are_bounded():
    packer = packing.Packer(2048, most_open=10)
    for i in range(500):
        packer.add(i, np.full(1025, i, "<u4").tobytes())
        assert packer.open <= 10
    packer.finish()
    assert sum(len(p[2]) for w in packer.done for p in w) == 500 * 4 * 1025


def test_capacity_and_empty(spark):
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(docs(spark, []), WORD, capacity=1000)
    assert packing.pack(docs(spark, []), WORD).count() == 0
    assert token_files.read_token_files(token_files.write_token_files(docs(spark, []), BYTE)).count() == 0


def test_token_files(spark):
    rows = odd_rows() + [(1000 + i, words(50, i)) for i in range(30)]
    manifest = token_files.write_token_files(docs(spark, rows), BYTE, length=64)
    got = [tuple(x) for x in token_files.read_token_files(manifest).collect()]
    want, start = [], 0
    order = [(x["doc_id"], x["text"]) for x in docs(spark, rows).orderBy("doc_id", F.xxhash64("text")).collect()]
    for i, t in order:
        ids = ids_of(BYTE, t, 0)
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda x: x[1]) == want
    # sequences of equal length, masked at the end only, read in place
    stream = []
    for x in manifest.orderBy("part").collect():
        _, path = pyarrow.fs.FileSystem.from_uri(x["ids_path"])
        file = token_files.TokenFile(path)
        n = sum(file.batch(i).num_rows for i in range(file.reader.num_record_batches))
        for i in range(n):
            before = pa.total_allocated_bytes()
            ids, mask = file.sequence(i), file.mask(i)
            assert pa.total_allocated_bytes() - before < 64  # nothing is copied
            assert len(ids) == len(mask) == 64 and (i == n - 1 or mask.true_count == 64)
            assert not (ids.flags.owndata or ids.flags.writeable) and not mask.buffers()[1].is_mutable
            stream += ids[mask.to_numpy(zero_copy_only=False)].tolist()
        assert file.reader.schema == token_files.file_schema(64, small_ids=True)
    assert stream == [t for x in order for t in ids_of(BYTE, x[1], 0).tolist()]


@pytest.mark.parametrize(("path", "blanks"), [(WORD, False), (BYTE, True)])
def test_ids_of_many_made_texts(path, blanks):
    """Letters of several scripts, marks, digits, punctuation and white space in any order; also when what is remembered is forgotten."""
    r = random.Random(5)
    parts = ["a", "B", "the", "ing", "9", "42", ".", ",", "...", "'", "'s", "-", "&&&", "(", ")", "|", "<", "<|", "|>", "_", "é", "É", "ß", "İ", "́", "ñ", "漢", "字", "…", "“", " ", " ", " ", "  ", "\n", "\t", "\xa0", "\U0001f600", "‍"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(60))) for _ in range(3000)]
    encode, direct = encoder(open(path, encoding="utf-8").read() + " ", blanks), Tokenizer.from_file(path)
    for at in range(0, len(texts), 500):
        ids, sizes = encode([t.encode() for t in texts[at : at + 500]])
        for text, found in zip(texts[at : at + 500], np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
            assert found.tolist() == direct.encode(text, add_special_tokens=False).ids, text


def test_known_pieces_past_the_limit(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    encode, direct = encoder(open(BYTE, encoding="utf-8").read() + "  ", True), Tokenizer.from_file(BYTE)
    for seed in range(8):
        texts = [words(30, 10 * seed + i) for i in range(3)]
        ids, sizes = encode([t.encode() for t in texts])
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [direct.encode(t, add_special_tokens=False).ids for t in texts]
