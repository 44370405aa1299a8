"""Language-model scores of whole texts by a weighted backoff automaton of all n-grams of the training texts.

The model: n-grams of one, two and three tokens with hierarchical Dirichlet smoothing,
p(w | a b) = (c(a b w) + PRIOR * p(w | b)) / (c(a b) + PRIOR), and so on down to
p(w) = (c(w) - DISCOUNT) / (N + DISCOUNT), of which all unknown words, as one, get what is left. As an
automaton: a state is a context (two words, one, none), an arc reads a word, adds its log-probability
and leads to the longest context that the words read so far end with; where a state has no arc for a
word, its failure arc adds log(PRIOR / (c + PRIOR)) and leads to the next shorter context. A text's
score is one walk from left to right.

All n-grams are counted, so the automaton of a corpus grows with it and is never gathered. Texts are
cut into blocks of tokens; each block counts its own n-grams once, sends them (sorted, as differences
of hashes) to the tasks of their ranges, and gets back how often each occurs in all training
texts. That is the part of the automaton that a walk over the block can enter: a context's weight
needs only its own count. The block builds that part and walks it. What is held at once is bounded by
the sizes of a block and a range, not by the corpus or a text: a text may span blocks, and the walk
goes on in the state that the two words before stand for.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, blocks, mixed, new_dir

#: What the shorter context's distribution weighs, in occurrences of a context.
PRIOR = 20.0
#: Taken from every word's count and given to words that were not seen.
DISCOUNT = 0.5
#: Tokens of a block (less than twice as many), and n-grams of a range.
BLOCK, RANGE = 1 << 19, 1 << 22
#: A pair or triple is taken for another in one of 2**ODDS cases at most: their hashes grow with the input, from 48 bits on.
ODDS = 20
#: What stands for the end and the start of a text among the hashes of words.
_END, _START = np.uint64(0x454E44), np.uint64(0x5354415254)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _packed(values: np.ndarray) -> bytes:
    """64-bit numbers, compressed: all first bytes, then all second ones, and so on."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _sorted_packed(values: np.ndarray) -> bytes:
    """Rising numbers, as differences."""
    return _packed(np.diff(values, prepend=np.uint64(0)))


def _sorted_unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data))


def _sequences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(the hashes of all texts' words, with the start before and the end after each text, tokens by text without the start)."""
    words = Words(texts)
    sizes = np.diff(words.first)
    starts = words.first[:-1] + 2 * np.arange(len(sizes))
    out = np.empty(int(words.first[-1]) + 2 * len(sizes), np.uint64)
    inside = np.ones(len(out), bool)
    inside[starts] = inside[starts + sizes + 1] = False
    out[inside], out[starts], out[starts + sizes + 1] = words.hashes(), _START, _END
    return out, sizes + 1


def _pieces(tokens: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, lead, tokens after the lead) of pieces of at most `most` tokens; the lead is the text's start, or the two tokens before."""
    count = -(-tokens // most)
    text = np.repeat(np.arange(len(tokens)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return text, np.where(number, 2, 1), np.minimum(most, tokens[text] - number * most)


def _in_blocks(rows: DataFrame, facts: str, most: int) -> DataFrame:
    """The rows as blocks, stored: (block, words: sorted hashes, ids: each token's place among them, both packed; pieces)."""
    path = new_dir(rows.sparkSession, "lm-blocks")
    names = [c for c in rows.columns if c not in ("text", "learn")]
    schema = f"block long, words binary, ids binary, pieces array<struct<uid: long, lead: int, size: int, learn: boolean, facts: {facts}>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = block = TaskContext.get().partitionId() << 40
        held: list[tuple[np.ndarray, pa.StructArray]] = []
        size = 0

        def row() -> pa.RecordBatch:
            words, ids = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            found = pa.concat_arrays([x for _, x in held])
            columns = [pa.array([block]), pa.array([_sorted_packed(words)]), pa.array([_packed(ids)]), pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), found)]
            return pa.RecordBatch.from_arrays(columns, ["block", "words", "ids", "pieces"])

        for batch, texts in blocks(batches, "text"):
            tokens, sizes = _sequences(texts)
            text, lead, own = _pieces(sizes, most)
            ends = np.cumsum(own) + text + 1  # in tokens, where each text has its start too
            first = lead == 1
            about = pa.StructArray.from_arrays([batch.column(c) for c in names], names).take(pa.array(text, mask=~first))
            learn = batch.column("learn").take(pa.array(text))
            found = pa.StructArray.from_arrays([pa.array(uid + text), pa.array(lead, pa.int32()), pa.array(own, pa.int32()), learn, about], ["uid", "lead", "size", "learn", "facts"])
            uid += len(texts)
            group = (size + np.cumsum(own) - own) // most
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(own)]
            for i, (a, b) in enumerate(zip(edges, edges[1:])):  # noqa: B905, RUF007
                if held and (i or group[0]):
                    yield row()
                    held, size, block = [], 0, block + 1
                held.append((np.concatenate([tokens[e - n - m : e] for e, n, m in zip(ends[a:b].tolist(), own[a:b].tolist(), lead[a:b].tolist(), strict=True)]), found.slice(a, b - a)))
                size += int(own[a:b].sum())
        if held:
            yield row()

    rows.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


class Block:
    """The tokens of some pieces, and their different words, pairs and triples in the order of their hashes."""

    def __init__(self, words: bytes, ids: bytes, lead: np.ndarray, size: np.ndarray, bits: int = 64):
        """bits: of the hashes of pairs and triples."""
        self.words, self.ids = _sorted_unpacked(words), _unpacked(ids).astype(np.int64)
        shift = np.uint64(64 - bits)
        self.ends = np.cumsum(lead + size)
        self.starts = self.ends - size  # after the lead
        place = np.arange(len(self.ids)) - np.repeat(self.ends - size - lead, lead + size)
        #: Whether a token is its piece's own.
        self.own = place >= np.repeat(lead, lead + size)
        hashes = self.words[self.ids]
        self.two, self.three = np.flatnonzero(place >= 1), np.flatnonzero(place >= 2)
        two = mixed(hashes[self.two - 1] * _STEP + hashes[self.two]) >> shift
        three = mixed(mixed(hashes[self.three - 2] * _STEP + hashes[self.three - 1]) * _STEP + hashes[self.three] + np.uint64(1)) >> shift
        self.pairs, at, of = np.unique(two, return_index=True, return_inverse=True)
        self.pair_at = np.zeros(len(self.ids), np.int64)
        self.pair_at[self.two] = of
        self.first_pair = self.two[at]
        self.triples, at, self.triple_of = np.unique(three, return_index=True, return_inverse=True)
        self.first_triple = self.three[at]

    def counts(self, learn: np.ndarray) -> list[np.ndarray]:
        """How often each word, pair and triple ends in one of the tokens that are learnt from."""
        of = ((self.ids, learn, self.words), (self.pair_at[self.two], learn[self.two], self.pairs), (self.triple_of, learn[self.three], self.triples))
        return [np.bincount(i[yes], minlength=len(keys)) for i, yes, keys in of]


def _floats(values: np.ndarray) -> array:
    return array("d", values.astype(np.float64).tobytes())


def _integers(values: np.ndarray) -> array:
    return array("q", values.astype(np.int64).tobytes())


class Automaton:
    """The states, arcs and failure arcs that a walk over a block can enter; c1, c2, c3: counts of its words, pairs and triples in all training texts; texts: how many those are."""

    def __init__(self, block: Block, c1: np.ndarray, c2: np.ndarray, c3: np.ndarray, total: int, distinct: int, texts: int, prior: float = PRIOR):
        b, n = block, len(block.words)
        self.width = n
        p1 = np.where(c1 > 0, c1 - DISCOUNT, DISCOUNT * (distinct + 1)) / (total + DISCOUNT)
        context = np.where(b.words == _START, texts, c1)  # how often a word is followed by another, or the end
        before, word = b.ids[b.first_pair - 1], b.ids[b.first_pair]
        p2 = (c2 + prior * p1[word]) / (context[before] + prior)
        longer, last = b.pair_at[b.first_triple - 1], b.pair_at[b.first_triple]
        p3 = (c3 + prior * p2[last]) / (c2[longer] + prior)
        # states: 0 no context, then those of words, then those of pairs
        self.back = _floats(np.log10(prior / (np.concatenate([[0], context, c2]) + prior)))
        self.fail = _integers(np.concatenate([[0], np.zeros(n, np.int64), 1 + word]))
        self.one, self.after_one = _floats(np.log10(p1)), _integers(np.where(context > 0, 1 + np.arange(n), 0))
        seen2, seen3 = np.flatnonzero(c2), np.flatnonzero(c3)
        keys = np.concatenate([(1 + before[seen2]) * n + word[seen2], (1 + n + longer[seen3]) * n + word[last[seen3]]])
        self.arcs = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.log = _floats(np.log10(np.concatenate([p2[seen2], p3[seen3]])))
        self.to = _integers(1 + n + np.concatenate([seen2, last[seen3]]))

    def walk(self, s: int, words: Sequence[int]) -> tuple[float, int]:
        """(log10 probability of the words from state s, the state after them)."""
        arcs, n, log, to, back, fail, one, after_one = self.arcs.get, self.width, self.log, self.to, self.back, self.fail, self.one, self.after_one
        total = 0.0
        for w in words:
            while s:
                arc = arcs(s * n + w)
                if arc is not None:
                    total += log[arc]
                    s = to[arc]
                    break
                total += back[s]
                s = fail[s]
            else:
                total += one[w]
                s = after_one[w]
        return total, s


def _ranges(keys: np.ndarray, of: int) -> np.ndarray:
    """The range of each hash, of so many of equal width."""
    return ((keys >> np.uint64(32)) * np.uint64(of) >> np.uint64(32)).astype(np.int64)


def _block_counts(stored: DataFrame, word_ranges: int, ranges: int, bits: int) -> DataFrame:
    """(range, block, keys, counts): of each block, its n-grams of each range. Ranges of words come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                of = lambda c: batch.column(c)[i]  # noqa: B023, E731
                lead, size, learn = (of(c).values.to_numpy(zero_copy_only=False) for c in ("lead", "size", "learn"))
                block = Block(of("words").as_py(), of("ids").as_py(), lead, size, bits)
                one, two, three = block.counts(block.own & np.repeat(learn, lead + size))
                keys, counts = np.concatenate([block.pairs, block.triples]), np.concatenate([two, three])
                order = np.argsort(keys, kind="stable")
                out: list[tuple[int, int, bytes, bytes]] = []
                for first, n, k, c, wide in ((0, word_ranges, block.words, one, 64), (word_ranges, ranges, keys[order], counts[order], bits)):
                    at = _ranges(k << np.uint64(64 - wide), n)
                    edges = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(k)]]).tolist()
                    out.extend((first + int(at[a]), of("block").as_py(), _sorted_packed(k[a:b]), _packed(c[a:b])) for a, b in zip(edges, edges[1:]))  # noqa: B905, RUF007
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["range", "block", "keys", "counts"])

    return stored.select("block", "words", "ids", "pieces.lead", "pieces.size", "pieces.learn").mapInArrow(run, "range int, block long, keys binary, counts binary")


def _totals(counted: DataFrame, word_ranges: int) -> DataFrame:
    """(block, range, totals, tokens, words), stored: for the n-grams of a block and range, in their order, the counts of all blocks.

    A row without a block carries a range's training tokens and how many different words they are.
    """
    path = new_dir(counted.sparkSession, "lm-totals")
    schema = "block long, range int, totals binary, tokens long, words long"

    def run(table: pa.Table) -> pa.Table:
        found = [_sorted_unpacked(x.as_py()) for x in table.column("keys")]
        keys = np.concatenate(found)
        counts = np.concatenate([_unpacked(x.as_py()) for x in table.column("counts")]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        new = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
        sums = np.add.reduceat(counts[order], new)
        totals = np.empty(len(keys), np.int64)
        totals[order] = np.repeat(sums, np.diff(np.append(new, len(keys))))
        edges = np.concatenate([[0], np.cumsum([len(x) for x in found])]).tolist()
        part = table.column("range")[0].as_py()
        rows = [(x, part, _packed(totals[a:b]), None, None) for x, a, b in zip(table.column("block").to_pylist(), edges, edges[1:], strict=False)]
        if part < word_ranges:
            rows.append((None, part, None, int(sums.sum()), int((sums > 0).sum())))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["block", "range", "totals", "tokens", "words"])

    counted.groupBy("range").applyInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return counted.sparkSession.read.schema(schema).parquet(path)


def _walked(stored: DataFrame, totals: DataFrame, facts: str, word_ranges: int, bits: int, n: int, v: int, texts: int, prior: float) -> DataFrame:
    """(uid, facts, n_tokens, known, base, score) of each piece."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pieces = left.column("pieces").combine_chunks().values
        lead, size = pieces.field("lead").to_numpy(), pieces.field("size").to_numpy()
        block = Block(left.column("words")[0].as_py(), left.column("ids")[0].as_py(), lead, size, bits)
        parts = sorted(zip(right.column("range").to_pylist(), right.column("totals").to_pylist(), strict=True))
        c1 = np.concatenate([_unpacked(x) for r, x in parts if r < word_ranges]).astype(np.int64)
        longer = np.concatenate([np.zeros(0, np.uint64), *(_unpacked(x) for r, x in parts if r >= word_ranges)]).astype(np.int64)
        keys = np.concatenate([block.pairs, block.triples])
        counts = np.empty(len(keys), np.int64)
        counts[np.argsort(keys, kind="stable")] = longer
        machine = Automaton(block, c1, counts[: len(block.pairs)], counts[len(block.pairs) :], n, v, texts, prior)
        ids, scores = block.ids.tolist(), []
        for start, end, before in zip(block.starts.tolist(), block.ends.tolist(), lead.tolist(), strict=True):
            s = machine.after_one[ids[start - 1]]
            if before == 2 and counts[block.pair_at[start - 1]]:
                s = 1 + machine.width + int(block.pair_at[start - 1])
            scores.append(machine.walk(s, ids[start:end])[0])
        edges = np.stack([block.starts, block.ends], axis=1).ravel()
        sums = lambda x: np.add.reduceat(np.append(x[block.ids], 0), edges)[::2]
        columns = [pieces.field("uid"), pieces.field("facts"), pa.array(size.astype(np.int64)), pa.array(sums((c1 > 0).astype(np.int64))), pa.array(sums(np.log10(c1 + 1.0))), pa.array(scores, pa.float64())]
        return pa.Table.from_arrays(columns, ["uid", "facts", "n_tokens", "known", "base", "score"])

    blocks_, found = stored.groupBy("block"), totals.where("block IS NOT NULL").select("block", "range", "totals").groupBy("block")
    return blocks_.cogroup(found).applyInArrow(run, f"uid long, facts {facts}, n_tokens long, known long, base double, score double")


def score(docs: DataFrame, train: Column, keep: Sequence[str] = (), doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, prior: float = PRIOR) -> DataFrame:
    """(doc_id, *keep, n_tokens, n_known, train_tokens, base_score, score): one row per row of docs.

    The model learns from the rows for which `train` holds (null: not). Tokens are the lower-cased (A-Z)
    words and the end of the text. base_score: sum of log10((c + 1) / (N + V + 1)) with c the token's
    count, N of all and V of distinct training tokens. score: the model's log10 probability of the text,
    in which all words that are not known are one. n_known: tokens with c > 0. Null and empty texts are
    one token (the end). Null and repeated doc_ids keep their rows. Texts longer than a block (in tokens)
    are walked in pieces. Without training rows every token is unknown: N and V are 0. An empty table
    gives no rows; columns other than those named are not read, and those of `keep` may have any name.
    Words are told apart by 64-bit hashes, n-grams by shorter ones (see ODDS). block: tokens; prior: see PRIOR.
    """
    spark = docs.sparkSession
    kept = [F.col(x).alias(f"kept{i}") for i, x in enumerate(keep)]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("learn"), *kept)
    facts = f"struct<{', '.join(f'{c}: {rows.schema[c].dataType.simpleString()}' for c in rows.columns if c not in ('text', 'learn'))}>"
    stored = _in_blocks(rows, facts, block)
    pieces = stored.select(F.explode(F.arrays_zip("pieces.lead", "pieces.size", "pieces.learn")).alias("p")).select("p.*")
    tokens, texts = pieces.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.when((F.col("lead") == 1) & F.col("learn"), 1))).first()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * tokens // RANGE))
    word_ranges = -(-ranges // 8)
    bits = min(64, max(48, (2 * tokens).bit_length() + ODDS))
    totals = _totals(_block_counts(stored, word_ranges, ranges, bits), word_ranges)
    n, v = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    walked = _walked(stored, totals, facts, word_ranges, bits, n, v, texts, prior)
    sums = walked.groupBy("uid").agg(F.first("facts", ignorenulls=True).alias("facts"), *(F.sum(c).alias(c) for c in ("n_tokens", "known", "base", "score")))
    return sums.select(
        "facts.doc_id",
        *(F.col(f"facts.kept{i}").alias(x) for i, x in enumerate(keep)),
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"),
        "score",
    )
