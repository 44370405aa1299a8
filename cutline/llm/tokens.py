"""Token ids of whole texts by a tokenizer file, encoding each distinct piece of text once per worker."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np

from .common import runs_hashed

#: Pieces whose ids a worker remembers (some 40 MB), the longest that it does, and how many are encoded in one string.
REMEMBERED, LONGEST, TOGETHER = 1_000_000, 200, 256
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\x0b\x0c\r")] = True
_PLAIN, _MARKS = np.zeros(256, bool), np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARKS[[x for x in range(33, 127) if not _PLAIN[x] and chr(x) not in "'<|>"]] = True
#: White space to a tokenizer, but not among the blanks above: such texts are encoded in one piece.
_OTHER = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CONTROLS = re.compile(rb"[\x1c-\x1f]")
_encoders: dict[tuple[int, bool], Callable] = {}


def read_tokenizer(path: str) -> str:
    """The content of a tokenizer file, to be sent to the workers (a vocabulary: its size doesn't grow with the data)."""
    return Path(path).read_text(encoding="utf-8")


def _odd(text: bytes) -> bool:
    return bool(_CONTROLS.search(text) if text.isascii() else _OTHER.search(text.decode()))


class _Known:
    """The ids of pieces by (hash, bytes) of the piece: a hash table in arrays, probed for many pieces at once."""

    def __init__(self):
        self.size = 1 << (2 * REMEMBERED - 1).bit_length()
        self.clear()

    def clear(self) -> None:
        self.keys, self.at = np.zeros(self.size, np.uint64), np.full(self.size, -1, np.int32)
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0
        self.start, self.length, self.bytes, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def find(self, keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 for those that are not known."""
        out = np.full(len(keys), -1, np.int64)
        slot, left = (keys & np.uint64(self.size - 1)).astype(np.int64), np.arange(len(keys))
        while len(left):
            number = self.at[slot]
            same = (self.keys[slot] == keys[left]) & (number >= 0)
            same[same] = self.bytes[number[same]] == sizes[left[same]]
            out[left[same]] = number[same]
            on = ~same & (number >= 0)
            left, slot = left[on], (slot[on] + 1) & (self.size - 1)
        return out

    def add(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Distinct pieces that are not known, with their ids one after the other."""
        n = len(keys)
        for name, need, have in (("ids", self.used + len(ids), len(self.ids)), *((x, self.count + n, len(self.start)) for x in ("start", "length", "bytes"))):
            if need > have:
                setattr(self, name, np.resize(getattr(self, name), max(need, 2 * have)))
        self.ids[self.used : self.used + len(ids)] = ids
        here = slice(self.count, self.count + n)
        self.length[here], self.bytes[here] = lengths, sizes
        self.start[here] = self.used + np.cumsum(lengths) - lengths
        slot, left = (keys & np.uint64(self.size - 1)).astype(np.int64), np.arange(n)
        while len(left):
            free = self.at[slot] < 0
            _, first = np.unique(slot[free], return_index=True)  # of several pieces for one place the first gets it
            take = np.flatnonzero(free)[first]
            self.keys[slot[take]], self.at[slot[take]] = keys[left[take]], self.count + left[take]
            on = np.ones(len(left), bool)
            on[take] = False
            left, slot = left[on], (slot[on] + 1) & (self.size - 1)
        self.used, self.count = self.used + len(ids), self.count + n


def _gathered(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[start:start + length] of each, put together."""
    ends = np.cumsum(length)
    return flat[np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]


def encoder(content: str, blanks_matter: bool) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]:
    """A function from texts (UTF-8) to their ids without special tokens: (ids of all, one text after the other; number of each text's).

    A byte-level tokenizer's tokens end where white space begins, and one that drops white space never
    joins across it: so a text is cut there (blanks_matter: white space stays with what follows; else
    letters are lower-cased, as such a tokenizer does), and where ASCII punctuation (no apostrophe, no sign of a special token)
    follows an ASCII letter or digit, which no pattern of such tokenizers joins; the pieces' ids are put
    together. Texts with other white space than ASCII's are encoded whole. New pieces are encoded several
    in one string. Pieces are known by a 64-bit hash and their size.
    """
    key = (hash(content), blanks_matter)
    if key in _encoders:
        return _encoders[key]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
    from tokenizers import Tokenizer

    tokenizer, model = Tokenizer.from_str(content), json.loads(content)
    special = model["added_tokens"][0]
    between, mark = special["content"], special["id"]
    suffix = model["model"].get("end_of_word_suffix") or ""
    width = np.zeros(tokenizer.get_vocab_size(), np.int64)  # bytes of text that a token stands for
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        width[i] = len(token.removesuffix(suffix))
    known = _Known()

    def ids_of(strings: list[str], end: Sequence[int] = ()) -> list[np.ndarray]:
        return [np.array([*x.ids, *end], np.uint32) for x in tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def whole(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = ids_of([t.decode() for t in texts])
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.fromiter(map(len, found), np.int64, len(found))

    def separated(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of pieces without special tokens, with one between any two: the tokenizer splits there before it does anything else."""
        flat = np.concatenate(ids_of([between.encode().join(pieces[i : i + TOGETHER]).decode() for i in range(0, len(pieces), TOGETHER)], (mark,)))
        return flat[flat != mark], np.diff(np.flatnonzero(flat == mark), prepend=-1) - 1

    def joined(pieces: list[bytes], sizes: np.ndarray, glue: bytes, glue_size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(which pieces, their ids, number of each one's): put together with glue and told apart by the bytes that the tokens stand for; where those don't add up, with special tokens."""
        first = np.arange(0, len(pieces), TOGETHER)
        found = ids_of([glue.join(pieces[i : i + TOGETHER]).decode() for i in first.tolist()])
        ends = np.cumsum(sizes + glue_size)
        ends -= np.repeat(np.arange(len(first)), np.diff(np.append(first, len(pieces)))) * glue_size + glue_size  # none after a string's last
        flat = np.concatenate(found)
        bytes_ = np.cumsum(width[flat])
        of = np.cumsum([len(x) for x in found])
        sound = np.array_equal(bytes_[of - 1], ends[np.append(first[1:], len(pieces)) - 1])
        at = np.searchsorted(bytes_, ends)
        if not sound or not np.array_equal(bytes_[np.minimum(at, len(flat) - 1)], ends):
            if len(first) > 1:
                for i in first.tolist():
                    yield from ((i + w, *x) for w, *x in joined(pieces[i : i + TOGETHER], sizes[i : i + TOGETHER], glue, glue_size))
            else:
                yield np.arange(len(pieces)), *separated(pieces)
            return
        lengths = np.diff(at, prepend=-1)
        if glue_size:
            last = np.zeros(len(pieces), bool)
            last[np.append(first[1:], len(pieces)) - 1] = True
            glued = at[~last] + 1
            lengths[1:] -= ~last[:-1]
            flat = np.delete(flat, glued)
        yield np.arange(len(pieces)), flat, lengths

    def learn(data: bytes, keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        pieces = [data[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        buffer, sizes = np.frombuffer(data, np.uint8), end - start
        odd = np.fromiter((b"<|" in p for p in pieces), bool, len(pieces))
        if blanks_matter:
            blank_end = _BLANK[buffer[end - 1]]
            leads = _BLANK[buffer[start]] & ~blank_end & ~odd
            kinds = [(leads, b"", 0), (~leads & ~blank_end & ~odd, b"\n", 1), (odd | blank_end, None, 0)]
            lengths = sizes
        else:
            kinds = [(~odd, b" ", 0), (odd, None, 0)]
            lengths = np.fromiter((n if p.isascii() else len(unicodedata.normalize("NFC", p.decode()).lower().encode()) for p, n in zip(pieces, sizes.tolist(), strict=True)), np.int64, len(pieces))
        for of, glue, glue_size in kinds:
            which = np.flatnonzero(of)
            if glue is None and len(which):
                known.add(keys[which], sizes[which], *whole([pieces[i] for i in which.tolist()]))
            elif len(which):
                for got, ids, counts in joined([pieces[i] for i in which.tolist()], lengths[which], glue, glue_size):
                    known.add(keys[which[got]], sizes[which[got]], ids, counts)

    def lowered(text: bytes) -> bytes:
        # a letter and a combining mark after it may be one character in lower case only
        return text if blanks_matter or b"\xcc" in text or b"\xcd" in text or b"<|" in text else text.lower()

    def cut(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """(all texts put together, starts and ends of the pieces, number of pieces by text)."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        data, edges = b"".join(texts), np.concatenate([[0], np.cumsum(sizes)])
        buffer = np.frombuffer(data, np.uint8)
        blank = _BLANK[buffer]
        border = np.zeros(len(data) + 1, bool)
        border[1:-1] = _MARKS[buffer[1:]] & _PLAIN[buffer[:-1]]
        border[edges] = True
        if blanks_matter:
            border[1:-1] |= blank[1:] & ~blank[:-1]
            at = np.flatnonzero(border)
            start, end = at[:-1], at[1:]
        else:
            inside = np.concatenate([[False], ~blank, [False]])
            start = np.flatnonzero(inside[1:] & (~inside[:-1] | border))
            end = np.flatnonzero(inside[:-1] & (~inside[1:] | border))
        return data, start, end, np.diff(np.searchsorted(start, edges))

    def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        odd = np.fromiter(map(_odd, texts), bool, len(texts))
        data, start, end, pieces = cut([b"" if o else lowered(t) for t, o in zip(texts, odd.tolist(), strict=True)])
        sizes = end - start
        keys = runs_hashed(np.frombuffer(data, np.uint8))(start, end)
        short = sizes <= LONGEST
        number = np.where(short, 0, -1)
        number[short] = known.find(keys[short], sizes[short])
        new = np.flatnonzero(short & (number < 0))
        if len(new):
            _, first = np.unique(keys[new], return_index=True)
            if known.count + len(first) > REMEMBERED:
                known.clear()
                new = np.flatnonzero(short)
                _, first = np.unique(keys[new], return_index=True)
            learn(data, keys[new[first]], start[new[first]], end[new[first]])
            number[new] = known.find(keys[new], sizes[new])
        length = np.where(short, known.length[number], 0)
        flat, at = known.ids, np.where(short, known.start[number], 0)
        rest = np.flatnonzero(~short)
        if len(rest) or odd.any():  # what is not remembered follows the known ids for this once
            ids, lengths = whole([data[start[i] : end[i]] for i in rest.tolist()])
            more, counts = whole([t for t, o in zip(texts, odd.tolist(), strict=True) if o])
            at[rest], length[rest] = known.used + np.cumsum(lengths) - lengths, lengths
            where = np.cumsum(pieces)[odd]
            at, length = np.insert(at, where, known.used + len(ids) + np.cumsum(counts) - counts), np.insert(length, where, counts)
            pieces = pieces + odd
            flat = np.concatenate([known.ids[: known.used], ids, more])
        edges = np.concatenate([[0], np.cumsum(pieces)])
        total = np.concatenate([[0], np.cumsum(length)])
        return _gathered(flat, at, length), total[edges[1:]] - total[edges[:-1]]

    _encoders[key] = encode
    return encode
