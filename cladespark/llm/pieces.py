"""Byte-level BPE over whole Arrow batches: vectorised pre-splitting, one merge run for each distinct word.

The public pattern of byte-level BPE (``public_tokenizers.PATTERN``) never lets a merge cross a match, so a text's ids are
its matches' ids in turn. Matches are found for a whole batch with array operations on code points, every distinct match is
encoded once by the tokenizer library, and ids are gathered. Words are found again by a 64-bit polynomial hash, and each
reuse is compared with the word's code points, so a collision cannot change a result.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd

OTHER, LETTER, NUMBER, SPACE, END = 0, 1, 2, 3, 4
#: The code points of White_Space.
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: A text longer than this is cut before a lone blank between two words; no match spans such a place.
SEGMENT = 1 << 18
#: Words that the dictionary of a coder holds before they settle.
YOUNG = 1 << 16
SAFE = re.compile(r"(?<=\S) (?=\S)")


@functools.cache
def classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of every code point, and whether all Unicode versions since 3.2 agree on it (libraries differ in version)."""
    kind = np.zeros(0x110000, np.uint8)
    firm = np.zeros(0x110000, bool)
    old, now = unicodedata.ucd_3_2_0.category, unicodedata.category
    code = {"L": LETTER, "N": NUMBER}
    for c in range(0x110000):
        x = chr(c)
        kind[c] = code.get(now(x)[0], OTHER)
        was = old(x)
        firm[c] = was != "Cn" and code.get(was[0], OTHER) == kind[c]
    kind[WHITE] = SPACE
    firm[[0x180E, 0x200B]] = False
    return kind, firm


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least ``n``; held for the next call unless they are many."""
    return few_powers(max(n, 1 << 18)) if n <= 1 << 20 else few_powers.__wrapped__(n)


@functools.cache
def few_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    out = []
    for x in (base, pow(base, -1, 2**64)):
        row = np.full(n, x, np.uint64)
        row[0] = 1
        out.append(np.cumprod(row, dtype=np.uint64))
    return out[0], out[1]


def starts(cp: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where matches of the pattern start and end; ``ends``: positions of the separators that close each text."""
    kind = classes()[0][cp]
    kind[ends] = END
    at = np.empty(len(cp), bool)
    at[0] = True
    np.not_equal(kind[1:], kind[:-1], out=at[1:])
    at[ends] = True
    # a run of white space before a word leaves its last character out; a blank there joins the word
    gap = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] < SPACE))
    at[gap] = True
    at[gap[cp[gap] == 32] + 1] = False
    # contractions, where a match starts with the apostrophe
    mark = np.flatnonzero(cp == 39)
    mark = mark[at[mark]]
    mark = mark[kind[mark + 1] == LETTER]
    if len(mark):
        x, y = cp[mark + 1], cp[np.minimum(mark + 2, len(cp) - 1)]
        one = mark[np.isin(x, [ord(c) for c in "stmd"])]
        two = mark[((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))]
        at[one + 1] = False
        at[one + 2] = True
        at[two + 1] = False
        at[two + 3] = True
    s = np.flatnonzero(at)
    e = np.append(s[1:], len(cp))
    words = kind[s] != END
    return s[words], e[words]


class PieceCoder:
    """Encodes lists of texts. ``words``: ids of each of a list of pattern matches; ``whole``: ids of any text; ``special``:
    strings that ``whole`` treats apart, if any. At most ``limit`` distinct words are held at a time,
    and about 32 times as many code points of them; beyond that only the words stay that were met again since the last time."""

    def __init__(self, words: Callable[[list[str]], list[list[int]]], whole: Callable[[str], list[int]], special: tuple[str, ...] = (), limit: int = 300_000) -> None:
        self.words, self.whole, self.special, self.limit = words, whole, special, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[int, int] = {}  # rows of the words seen last, by hash
        self.sorted, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # the others
        self.count = 0
        self.used = np.zeros(2, np.int64)  # of ids, of code points
        self.ids, self.cps = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.uint32)
        self.place = np.zeros((4, 1 << 12), np.int32)  # id start, ids, code point start, code points
        self.again = np.zeros(1 << 12, bool)  # words that were met again

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, in order; null counts as empty."""
        firm = classes()[1]
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        batch: list[tuple[int, str]] = []
        size = 0
        for i, text in enumerate(texts):
            for x in segments(text or ""):
                if any(s in x for s in self.special) or not (x.isascii() or firm[np.frombuffer(x.encode("utf-32-le"), np.uint32)].all()):
                    batch, size = self.flush(batch, parts), 0
                    parts[i].append(np.asarray(self.whole(x), np.uint32))
                    continue
                batch.append((i, x))
                size += len(x) + 1
                if size >= SEGMENT:
                    batch, size = self.flush(batch, parts), 0
        self.flush(batch, parts)
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, np.uint32) for x in parts]

    def flush(self, batch: list[tuple[int, str]], parts: list[list[np.ndarray]]) -> list:
        if not batch:
            return []
        joined = "\0".join(x for _, x in batch) + "\0"
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lens = np.fromiter((len(x) for _, x in batch), np.int64, len(batch))
        ends = np.cumsum(lens + 1) - 1
        s, e = starts(cp, ends)
        n = 1 << int(len(cp)).bit_length()
        up, down = powers(n)
        total = np.empty(len(cp) + 1, np.uint64)
        total[0] = 0
        np.cumsum((cp + np.uint64(1)) * up[: len(cp)], out=total[1:])
        code, keys = pd.factorize((total[e] - total[s]) * down[s])
        first = np.empty(len(keys), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        if self.count + len(keys) > self.limit or self.used[1] > 32 * self.limit:
            self.thin()
        known = self.find(keys)
        self.again[known[known >= 0]] = True
        new = np.flatnonzero(known < 0)
        if len(new):
            a, b = s[first[new]].tolist(), e[first[new]].tolist()
            known[new] = self.add(keys[new].tolist(), [joined[i:j] for i, j in zip(a, b, strict=True)])
        word = known[code]
        if not np.array_equal(gather(self.cps, self.place[2][word], self.place[3][word]), np.delete(cp, ends)):
            for i, x in batch:  # two words share a hash
                parts[i].append(np.asarray(self.whole(x), np.uint32))
            return []
        count = self.place[1][word]
        ids = gather(self.ids, self.place[0][word], count)
        upto = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(s, np.concatenate([[0], ends]))].tolist()
        for (i, _), a, b in zip(batch, upto, upto[1:], strict=False):
            parts[i].append(ids[a:b])
        return []

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each hash, or -1."""
        known = np.full(len(keys), -1, np.int64)
        if len(self.sorted):
            order = np.argsort(keys)
            at = np.empty(len(keys), np.int64)
            at[order] = np.searchsorted(self.sorted[:-1], keys[order])  # in order, as near hashes lie near in memory
            known = np.where(self.sorted[at] == keys, self.rows[at], known)
        rest = np.flatnonzero(known < 0)
        get = self.index.get
        known[rest] = np.fromiter((get(k, -1) for k in keys[rest].tolist()), np.int64, len(rest))
        return known

    def thin(self) -> None:
        """Keeps the words that were met again, if they leave room; else none."""
        self.settle()
        kept = np.flatnonzero(self.again[: self.count])
        ids, cps, place = self.ids, self.cps, self.place[:, kept]
        keys, rows = self.sorted, self.rows
        self.clear()
        if 2 * len(kept) > self.limit or 2 * place[3].sum(dtype=np.int64) > 32 * self.limit:
            return
        number = np.full(len(rows), -1, np.int32)
        number[kept] = np.arange(len(kept), dtype=np.int32)
        stay = number[rows] >= 0
        self.sorted, self.rows = keys[stay], number[rows[stay]]
        self.count = len(kept)
        for k, (name, flat) in enumerate((("ids", ids), ("cps", cps))):
            at, n = place[2 * k], place[2 * k + 1]
            held = gather(flat, at, n)
            place[2 * k] = np.cumsum(n) - n
            self.used[k] = len(held)
            setattr(self, name, np.concatenate([held, np.zeros(1 << 16, np.uint32)]))
        self.place = np.concatenate([place, np.zeros((4, 1 << 12), np.int32)], axis=1)
        self.again = np.zeros(self.place.shape[1], bool)

    def settle(self) -> None:
        """Moves the words seen last to the sorted arrays, which take 12 bytes a word where the dictionary takes over 100."""
        n = len(self.index)
        keys = np.concatenate([self.sorted, np.fromiter(self.index.keys(), np.uint64, n)])
        rows = np.concatenate([self.rows, np.fromiter(self.index.values(), np.int32, n)])
        order = np.argsort(keys, kind="stable")
        self.sorted, self.rows = keys[order], rows[order]
        self.index = {}

    def add(self, keys: list[int], words: list[str]) -> np.ndarray:
        ids = self.words(words)
        n, at = np.fromiter(map(len, ids), np.int64, len(ids)), self.count
        flat = np.fromiter((x for row in ids for x in row), np.uint32, int(n.sum()))
        m = np.fromiter(map(len, words), np.int64, len(words))
        cps = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        while self.place.shape[1] < at + len(ids):
            self.place = np.concatenate([self.place, np.zeros_like(self.place)], axis=1)
            self.again = np.concatenate([self.again, np.zeros_like(self.again)])
        for k, (length, row) in enumerate(((n, flat), (m, cps))):
            name = ("ids", "cps")[k]
            while len(getattr(self, name)) < self.used[k] + len(row):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros_like(getattr(self, name))]))
            getattr(self, name)[self.used[k] : self.used[k] + len(row)] = row
            self.place[2 * k, at : at + len(ids)] = self.used[k] + np.cumsum(length) - length
            self.place[2 * k + 1, at : at + len(ids)] = length
            self.used[k] += len(row)
        got = np.arange(at, at + len(ids))
        self.index.update(zip(keys, got.tolist(), strict=True))
        self.count += len(got)
        if len(self.index) > YOUNG:
            self.settle()
        return got


def gather(flat: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """flat[at[0]:at[0]+n[0]], flat[at[1]:at[1]+n[1]], ... in one array."""
    end = np.cumsum(n)
    where = np.repeat(at - (end - n), n)
    where += np.arange(len(where))
    return flat[where]


def segments(text: str) -> list[str]:
    """A long text in parts that no match of the pattern spans; the parts joined are the text."""
    out, at = [], 0
    while len(text) - at > SEGMENT and (m := SAFE.search(text, at + SEGMENT // 2)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]] if at else [text]


@functools.cache
def from_json(path: str) -> PieceCoder:
    """By the tokenizers library and a tokenizer file with the byte-level pattern."""
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    t = Tokenizer.from_file(path)
    special = tuple(x.content for x in t.get_added_tokens_decoder().values())
    return PieceCoder(
        lambda words: [e.ids for i in range(0, len(words), 2048) for e in t.encode_batch_fast(words[i : i + 2048], add_special_tokens=False)],
        lambda text: t.encode(text, add_special_tokens=False).ids,
        special,
    )


@functools.cache
def encoding(path: str):
    """A tiktoken encoding over a local rank file, without special tokens."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def from_ranks(path: str) -> PieceCoder:
    """By the tiktoken library and a local rank file."""
    e = encoding(path)
    return PieceCoder(lambda words: [e.encode_ordinary(w) for w in words], e.encode_ordinary)
