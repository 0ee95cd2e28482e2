"""Byte-level pre-tokenisation and word-wise encoding of many texts at once, in numpy.

Texts are laid end to end as one array of code points. Where one word ends and the next begins depends
on the classes of neighbouring characters only, so all boundaries of a batch are found by comparing
shifted arrays. Each distinct word is encoded once and kept; a text's ids are then gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import repeat

import numpy as np

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = 0, 1, 2, 3, 255
SUFFIXES_1 = (ord("s"), ord("t"), ord("m"), ord("d"))
SUFFIXES_2 = ((ord("r"), ord("e")), (ord("v"), ord("e")), (ord("l"), ord("l")))
APOSTROPHE, BLANK = ord("'"), ord(" ")
#: Longer words are told apart one by one.
LONG = 64


class CharClasses:
    """Class of each code point, asked of the tokenizers library once for each that occurs."""

    def __init__(self) -> None:
        from tokenizers.pre_tokenizers import ByteLevel

        self._split = ByteLevel(add_prefix_space=False).pre_tokenize_str
        self._table = np.full(0x110000, UNKNOWN, np.uint8)

    def _ask(self, char: str) -> int:
        for probe, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
            if len(self._split(probe + char)) == 1:
                return kind
        return SPACE

    def of(self, points: np.ndarray) -> np.ndarray:
        kinds = self._table[points]
        if (kinds == UNKNOWN).any():
            for p in np.unique(points[kinds == UNKNOWN]):
                self._table[p] = self._ask(chr(p))
            kinds = self._table[points]
        return kinds


def word_starts(points: np.ndarray, kinds: np.ndarray, hard: np.ndarray) -> np.ndarray:
    """Whether a word starts at each code point. hard: the first code point of each text."""
    n = len(points)
    space = kinds == SPACE
    start = hard.copy()
    before, here = kinds[:-1], kinds[1:]
    # Between words of two kinds; a single blank goes with the word after it.
    start[1:] |= (before != here) & (points[:-1] != BLANK)
    start[1:] |= ~space[:-1] & space[1:]
    # The last of several spaces stands apart from the others if a word follows.
    follows = np.zeros(n, bool)
    follows[:-1] = ~space[1:] & ~hard[1:]
    start |= space & follows
    _split_suffixes(points, start, hard)
    return start


def _split_suffixes(points: np.ndarray, start: np.ndarray, hard: np.ndarray) -> None:
    """'s, 't, 're, 've, 'm, 'll and 'd are words of their own where an apostrophe starts a word."""
    n = len(points)
    at = np.flatnonzero((points == APOSTROPHE) & start)
    if not len(at):
        return

    def char(i: np.ndarray, crossed: np.ndarray) -> np.ndarray:
        inside = (i < n) & ~crossed
        return np.where(inside, points[np.minimum(i, n - 1)], 0)

    next_hard = lambda i: hard[np.minimum(i, n - 1)] & (i < n)
    crossed_1 = next_hard(at + 1)
    one = char(at + 1, crossed_1)
    two = char(at + 2, crossed_1 | next_hard(at + 2))
    short = np.isin(one, SUFFIXES_1)
    long = np.zeros(len(at), bool)
    for a, b in SUFFIXES_2:
        long |= (one == a) & (two == b)
    length = np.where(short, 2, np.where(long, 3, 0))
    at, length = at[length > 0], length[length > 0]
    start[at + 1] = False
    end = at + length
    start[end[end < n]] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def distinct(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct words among data[start:start+length], and the index of each word among them."""
    buf = np.frombuffer(data + bytes(8), np.uint8)
    eights = np.lib.stride_tricks.as_strided(buf, (len(buf) - 7, 8), (1, 1))
    short = lengths <= LONG
    loads = []
    h = lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(0, LONG, 8):
        pick = np.flatnonzero(short & (lengths > k))
        if not len(pick):
            break
        word = eights[starts[pick] + k].view("<u8").ravel()
        left = np.minimum(lengths[pick] - k, 8).astype(np.uint64)
        word = word & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))
        h[pick] = _mixed(h[pick] ^ word)
        loads.append((pick, word))
    order = np.flatnonzero(short)
    _, first, inverse = np.unique(h[order], return_index=True, return_inverse=True)
    rep = np.zeros(len(h), np.int64)
    rep[order] = order[first][inverse]
    same = (lengths[rep] == lengths) | ~short
    for pick, word in loads:
        full = np.zeros(len(h), np.uint64)
        full[pick] = word
        same &= (full[rep] == full) | ~short
    index = np.zeros(len(h), np.int64)
    index[order] = inverse
    at = order[first]
    words = [data[s : s + n] for s, n in zip(starts[at].tolist(), lengths[at].tolist(), strict=True)]
    odd = np.flatnonzero(~short | ~same)  # long words, and any that share a hash with another word
    extra: dict[bytes, int] = {}
    for i in odd.tolist():
        word = data[starts[i] : starts[i] + lengths[i]]
        index[i] = extra.setdefault(word, len(words) + len(extra))
    return words + list(extra), index


def gather(values: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[o:o+n] for each offset o and length n, laid end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(offsets - (ends - lengths), lengths) + np.arange(total)]


class TextEncoder:
    """Ids of whole texts by a function that encodes a list of words.

    words_to_ids(words) returns the ids of all words laid end to end and the number of ids of each.
    Words met before are kept, up to about `keep` of them; then those that were met once only go. special:
    strings that are a word of their own wherever they occur.
    """

    def __init__(self, words_to_ids: Callable, special: Sequence[str] = (), keep: int = 300_000, chunk_chars: int = 400_000) -> None:
        self._words_to_ids, self._special, self._keep, self._chunk = words_to_ids, tuple(special), keep, chunk_chars
        self._classes = CharClasses()
        self._index: dict[bytes, int] = {}
        self._flat = np.zeros(0, np.int32)
        self._offsets, self._lengths, self._met = (np.zeros(0, np.int64) for _ in range(3))

    def _segments(self, text: str) -> list[str]:
        """The text cut at special strings, and into chunks at a blank after a word, where a word ends anyway."""
        parts = [text]
        for s in self._special:
            if s in text:
                parts = [y for x in parts for y in ([x] if x in self._special else _cut(x, s))]
        out = []
        for part in parts:
            at = 0
            while len(part) - at > 2 * self._chunk:
                cut = part.find(" ", at + self._chunk)
                while cut > 0 and self._classes.of(np.array([ord(part[cut - 1])]))[0] == SPACE:
                    cut = part.find(" ", cut + 1)
                if cut < 0:
                    break
                out.append(part[at:cut])
                at = cut
            out.append(part[at:])
        return [x for x in out if x]

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts laid end to end, and the number of ids of each text."""
        ids, counts = [], np.zeros(len(texts), np.int64)
        batch, owner, size = [], [], 0
        for k, text in enumerate(texts):
            for part in self._segments(text):
                batch.append(part)
                owner.append(k)
                size += len(part)
                if size >= self._chunk:
                    ids.append(self._encode(batch, np.array(owner), counts))
                    batch, owner, size = [], [], 0
        if batch:
            ids.append(self._encode(batch, np.array(owner), counts))
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), counts

    def _encode(self, parts: list[str], owner: np.ndarray, counts: np.ndarray) -> np.ndarray:
        joined = "".join(parts)
        data = joined.encode()
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        first = np.zeros(len(parts), np.int64)
        np.cumsum([len(p) for p in parts[:-1]], out=first[1:])
        hard = np.zeros(len(points), bool)
        hard[first] = True
        start = word_starts(points, self._classes.of(points), hard)
        for k, part in enumerate(parts):
            if part in self._special:
                start[first[k] + 1 : first[k] + len(part)] = False
        at = np.flatnonzero(start)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        place = np.cumsum(width) - width
        starts = place[at]
        lengths = np.diff(starts, append=len(data))
        words, index = distinct(data, starts, lengths)
        slots = self._slots(words)[index]
        n = self._lengths[slots]
        part_of = np.searchsorted(first, at, "right") - 1
        counts += np.bincount(owner[part_of], n, len(counts)).astype(np.int64)
        return gather(self._flat, self._offsets[slots], n)

    def _slots(self, words: list[bytes]) -> np.ndarray:
        if len(self._index) > self._keep:
            self._forget()
        known = self._index
        slots = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(slots < 0)
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            slots[new] = np.arange(len(known), len(known) + len(fresh))
            ids, lengths = self._words_to_ids(fresh)
            known.update(zip(fresh, slots[new].tolist(), strict=True))
            self._offsets = np.concatenate([self._offsets, len(self._flat) + np.cumsum(lengths) - lengths])
            self._flat = np.concatenate([self._flat, ids.astype(np.int32)])
            self._lengths = np.concatenate([self._lengths, lengths.astype(np.int64)])
            self._met = np.concatenate([self._met, np.zeros(len(fresh), np.int64)])
        self._met[slots] += 1
        return slots

    def _forget(self) -> None:
        """Keeps the words met in several calls, if they are few enough to leave room for others."""
        stays = self._met > 1
        if stays.sum() > self._keep * 2 // 3:
            stays[:] = False
        words = [w for w, s in zip(self._index, stays.tolist(), strict=True) if s]  # in the order of their slots
        self._index = dict(zip(words, range(len(words)), strict=True))
        self._flat = gather(self._flat, self._offsets[stays], self._lengths[stays])
        self._lengths = self._lengths[stays]
        self._offsets = np.cumsum(self._lengths) - self._lengths
        self._met = np.ones(len(words), np.int64)


def _cut(text: str, special: str) -> list[str]:
    pieces = text.split(special)
    out = []
    for p in pieces[:-1]:
        out += [p, special]
    return out + pieces[-1:]
