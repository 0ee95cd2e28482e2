"""SentencePiece encoding and decoding of BPE models with byte fallback, by a table of each prefix's last token.

The ids of a text's prefix are those of a shorter prefix and one token more, and that last token is the only
one that ends there and is compatible with the last token before it: merging the two texts together gives
the two tokens again. So an automaton's matches are gone through from left to right, each compatible match
stands in the table at its end, and the ids are read off the table backwards. The work grows with the
length of a word, however long it is.

Null text counts as empty; an empty text has the begin and end ids only. Rows of equal id and null ids pass
through; further columns are left out unless asked for. Text is cut where no piece of the vocabulary can
reach across, so each distinct word is worked out once and kept while there is room.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundloom.llm.batches import pieces
from groundloom.llm.pretokens import gather

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Words kept, and the length above which a word isn't kept.
KEEP, LONG = 200_000, 64
#: Pairs of tokens of known compatibility that are kept.
KEEP_PAIRS = 2_000_000
NEVER = 1 << 60


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


def _replaced(e: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (e.end - e.start), e.end


codecs.register_error("each-byte-replaced", _replaced)


class PieceModel:
    """A BPE model file: its tokens, which of them are compatible neighbours, and the words worked out so far."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            message = list(_fields(f.read()))
        trainer, normalizer = (dict(_fields(next((v for n, v in message if n == k), b""))) for k in (2, 3))
        given = [{1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(v)) for n, v in message if n == 1]
        kinds = [p[3] for p in given]
        if trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24) or normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1) or {*kinds} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models with byte fallback, a leading blank and otherwise unchanged text are read")
        names = [p[1].decode() for p in given]
        self.begin, self.end = names.index("<s>"), names.index("</s>")
        self._of_byte = {int(n[3:5], 16): i for i, (n, k) in enumerate(zip(names, kinds, strict=True)) if k == BYTE}
        self._read_tokens({n: (i, struct.unpack("<f", p[2])[0]) for i, (n, k, p) in enumerate(zip(names, kinds, given, strict=True)) if k == NORMAL})
        self._read_surfaces(names, kinds)
        self._pairs: dict[int, bool] = {}
        self._words: dict[str, bytes] = {}

    def _read_tokens(self, scored: dict[str, tuple[int, float]]) -> None:
        """Tokens in the order of merging, with their last merge; characters come first and merge from nothing."""
        import ahocorasick

        chars = {c for name in scored for c in name}
        ranks = {s: k for k, s in enumerate(sorted({s for n, (_, s) in scored.items() if len(n) > 1}, reverse=True))}
        self._merge_rank = {n: ranks[s] for n, (_, s) in scored.items() if len(n) > 1}
        self._token = {n: t for t, n in enumerate([*sorted(chars), *(n for n in self._merge_rank)])}
        names = [*self._token]
        self._names, self._lengths = names, [len(n) for n in names]
        self._rank = [self._merge_rank.get(n, -1) for n in names]
        self._ids = [struct.pack("<I", scored[n][0]) if n in scored else self._bytes_of(n) for n in names]
        self._left, self._right = [*range(len(names))], [*range(len(names))]
        self._plain = [True] * len(names)
        automaton = ahocorasick.Automaton()
        for t, name in sorted(enumerate(names), key=lambda x: len(x[1])):
            if len(name) > 1:
                parts = self.merged(name, self._merge_rank[name], whole=False)
                if len(parts) != 2:
                    continue  # never comes out of merging
                a, b = self._left[t], self._right[t] = [self._token[p] for p in parts]
                # Undoing merges from the last one on needs parts made before the whole.
                self._plain[t] = self._plain[a] and self._plain[b] and max(self._rank[a], self._rank[b]) <= self._rank[t]
            automaton.add_word(name, t)
        automaton.make_automaton()
        self._automaton = automaton
        # No piece holds a blank after another character: words end before blanks.
        apart = not any(re.search(f"[^{SPACE}]{SPACE}", n) for n in names)
        self._word = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if apart else r"(?s).+")
        known = "".join(map(re.escape, sorted(chars)))
        self._known = re.compile(f"[{known}]+|[^{known}]")
        self._apart = apart

    def _read_surfaces(self, names: list[str], kinds: list[int]) -> None:
        shown = {NORMAL: lambda n: n.replace(SPACE, " ").encode(), UNKNOWN: lambda n: " ⁇ ".encode(), CONTROL: lambda n: b"", BYTE: lambda n: bytes([int(n[3:5], 16)])}
        raw = [shown[k](n) for n, k in zip(names, kinds, strict=True)]
        self._kinds = np.array(kinds)
        self._surface_sizes = np.array([len(r) for r in raw], np.int64)
        self._surface_at = np.cumsum(self._surface_sizes) - self._surface_sizes
        self._surfaces = np.frombuffer(b"".join(raw), np.uint8)
        self._blank_first = np.array([k == NORMAL and r[:1] == b" " for r, k in zip(raw, kinds, strict=True)])

    def _bytes_of(self, text: str) -> bytes:
        return b"".join(struct.pack("<I", self._of_byte[b]) for b in text.encode())

    def merged(self, text: str, below: int = NEVER, whole: bool = True) -> list[str]:
        """What merging one pair after another leaves of a short text: the least rank first, of equal ones the leftmost.

        Without `whole` the merge of rank `below` that gives the text itself is left out.
        """
        parts = [*text]
        while len(parts) > 1:
            best = min(((self._merge_rank.get(a + b, NEVER), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))), default=(NEVER, 0))
            if best[0] == NEVER or (not whole and len(parts) == 2 and best[0] == below):
                break
            parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether token b may follow token a: no pair across their border merges before both are whole."""
        if not (self._plain[a] and self._plain[b]):
            return self.merged(self._names[a] + self._names[b]) == [self._names[a], self._names[b]]
        rank, limit = self._rank, NEVER
        while True:
            if self._merge_rank.get(self._names[a] + self._names[b], NEVER) < limit:
                return False
            # Undo the later merge of the two, the right one of equals; what stands left of the border goes first.
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                limit, a = rank[a], self._right[a]
            else:
                limit, b = rank[b] + 1, self._left[b]

    def _encode_known(self, text: str) -> list[bytes]:
        """Ids of a text of the vocabulary's characters, by the table of last tokens."""
        pairs, lengths = self._pairs, self._lengths
        if len(pairs) > KEEP_PAIRS:
            pairs.clear()
        last, done, n = [0] * len(text), -1, len(self._names)
        for end, t in self._automaton.iter(text):
            if end == done:
                continue
            before = end - lengths[t]
            if before >= 0:
                key = last[before] * n + t
                fits = pairs.get(key)
                if fits is None:
                    fits = pairs[key] = self.compatible(last[before], t)
                if not fits:
                    continue
            last[end] = t
            done = end
        out, at = [], len(text) - 1
        while at >= 0:
            out.append(self._ids[last[at]])
            at -= lengths[last[at]]
        return out[::-1]

    def _encode_word(self, word: str) -> bytes:
        out = []
        for part in self._known.findall(word):
            out += self._encode_known(part) if part[0] in self._token else [self._bytes_of(part)]
        ids = b"".join(out)
        if len(word) <= LONG:
            if len(self._words) >= KEEP:
                self._words.clear()
            self._words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """All ids with begin and end ids, as little-endian unsigned 32-bit integers."""
        known, out = self._words, [struct.pack("<I", self.begin)]
        for part in self._parts(SPACE + text.replace(" ", SPACE)) if text else ():
            words = self._word.findall(part)
            out += [known.get(w) or self._encode_word(w) for w in words]
        return b"".join([*out, struct.pack("<I", self.end)])

    def _parts(self, text: str, size: int = 1 << 20) -> Iterator[str]:
        """A long text in parts that end before a blank after another character, where a word ends anyway."""
        at = 0
        while self._apart and len(text) - at > 2 * size:
            cut = next((m.start() + 1 for m in re.compile(f"[^{SPACE}]{SPACE}").finditer(text, at + size)), 0)
            if not cut:
                break
            yield text[at:cut]
            at = cut
        yield text[at:]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; a byte that is part of no character becomes U+FFFD, and control ids part bytes."""
        cuts = np.flatnonzero(self._kinds[ids] == CONTROL)
        runs = [r for r in np.split(ids, np.stack([cuts, cuts + 1], 1).ravel()) if len(r) and self._kinds[r[0]] != CONTROL]
        out = [gather(self._surfaces, self._surface_at[r], self._surface_sizes[r]).tobytes() for r in runs]
        if runs and self._blank_first[runs[0][0]]:
            out[0] = out[0][1:]
        return "".join(r.decode("utf-8", "each-byte-replaced") for r in out)


#: Of this Python worker, by file.
_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id_col, the columns in keep (but one named token_ids), and token_ids array<int> of each whole text, with begin and end ids."""
    kept = [c for c in dict.fromkeys([id_col, *(keep or [])]) if c != "token_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in pieces(batches):
            found = [own.encode(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(f) // 4 for f in found], dtype=np.int64)])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*kept, "token_ids"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    given = df.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(kept)), F.col(text_col).alias("text"))
    return given.mapInArrow(run, f"{schema}, token_ids array<int>")


def decode(df: DataFrame, path: str, ids_col: str = "token_ids", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (but one named text), and the text of each row's ids; null ids give an empty text."""
    kept = [c for c in keep or ["doc_id"] if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in pieces(batches):
            texts = [own.decode(np.array(ids or [], np.int64)) for ids in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*kept, "text"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    given = df.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(kept)), F.col(ids_col).alias("ids"))
    return given.mapInArrow(run, f"{schema}, text string")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each text and decodes its ids again: number of ids and digests of the ids and of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in pieces(batches):
            counts, of_ids, of_text = [], [], []
            for text in batch.column(1).to_pylist():
                ids = own.encode(text or "")
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(own.decode(np.frombuffer(ids, "<u4")).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    found = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return found.withColumnRenamed("id", id_col)
