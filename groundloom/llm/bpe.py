"""BPE encoding and decoding with batched merge rounds in numpy.

Null text counts as empty; empty text has no ids. Rows of equal id, null ids and further columns pass
through unchanged (only the id column is returned beside the results). Texts of any length are worked
through in chunks that end where a word ends, and a word of any length in time about in proportion to it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundloom.llm.batches import pieces
from groundloom.llm.pretokens import TextEncoder, gather

NONE = np.iinfo(np.int64).max
#: Bytes above which a word's merges are kept by rank.
LONG = 128


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE vocabulary: sorted pair keys with rank and merged id, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, chars = spec["model"]["vocab"], byte_chars()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*ids.values(), *self.special.values()])
        self.of_byte = np.array([ids[c] for c in chars], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([ids[p[k]] for p in pairs], np.int64) for k in (0, 1))
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        back = {c: b for b, c in enumerate(chars)}
        raw = [b""] * self.size
        for token, i in ids.items():
            raw[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            raw[i] = token.encode()
        self.byte_lengths = np.array([len(r) for r in raw], np.int64)
        self.byte_offsets = np.cumsum(self.byte_lengths) - self.byte_lengths
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        decimal = [b"%d," % i for i in range(self.size)]
        self.decimal_lengths = np.array([len(d) for d in decimal], np.int64)
        self.decimal_offsets = np.cumsum(self.decimal_lengths) - self.decimal_lengths
        self.decimals = np.frombuffer(b"".join(decimal), np.uint8)

    def words_to_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and the number of ids of each; special strings have an id of their own."""
        special = {k: v for s, v in self.special.items() for k in [s.encode()]}
        plain = [b"" if w in special else w for w in words]
        sizes = np.array([len(w) for w in plain], np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(plain), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        long = np.repeat(sizes > LONG, sizes)
        done = [self._merged_all(symbols[~long], word[~long]), self._merged_by_rank(symbols[long], word[long])]
        done += [(np.array([special[w]], np.int64), np.array([k])) for k, w in enumerate(words) if w in special]
        ids, owner = (np.concatenate(x) for x in zip(*done, strict=True))
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair by binary search, NONE where it is no pair of the vocabulary."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)

    def _merged_all(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over all words at once: in each, every word merges its lowest-rank pair wherever it stands."""
        done_symbols, done_word = [symbols[:0]], [word[:0]]
        while len(symbols):
            rank = np.full(len(symbols), NONE)
            rank[:-1] = np.where(word[:-1] == word[1:], self._ranks_of(symbols[:-1], symbols[1:]), NONE)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            length = np.diff(first, append=len(word))
            least = np.repeat(np.minimum.reduceat(rank, first), length)
            over = least == NONE
            done_symbols.append(symbols[over])
            done_word.append(word[over])
            here = (rank == least) & ~over
            here &= ~_second(here)
            symbols[here] = self.merged[rank[here]]
            keep = ~over
            keep[1:] &= ~here[:-1]
            symbols, word = symbols[keep], word[keep]
        return np.concatenate(done_symbols), np.concatenate(done_word)

    def _merged_by_rank(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds for long words: in each, all words merge the pairs of one rank, the least there is.

        Places of pairs are kept by rank, and a round goes to those of its rank and to their neighbours only,
        so the work grows with the number of merges and not with the length of the words a round.
        """
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        whole = np.ones(n, bool)
        last = np.append(word[:-1] != word[1:], True)[:n]
        after[last] = -1
        before[1:][last[:-1]] = -1
        rank = np.full(n, NONE)
        places: dict[int, list[np.ndarray]] = {}
        least: list[int] = []

        def note(at: np.ndarray) -> None:
            """Finds the ranks of the pairs at these places anew."""
            right = after[at]
            found = np.where(right >= 0, self._ranks_of(symbols[at], symbols[right]), NONE)
            rank[at] = found
            order = np.argsort(found, kind="stable")
            sorted_ranks = found[order]
            cuts = np.flatnonzero(np.diff(sorted_ranks)) + 1
            for r, some in zip(sorted_ranks[np.append(0, cuts)].tolist(), np.split(at[order], cuts), strict=True):
                if r == NONE:
                    continue
                if r in places:
                    places[r].append(some)
                else:
                    places[r] = [some]
                    heapq.heappush(least, r)

        if n:
            note(np.arange(n))
        while least:
            r = heapq.heappop(least)
            some = places.pop(r)
            at = some[0] if len(some) == 1 else np.unique(np.concatenate(some))
            at = at[whole[at] & (rank[at] == r)]
            if len(at) > 1:
                # Of pairs that overlap, x x x, every second one goes.
                follows = np.append(False, after[at[:-1]] == at[1:])
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(follows, 0, place))) % 2 == 0]
            if not len(at):
                continue
            right = after[at]
            symbols[at] = self.merged[r]
            whole[right] = False
            behind = after[right]
            after[at] = behind
            some = behind >= 0
            before[behind[some]] = at[some]
            front = before[at]
            note(np.unique(np.concatenate([front[front >= 0], at])))
        return symbols[whole], word[whole]

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.bytes, self.byte_offsets[ids], self.byte_lengths[ids]).tobytes()

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return gather(self.decimals, self.decimal_offsets[ids], self.decimal_lengths[ids]).tobytes()[:-1]


def _second(here: np.ndarray) -> np.ndarray:
    """Every second place of a run of neighbours: x x x holds the pair x x twice, but only the first can merge."""
    place = np.arange(len(here))
    run = np.maximum.accumulate(np.where(here, -1, place))  # the last place before each run
    return here & ((place - run) % 2 == 0)


#: Of this Python worker, by file: encoders with the words met so far.
_ENCODERS: dict[str, tuple[Vocabulary, TextEncoder]] = {}


def encoder(path: str) -> tuple[Vocabulary, TextEncoder]:
    if path not in _ENCODERS:
        vocabulary = Vocabulary(path)
        _ENCODERS[path] = vocabulary, TextEncoder(vocabulary.words_to_ids, list(vocabulary.special))
    return _ENCODERS[path]


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id_col, the columns in keep (but one named token_ids), and token_ids array<int> of each whole text."""
    kept = [c for c in dict.fromkeys([id_col, *(keep or [])]) if c != "token_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, texts = encoder(path)
        for batch in pieces(batches):
            ids, counts = texts.encode([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*kept, "token_ids"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    given = df.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(kept)), F.col(text_col).alias("text"))
    return given.mapInArrow(run, f"{schema}, token_ids array<int>")


def decode(df: DataFrame, path: str, ids_col: str = "token_ids", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (but one named text), and the text of each row's ids."""
    kept = [c for c in keep or ["doc_id"] if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, _ = encoder(path)
        for batch in pieces(batches):
            texts = [vocabulary.decode(np.array(ids or [], np.int64)).decode("utf-8", "replace") for ids in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*kept, "text"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    given = df.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(kept)), F.col(ids_col).alias("ids"))
    return given.mapInArrow(run, f"{schema}, text string")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each text and decodes its ids again: number of ids and digests of the ids and of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, texts = encoder(path)
        for batch in pieces(batches):
            ids, counts = texts.encode([t or "" for t in batch.column(1).to_pylist()])
            of_ids, of_text, at = [], [], 0
            for n in counts.tolist():
                own = ids[at : at + n]
                at += n
                of_ids.append(hashlib.sha256(vocabulary.decimal(own)).hexdigest())
                text = vocabulary.decode(own).decode("utf-8", "replace")
                of_text.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(of_ids), pa.array(of_text)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
