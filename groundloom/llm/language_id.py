"""Language identification by a byte convolutional network, trained in numpy.

A text, lower-cased, is cut into windows of WINDOW bytes. Filters of several widths pass over a window's
bytes; the largest value of each filter goes into a softmax over the languages. A text's scores are the means
over all its windows, weighted by their bytes.

The network learns from at most `per_language` documents of each language (the smallest by a hash of their
id) and `windows_each` windows of each, evenly spread over the whole text: a bound on what the driver holds,
whatever the table's size. Everything else covers all rows.

Null text and text without a letter is `und` with score 0, and so is every text if nothing is labelled. Rows
without an id are never learnt from and never held out. Repeated rows get equal results; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundloom.llm.batches import pieces

UNKNOWN = "und"
WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 24
#: Windows that one numpy step holds: its sums, 1.2 MB, stay in a core's cache.
STEP = 16
#: Parts of a language that are ranked apart before its learning sample is drawn.
SHARES = 16


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n, WINDOW + widest - 1) bytes of a text, zero after its end, and the bytes of each window."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    n = max(1, -(-len(raw) // WINDOW))
    wide = WINDOW + max(WIDTHS) - 1
    flat = np.zeros(n * WINDOW + max(WIDTHS) - 1, np.uint8)
    flat[: len(raw)] = raw
    cut = np.lib.stride_tricks.sliding_window_view(flat, wide)[::WINDOW]
    return cut, np.minimum(WINDOW, len(raw) - np.arange(n) * WINDOW)


@dataclass
class Network:
    """taps[k][byte]: what byte k places on adds to each filter; out, bias: from filters to languages."""

    languages: list[str]
    taps: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def new(cls, languages: list[str], rng: np.random.Generator) -> Network:
        total = FILTERS * len(WIDTHS)
        taps = rng.normal(0, 0.1, (max(WIDTHS), 256, total)).astype(np.float32)
        net = cls(languages, taps, np.zeros(total, np.float32), rng.normal(0, 0.1, (total, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
        net.taps *= net.mask()
        return net

    @staticmethod
    def mask() -> np.ndarray:
        """A filter has as many taps as it is wide."""
        width = np.repeat(WIDTHS, FILTERS)
        return (np.arange(max(WIDTHS))[:, None, None] < width[None, None, :]).astype(np.float32)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest value of each filter in each window, and where it stands."""
        total = np.take(self.taps[0], x[:, :WINDOW], axis=0)
        for k in range(1, len(self.taps)):
            total += np.take(self.taps[k], x[:, k : k + WINDOW], axis=0)
        where = total.argmax(axis=1)
        return np.take_along_axis(total, where[:, None], 1)[:, 0] + self.shift, where

    def peaks(self, x: np.ndarray) -> np.ndarray:
        """The largest values alone."""
        total = np.take(self.taps[0], x[:, :WINDOW], axis=0)
        for k in range(1, len(self.taps)):
            total += np.take(self.taps[k], x[:, k : k + WINDOW], axis=0)
        return total.max(axis=1) + self.shift

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _softmax(np.maximum(self.peaks(x), 0) @ self.out + self.bias)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], steps: int = 500, batch: int = 64, rate: float = 0.01, seed: int = 5) -> Network:
    """Minibatches with Adam; languages are drawn equally often."""
    rng = np.random.default_rng(seed)
    net = Network.new(languages, rng)
    params = [net.taps, net.shift, net.out, net.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    rows = [np.flatnonzero(y == k) for k in range(len(languages))]
    mask, columns = net.mask(), np.arange(FILTERS * len(WIDTHS))
    for step in range(1, steps + 1):
        kind = rng.integers(len(languages), size=batch)
        pick = np.array([rng.choice(rows[k]) for k in kind])
        xs = x[pick]
        peak, where = net.pooled(xs)
        active = np.maximum(peak, 0)
        error = _softmax(active @ net.out + net.bias)
        error[np.arange(batch), kind] -= 1
        error /= batch
        back = (error @ net.out.T) * (peak > 0)
        taps = np.zeros_like(net.taps)
        for k in range(len(taps)):
            np.add.at(taps[k], (np.take_along_axis(xs, where + k, 1), np.broadcast_to(columns, where.shape)), back)
        grads = [taps * mask, back.sum(axis=0), active.T @ error, error.sum(axis=0)]
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, per_language: int = 200, windows_each: int = 4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network that learnt from the text and language of documents that aren't held out; None without any."""
    given = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    given = given.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    # Texts that have a letter, each once.
    given = given.where(F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    key = ["id", "lang", "h"]
    # The first of each of SHARES shares of a language, then the first of those: no task ranks a whole language.
    chosen = given.select(*key).distinct().withColumn("share", F.pmod(F.xxhash64("id", "h"), F.lit(SHARES)))
    for group in (["lang", "share"], ["lang"]):
        order = Window.partitionBy(*group).orderBy(F.xxhash64("id"), "id", "h")
        chosen = chosen.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language)
    chosen = chosen.select(*key)
    # At most per_language texts a language.
    sample = given.join(F.broadcast(chosen), key, "left_semi").dropDuplicates(key).select("id", "lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = {"id": [], "lang": [], "window": []}
            for doc, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not has_letter(text):
                    continue
                all_windows, _ = windows(text)
                for k in sorted({round(i * (len(all_windows) - 1) / max(1, windows_each - 1)) for i in range(windows_each)}):
                    for name, value in (("id", str(doc)), ("lang", lang), ("window", all_windows[k].tobytes())):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema)

    schema = pa.schema([("id", pa.string()), ("lang", pa.string()), ("window", pa.binary())])
    rows = sorted(tuple(r) for r in sample.mapInArrow(cut, "id string, lang string, window binary").collect())
    if not rows:
        return None
    languages = sorted({lang for _, lang, _ in rows})
    x = np.array([np.frombuffer(bytes(w), np.uint8) for _, _, w in rows])
    return train(x, np.array([languages.index(lang) for _, lang, _ in rows]), languages)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def _scores(net: Network, texts: list[str]) -> np.ndarray:
    """Mean probabilities of each text; windows of many texts go through the network together."""
    total, weight = np.zeros((len(texts), len(net.languages))), np.zeros(len(texts))
    held, owners, sizes, n = [], [], [], 0

    def flush() -> None:
        nonlocal held, owners, sizes, n
        x, who, w = np.concatenate(held), np.concatenate(owners), np.concatenate(sizes)
        p = np.concatenate([net.probabilities(x[a : a + STEP]) for a in range(0, len(x), STEP)])
        np.add.at(total, who, p * w[:, None])
        np.add.at(weight, who, w)
        held, owners, sizes, n = [], [], [], 0

    for k, text in enumerate(texts):
        x, w = windows(text)
        held.append(x)
        owners.append(np.full(len(x), k))
        sizes.append(w)
        n += len(x)
        if n >= 4096:
            flush()
    if n:
        flush()
    return total / np.maximum(weight, 1)[:, None]


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id_col, the columns in keep (but those of the results' names), lang_pred and score of every row, from its whole text alone."""
    kept = [c for c in dict.fromkeys([id_col, *(keep or [])]) if c not in ("lang_pred", "score")]
    # A kept text moves once.
    given = kept if text_col in kept else [*kept, text_col]
    place = given.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column(place).to_pylist()
            at = [k for k, t in enumerate(texts) if net is not None and has_letter(t)]
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if at:
                found = _scores(net, [texts[k] for k in at])
                for k, best, row in zip(at, found.argmax(axis=1).tolist(), found, strict=True):
                    names[k], scores[k] = net.languages[best], min(1.0, float(row[best]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*given).mapInArrow(run, f"{schema}, lang_pred string, score double")
