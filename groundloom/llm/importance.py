"""Importance resampling of documents towards a target collection, by hashed word features.

A document's features are its runs of consecutive words (a-z, 0-9 and all beyond ASCII, A-Z lower-cased), and
each falls into a bucket by the CRC-32 of its UTF-8 bytes. A bucket's gain says how much likelier it is in the
target than in the documents; a document's weight is the mean gain of its features, and Gumbel noise drawn
from a hash of the document id turns the largest scores into a draw without replacement.

Null texts have no words, weight 0 and are never drawn, like all texts of fewer than `least_words` words. A
null id draws by its text. Rows of one id and score take neighbouring ranks; null ids come last among
equals. An empty target is a target without features; of an empty table nothing is drawn. Further columns are
left out. A task holds some ten times the longest text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundloom.llm import scratch
from groundloom.llm.batches import pieces
from groundloom.llm.crc_spans import SpanCrc
from groundloom.llm.pretokens import gather
from groundloom.operators.prefix import running_sums

BLANK = ord(" ")
#: Neighbouring scores whose counts a task adds up.
SCORES = 128
#: Bytes worked on in one numpy step.
STEP = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += ord("a") - ord("A")
_WORD = np.zeros(256, bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
_CRC = SpanCrc()


def _joined_words(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts laid end to end (first: where each begins), each with a blank behind it: bytes, starts, lengths and texts."""
    edge = np.zeros(len(data) + 1, bool)
    edge[first[first < len(data)]] = edge[-1] = True
    data = _LOWER[data]
    word = np.append(_WORD[data], False)
    begins = word[:-1] & edge[:-1]
    begins[1:] |= word[1:-1] & ~word[:-2]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(word[:-1] & (~word[1:] | edge[1:])) + 1
    lengths = ends - starts
    at = np.cumsum(lengths + 1) - lengths - 1
    out = np.full(int(lengths.sum()) + len(lengths), BLANK, np.uint8)
    kept = np.ones(len(out), bool)
    kept[at + lengths] = False
    out[kept] = gather(data, starts, lengths)
    return out, at, lengths, np.searchsorted(first, starts, "right") - 1


def _features(texts: pa.Array, sizes: tuple[int, int], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of (text of each feature, its bucket), and with the first part of some texts their numbers of words."""
    column = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        # Some texts of STEP bytes together, or one longer text.
        upto = max(row + 1, int(np.searchsorted(offsets, offsets[row] + STEP, "right")) - 1)
        joined, at, lengths, text = _joined_words(data[offsets[row] : offsets[upto]], offsets[row:upto] - offsets[row])
        n_words = np.bincount(text + row, minlength=len(column))
        for n in range(sizes[0], sizes[1] + 1):
            some = np.flatnonzero(text[: len(text) - n + 1] == text[n - 1 :]) if len(text) >= n else np.zeros(0, np.int64)
            begin, size = at[some], (at + lengths)[some + n - 1] - at[some]
            ends = np.cumsum(size)
            cuts = [0, *(np.searchsorted(ends, np.arange(STEP, ends[-1], STEP)) + 1).tolist(), len(some)] if len(some) else []
            for a, b in zip(cuts, cuts[1:]):
                yield text[some[a:b]] + row, (_CRC.of(joined, begin[a:b], size[a:b]) % buckets).astype(np.int64), n_words
                n_words = np.zeros_like(n_words)
        yield np.zeros(0, np.int64), np.zeros(0, np.int64), n_words
        row = upto


def bucket_counts(df: DataFrame, text_col: str = "text", sizes: tuple[int, int] = (1, 1), buckets: int = 10_000) -> DataFrame:
    """bucket, n: the features of all texts, counted in each task before they are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in pieces(batches):
            for _, found, _ in _features(batch.column(0), sizes, buckets):
                counts += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["bucket", "n"])

    each = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """The gain of each bucket, from the bucket counts of the documents and of the target: one number a bucket."""
    counts = np.zeros((2, buckets), np.int64)
    for k, df in enumerate((raw, target)):
        for r in df.collect():
            counts[k, r.bucket] = r.n
    totals = [float(c) for c in counts.sum(1) + buckets]
    ratio = lambda s, t: float(t + 1) * totals[0] / (float(s + 1) * totals[1])
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(*counts.tolist(), strict=True)], np.int64)


def noise(h: int) -> int:
    """Gumbel noise in thousandths, from 32 random bits."""
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(df: DataFrame, gain: np.ndarray, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text", sizes: tuple[int, int] = (1, 1)) -> DataFrame:
    """id_col, n_words, n_features, weight and score of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n = batch.num_rows
            total, count, n_words = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for text, found, words in _features(batch.column(2), sizes, len(gain)):
                total += np.bincount(text, gain[found], n)
                count += np.bincount(text, minlength=n)
                n_words += words
            weight = total.astype(np.int64) // np.maximum(count, 1)
            score = weight + np.array([noise(h) for h in batch.column(1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, count, weight, score))], names=["id", "n_words", "n_features", "weight", "score"])

    text = F.col(text_col).cast("string")
    drawn_by = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.sha2(F.coalesce(text, F.lit("")), 256)))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), drawn_by), 256), 1, 8), 16, 10).cast("bigint")
    kind = df.schema[id_col].dataType.simpleString()
    found = df.select(F.col(id_col).alias("id"), h.alias("h"), text.alias("text")).mapInArrow(run, f"id {kind}, n_words bigint, n_features bigint, weight bigint, score bigint")
    return found.withColumnRenamed("id", id_col)


def draw(scored: DataFrame, percent: int = 10, least_words: int = 20, id_col: str = "doc_id") -> DataFrame:
    """scored (a written table) with the rank of the drawn documents: the largest scores, of equals the smaller id.

    Rows are counted by score first, which tells the last score drawn and where each score's ranks begin; only
    rows of drawn scores are then put in order, score by score, rows alike in all columns as one.
    """
    names = scored.columns
    can = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    per = scored.where(can).groupBy("score").agg(F.count(F.lit(1)).alias("n")).withColumn("down", -F.col("score"))
    per = per.withColumn("range", F.floor(F.col("down") / SCORES))
    upto = running_sums(per, "down", {"n": "upto"}, range_col="range").select("score", (F.col("upto") - F.col("n")).alias("before"), "n")
    wanted, last = upto.agg(F.sum("n")).first()[0] or 0, None
    wanted = wanted * percent // 100
    if wanted:
        last = upto.where(F.col("before") < wanted).agg(F.min("score")).first()[0]
    unranked = F.lit(None).cast("bigint").alias("rank")
    if last is None:
        return scored.select(*names, unranked)
    chosen = can & (F.col("score") >= last)
    alike = scored.where(chosen).groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
    order = Window.partitionBy("score").orderBy(F.col(id_col).asc_nulls_last(), *(c for c in names if c not in (id_col, "score"))).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = alike.withColumn("__upto", F.sum("__n").over(order)).join(upto.where(F.col("score") >= last).select("score", "before"), "score")
    each = ranked.select(*names, F.explode(F.sequence(F.col("before") + F.col("__upto") - F.col("__n") + 1, F.col("before") + F.col("__upto"))).alias("rank"))
    each = each.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return each.unionByName(scored.where(~chosen).select(*names, unranked))


def resample(df: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text", sizes: tuple[int, int] = (1, 1), buckets: int = 10_000) -> DataFrame:
    """id_col, n_words, n_features, weight, score and rank of each document; `percent` of those of enough words are drawn."""
    gain = gains(bucket_counts(df, text_col, sizes, buckets), bucket_counts(target, text_col, sizes, buckets), buckets)
    return draw(scratch.table(weighted(df, gain, seed, id_col, text_col, sizes), "weighted"), percent, least_words, id_col)
