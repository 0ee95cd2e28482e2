"""Token ids in fixed-width bit-packed files.

A file set is a folder with two Parquet tables. `blocks` has one row per block: its shard and number in the
shard, the place of its first id in the shard, the number of ids, the bits of an id, the packed ids (most
significant bit first, the minimum bits of the vocabulary each), and the ids and lengths of its documents.
Documents follow one another in ascending id order (null first; ties by a hash of the text), blocks
hold whole documents and close at `block_tokens` ids. `shards` has the place of each shard's first id among
all ids, so the block of any position is found from the offsets and unpacked alone, in numpy.

Null text counts as empty. Repeated document ids are documents of their own. An empty table gives an empty
file set. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundloom.llm.batches import pieces
from groundloom.llm.pretokens import TextEncoder

BLOCKS = "shard int, block int, first_token bigint, n_tokens int, bits int, packed binary, doc_ids array<bigint>, doc_tokens array<int>"

#: Widths that numpy reads and writes itself.
WHOLE = {8: ">u1", 16: ">u2", 32: ">u4"}
#: Documents of a shard, about.
SHARD_DOCUMENTS = 50_000
FIRST = np.iinfo(np.int64).min


def bits_for(vocabulary_size: int) -> int:
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in WHOLE:
        return ids.astype(WHOLE[bits]).tobytes()
    wide = np.ascontiguousarray(ids, ">u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(wide, axis=1)[:, 32 - bits :]).tobytes()


def unpack(packed: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """Ids first to first + count, touching the bytes that hold them only."""
    if bits in WHOLE:
        return np.frombuffer(packed, WHOLE[bits], count, first * bits // 8).astype(np.uint32)
    start = first * bits
    raw = np.frombuffer(packed, np.uint8)[start // 8 : (start + count * bits + 7) // 8]
    flat = np.unpackbits(raw)[start % 8 : start % 8 + count * bits].reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, 32 - bits :] = flat
    return np.packbits(wide, axis=1).view(">u4").ravel().astype(np.uint32)


#: Of this Python worker, by file: encoders with the words met so far.
_ENCODERS: dict[str, TextEncoder] = {}


def library_encoder(path: str) -> TextEncoder:
    """Encodes each distinct word once with the tokenizers library."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        def words_to_ids(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            done = tokenizer.encode([w.decode() for w in words], is_pretokenized=True, add_special_tokens=False)
            return np.array(done.ids, np.int32), np.bincount(np.array(done.word_ids, np.int64), minlength=len(words))

        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        _ENCODERS[path] = TextEncoder(words_to_ids, special)
    return _ENCODERS[path]


def _shard_bounds(docs: DataFrame, id_col: str) -> np.ndarray:
    """Document ids, sorted, that part the table into shards of about equal numbers of rows; an id of many rows comes several times."""
    ids = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(int(FIRST))).alias("d"))
    shards = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), ids.count() // SHARD_DOCUMENTS)
    found = ids.agg(F.percentile_approx("d", [k / shards for k in range(1, shards)], 20 * shards)).first()[0]
    return np.array(found or [], np.int64)


def _shards(bounds: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The shard of each document. An id between equal bounds has the shards between them to itself, a range of hashes each."""
    first, last = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
    own = np.maximum(last - first - 1, 0)
    part = ((hashes.astype(np.float64) / 2.0**64 + 0.5) * own).astype(np.int64)
    return np.where(own > 0, first + 1 + np.minimum(part, own - 1), first).astype(np.int32)


def _encoded(docs: DataFrame, path: str, end_id: int, bits: int, id_col: str, text_col: str) -> DataFrame:
    """shard, doc_id, h (a hash of the text), n_tokens and packed ids of each document."""
    bounds = _shard_bounds(docs, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(path)
        for batch in pieces(batches):
            ids, counts = encoder.encode([t or "" for t in batch.column(2).to_pylist()])
            ends = np.cumsum(counts)
            packed = [pack(np.append(ids[e - n : e], end_id), bits) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            shard = _shards(bounds, batch.column(0).fill_null(FIRST).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(shard), *batch.columns[:2], pa.array(counts + 1), pa.array(packed, pa.binary())], names=names)

    names = ["shard", "doc_id", "h", "n_tokens", "packed"]
    given = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, "shard int, doc_id bigint, h bigint, n_tokens bigint, packed binary")


def _blocks(ordered: DataFrame, bits: int, block_tokens: int) -> DataFrame:
    """The ids of a shard's documents are laid end to end and cut into blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, first, held, ids, size = None, 0, 0, [], [], 0

        def row() -> pa.RecordBatch:
            nonlocal block, first, held, ids, size
            row = {"shard": shard, "block": block, "first_token": first, "n_tokens": size, "bits": bits, "packed": pack(np.concatenate(ids), bits), "doc_ids": [d for d, _ in held], "doc_tokens": [k for _, k in held]}
            block, first, held, ids, size = block + 1, first + size, [], [], 0
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for of, doc, n, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (of != shard or size >= block_tokens):
                    yield row()
                if of != shard:
                    shard, block, first = of, 0, 0
                held.append((doc, n))
                ids.append(unpack(packed, bits, 0, n))
                size += n
        if held:
            yield row()

    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int32()), ("bits", pa.int32()), ("packed", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int32()))])
    return ordered.select("shard", "doc_id", "n_tokens", "packed").mapInArrow(run, BLOCKS)


def write(docs: DataFrame, out: str, tokenizer_path: str, end_id: int, vocabulary_size: int, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 65_536) -> None:
    """Encodes documents and writes a file set to the new folder `out`.

    Shards are ranges of document ids, and of text hashes of an id that has many rows. Encoding runs once, on the partitions as read, and only packed ids
    are dealt out.
    """
    bits = bits_for(max(vocabulary_size, end_id + 1))
    spark = docs.sparkSession
    encoded = _encoded(docs, tokenizer_path, end_id, bits, id_col, text_col)
    ordered = encoded.repartition("shard").sortWithinPartitions("shard", "doc_id", "h")
    _blocks(ordered, bits, block_tokens).write.partitionBy("shard").parquet(f"{out}/blocks")
    totals = spark.read.schema(BLOCKS).parquet(f"{out}/blocks").groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # One row per shard.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"), F.col("n").alias("shard_tokens")).write.parquet(f"{out}/shards")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with `start`: the place of a block's first id among all ids."""
    shards = spark.read.parquet(f"{path}/shards")
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").join(shards, "shard").withColumn("start", F.col("shard_start") + F.col("first_token"))


def read_documents(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Per document: doc_id, start, n_tokens, the crc32 of its ids as little-endian 32-bit integers, and its ids if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n, bits, packed, doc_ids, doc_tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                flat = unpack(packed, bits, 0, n).astype("<u4")
                ends = np.cumsum(doc_tokens)
                starts = ends - doc_tokens
                crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(start + starts), pa.array(doc_tokens, pa.int64()), pa.array(crc, pa.int64())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]), pa.int32()), pa.array(flat.view("<i4"))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["token_ids"] * ids]
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", token_ids array<int>" * ids
    return read_blocks(spark, path).select("start", "n_tokens", "bits", "packed", "doc_ids", "doc_tokens").mapInArrow(run, schema)


def blocks_of_range(spark: SparkSession, path: str, first: int, count: int) -> DataFrame:
    """start, n_tokens, bits and packed of the blocks that hold some of the ids first to first + count.

    The table of shards tells which folders hold them; of the outer two only blocks that reach into the range are read.
    """
    until = F.col("shard_start") + F.col("shard_tokens")
    held = spark.read.parquet(f"{path}/shards").where((F.col("shard_start") < first + count) & (until > first)).orderBy("shard").collect()
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where(F.col("shard").isin([r.shard for r in held]))
    if held:
        low, high = held[0], held[-1]
        before = F.col("first_token") < first + count - high.shard_start
        behind = F.col("first_token") + F.col("n_tokens") > first - low.shard_start
        one = low.shard == high.shard
        blocks = blocks.where(before if one else (F.col("shard") != high.shard) | before).where(behind if one else (F.col("shard") != low.shard) | behind)
    starts = F.broadcast(spark.createDataFrame([(r.shard, r.shard_start) for r in held], "shard int, shard_start bigint"))  # a row a shard of the range
    return blocks.join(starts, "shard").select((F.col("shard_start") + F.col("first_token")).alias("start"), "n_tokens", "bits", "packed")


def read_range(spark: SparkSession, path: str, first: int, count: int) -> DataFrame:
    """Ids first to first + count of the whole set (start, token_ids), in one row per block that holds some; other shards' folders aren't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n, bits, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = max(first, start), min(first + count, start + n)
                yield pa.RecordBatch.from_pylist([{"start": a, "token_ids": unpack(packed, bits, a - start, b - a).tolist()}], schema)

    schema = pa.schema([("start", pa.int64()), ("token_ids", pa.list_(pa.int32()))])
    return blocks_of_range(spark, path, first, count).mapInArrow(run, "start bigint, token_ids array<int>")
