"""Shards of hot ids, packing at every width, and the word store that forgets."""

import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from groundloom.llm import token_files
from groundloom.llm.pretokens import TextEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 32])
def test_pack_and_unpack(bits):
    ids = np.random.default_rng(1).integers(0, 2**bits, 1001)
    packed = token_files.pack(ids, bits)
    assert len(packed) == (1001 * bits + 7) // 8
    for first, count in ((0, 1001), (3, 10), (1000, 1), (500, 0)):
        assert (token_files.unpack(packed, bits, first, count) == ids[first : first + count]).all()


def test_an_id_of_many_rows_is_dealt_out_in_order():
    bounds = np.array([10, 20, 20, 20, 20, 30])
    hashes = np.sort(np.random.default_rng(2).integers(-(2**63), 2**63, 1000))
    shards = token_files._shards(bounds, np.full(1000, 20), hashes)
    assert (np.diff(shards) >= 0).all() and set(shards) == {2, 3, 4}
    assert token_files._shards(bounds, np.array([5, 10, 15, 25, 30, 35]), np.zeros(6, np.int64)).tolist() == [0, 0, 1, 5, 5, 6]


def test_rows_without_an_id_fill_several_shards(spark, tmp_path):
    rows = [(None if i % 3 else i, f"text {i}") for i in range(600)]
    out = str(tmp_path / "t")
    token_files.write(spark.createDataFrame(rows, "doc_id bigint, text string"), out, PATH, 2, 50_257)
    found = sorted(token_files.read_documents(spark, out).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None] * 400 + list(range(0, 600, 3))
    ends = np.cumsum([r.n_tokens for r in found])
    assert [r.start for r in found[1:]] == ends[:-1].tolist()
    holding = token_files.read_blocks(spark, out).selectExpr("shard", "explode(doc_ids) d").where("d IS NULL").select("shard").distinct().count()
    assert holding > 2


def test_words_are_the_library_s_whatever_is_forgotten():
    library, encoder = Tokenizer.from_file(PATH), token_files.library_encoder(PATH)
    small = TextEncoder(encoder._words_to_ids, encoder._special, keep=40, chunk_chars=200)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{rng.integers(60)}x" for _ in range(80)) + ["", "<|endoftext|> it's", " \n ½"][k % 3] for k in range(30)]
    for at in range(0, 30, 5):
        ids, counts = small.encode(texts[at : at + 5])
        assert ids.tolist() == [i for t in texts[at : at + 5] for i in library.encode(t, add_special_tokens=False).ids]
        assert counts.sum() == len(ids)


def test_random_access_reads_the_folders_of_the_range_only(spark, tmp_path):
    rows = [(i, f"document number {i} of some words " * 3) for i in range(300)]
    place = str(tmp_path / "files")
    token_files.write(spark.createDataFrame(rows, "doc_id bigint, text string"), place, PATH, 2, 50_257, block_tokens=64)
    flat = [i for r in sorted(token_files.read_documents(spark, place).collect(), key=lambda r: r.start) for i in r.token_ids]
    shards = {r.shard: r for r in spark.read.parquet(f"{place}/shards").collect()}
    assert len(shards) > 4
    for first, count in ((0, 1), (100, 500), (len(flat) - 3, 50), (0, len(flat)), (len(flat), 5)):
        found = sorted(token_files.read_range(spark, place, first, count).collect())
        assert [i for r in found for i in r.token_ids] == flat[first : first + count]
    shard = shards[2]
    blocks = token_files.blocks_of_range(spark, place, shard.shard_start + 70, 20)
    plan = blocks._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*shard#\d+ (= |IN \()2", plan) and re.search(r"PushedFilters: \[[^\]]*LessThan\(first_token,90\)", plan)
    assert blocks.count() <= 2
