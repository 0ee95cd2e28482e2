"""SentencePiece ids and texts against the library's, and compatibility of tokens against merging."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from groundloom.llm import sentencepieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", "e", "n", "t", "h", " ", "   ", "▁", "\x00", "é", "日本", "\U0001f600", "12", "\n", "the", "ing", " a", "�", "\t", "﷽", "<s>", "<0x41>"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return sentencepieces.PieceModel(PATH)


def test_encodes_and_decodes_as_the_library(model, library):
    rng = random.Random(7)
    names = [library.id_to_piece(i) for i in range(259, 32000)]
    texts = ["", " ", "  x", " " * 45 + "x" + " " * 33, *("".join(rng.choices(PARTS, k=rng.randint(0, 25))) for _ in range(5000)), *("".join(rng.choices(names, k=rng.randint(1, 6))) for _ in range(5000))]
    for text in texts:
        ids = np.frombuffer(model.encode(text), "<u4")
        expected = library.encode(text, add_bos=True, add_eos=True)
        assert ids.tolist() == expected, text
        assert model.decode(ids) == library.decode(expected), text


def test_decodes_any_ids_as_the_library(model, library):
    rng = random.Random(8)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32000), 1, 2, 28705]) for _ in range(rng.randint(0, 10))]
        assert model.decode(np.array(ids, np.int64)) == library.decode(ids), ids


def test_compatible_pairs_are_those_that_merging_leaves_whole(model):
    rng = random.Random(9)
    for _ in range(3000):
        a, b = rng.randrange(len(model._names)), rng.randrange(len(model._names))
        pair = [model._names[a], model._names[b]]
        assert model.compatible(a, b) == (model.merged("".join(pair)) == pair)


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "a", "ab", " "])
def test_words_of_100000_characters(model, library, letters):
    text = "".join(random.Random(10).choices(letters, k=100_000))
    library.encode("warm")
    start = time.process_time()
    ids = model.encode(text)
    assert time.process_time() - start < 5
    assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_a_text_of_many_parts(model, library):
    text = "some words  and\nothers " * 120_000
    assert np.frombuffer(model.encode(text), "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_tables(spark, library):
    rows = [(1, "Hello  world"), (1, "Hello  world"), (2, None), (3, ""), (None, "é\x00")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"n_tokens": F.lit("x"), "token_ids": F.lit(3)})
    found = sentencepieces.round_trip(docs, PATH)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    for r in found.collect():
        text = next(t for i, t in rows if i == r.doc_id) or ""
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = sentencepieces.decode(sentencepieces.encode(docs, PATH, keep=["n_tokens"]), PATH, keep=["doc_id", "n_tokens"])
    assert sorted(map(str, back.collect())) == sorted(map(str, docs.select("doc_id", "n_tokens", F.coalesce("text", F.lit("")).alias("text")).collect()))
    assert sentencepieces.round_trip(docs.limit(0), PATH).count() == 0


def test_other_kinds_of_model_are_refused(tmp_path):
    (tmp_path / "unigram.model").write_bytes(b"\x0a\x05\x0a\x03<s>\x12\x02\x18\x01")
    with pytest.raises(ValueError):
        sentencepieces.PieceModel(str(tmp_path / "unigram.model"))
