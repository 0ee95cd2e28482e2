"""BPE of long words: ids of the library, and time about in proportion to the length."""

import base64
import random
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from groundloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    letters = lambda n, of="abcdefghijklmnopqrstuvwxyz": "".join(rng.choices(of, k=n))
    return {
        "letters": letters(100_000),
        "one letter": "a" * 100_001,
        "two letters": letters(100_000, "ab"),
        "words": "".join(rng.choices(["the", "and", "Over", "ing", "tion", "é", "ß", "日本"], k=30_000)),
        "base64": base64.b64encode(rng.randbytes(90_000)).decode(),
        "signs": letters(100_000, "=-_#"),
    }


@pytest.mark.parametrize("kind", ["letters", "one letter", "two letters", "words", "base64", "signs"])
def test_words_of_100000_characters(library, texts, kind):
    _, encoder = bpe.encoder(PATH)
    encoder.encode(["warm"])
    began = time.process_time()
    ids, counts = encoder.encode([texts[kind]])
    assert time.process_time() - began < 4  # about 1 on an idle machine
    assert ids.tolist() == library.encode(texts[kind], add_special_tokens=False).ids and counts.tolist() == [len(ids)]


def test_words_around_the_bound_and_many_at_once(library):
    rng = random.Random(4)
    vocabulary, _ = bpe.encoder(PATH)
    sizes = [1, 2, 3, bpe.LONG - 1, bpe.LONG, bpe.LONG + 1, bpe.LONG + 2, 500, 3000]
    words = ["".join(rng.choices(rng.choice(["ab", "aaab", "abcdefghijklmnopqrstuvwxyz", "xyzé"]), k=rng.choice(sizes))) for _ in range(300)] + ["<|endoftext|>", ""]
    ids, counts = vocabulary.words_to_ids([w.encode() for w in words])
    ends = np.cumsum(counts)
    for w, a, b in zip(words, (ends - counts).tolist(), ends.tolist(), strict=True):
        assert ids[a:b].tolist() == library.encode(w, add_special_tokens=False).ids, w[:50]
    none, counts = vocabulary.words_to_ids([])
    assert len(none) == len(counts) == 0


def test_time_grows_with_the_length(library):
    rng = random.Random(5)
    vocabulary, _ = bpe.encoder(PATH)
    took = []
    for n in (50_000, 400_000):
        word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
        began = time.process_time()
        ids, _ = vocabulary.words_to_ids([word.encode()])
        took.append(time.process_time() - began)
        assert ids.tolist() == library.encode(word, add_special_tokens=False).ids
    assert took[1] < 8 * 2 * took[0]
