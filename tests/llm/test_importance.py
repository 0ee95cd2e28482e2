"""CRC-32 of spans against zlib, and importance resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from groundloom.llm import importance
from groundloom.llm.crc_spans import REACH, SpanCrc


def test_crc_of_spans_is_zlib_s():
    rng = random.Random(1)
    data, crc = np.frombuffer(rng.randbytes(300_000), np.uint8), SpanCrc()
    for size in (*range(12), REACH - 1, REACH, REACH + 1, 2 * REACH, 2 * REACH + 1, 3 * REACH - 1, 20_000, 299_999):
        lengths = np.array([size, rng.randint(0, size), rng.randint(0, 4 * REACH)])
        starts = np.array([rng.randint(0, len(data) - n) for n in lengths.tolist()])
        assert crc.of(data, starts, lengths).tolist() == [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
    assert len(crc.of(data, np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain(docs, target, percent, least, sizes, buckets):
    def features(text):
        found = words(text)
        return [zlib.crc32(" ".join(found[k : k + n]).encode()) % buckets for n in range(sizes[0], sizes[1] + 1) for k in range(len(found) - n + 1)]

    s, t = (Counter(b for _, text in rows for b in features(text)) for rows in (docs, target))
    ns, nt = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log(float(t[b] + 1) * float(ns) / (float(s[b] + 1) * float(nt)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        found = features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        drawn_by = str(i) if i is not None else "null:" + hashlib.sha256((text or "").encode()).hexdigest()
        h = int(hashlib.sha256(f"2024:{drawn_by}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words(text)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    can = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, *r[1:4]))
    for k, r in enumerate(can[: len(can) * percent // 100]):
        r[5] = k + 1
    return sorted(map(str, out))


@pytest.mark.parametrize(("sizes", "buckets"), [((1, 1), 10_000), ((1, 2), 50), ((2, 3), 997)])
def test_resampling_against_a_plain_version(spark, monkeypatch, sizes, buckets):
    monkeypatch.setattr(importance, "STEP", 300)
    rng = random.Random(2)
    pool = ["Alpha", "beta", "GAMMA", "İstanbul", "über", "日本語", "x1", "42", "w" * 500, "end"]
    text = lambda: rng.choice([" ", ", ", "\n", "\x00"]).join(rng.choices(pool, k=rng.randint(0, 30)))
    docs = [(i % 90, text()) for i in range(120)] + [(None, None), (None, ""), (7, " .;"), (500, "z" * 3000), *[(None, "same words " * 12)] * 9, *[(91, "same words " * 12)] * 5]
    target = [(k, text()) for k in range(20)] + [(None, None)]
    frames = [spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS score", "2 AS rank", "3 AS n") for rows in (docs, target)]
    got = importance.resample(*frames, percent=30, least_words=8, sizes=sizes, buckets=buckets)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(str(list(r)) for r in got.collect()) == plain(docs, target, 30, 8, sizes, buckets)


def test_empty_tables(spark):
    some = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    assert importance.resample(some.limit(0), some).count() == 0
    row = importance.resample(some, some.limit(0), percent=100, least_words=1).first()
    assert row.rank == 1 and row.n_features == 3
