"""Each operator against a brute-force version, on small tables with nulls, empty texts, ties and repeated rows."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from groundloom.llm import bpe, chat_format, embedding_dedup, fingerprints, language_id, line_dedup, llm_queries, mixing, secret_scan, simhash, token_files

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, "it's  a\n\n test's<|endoftext|> 日本 x", "a" * 300, "we'll 12 ½ \t\t", "word " * 5000, "same text here", "same text here"]


@pytest.fixture
def docs(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(TEXTS)] + [(None, "no id", None, None, None), (7, "same text here", "en", "s", 0)]
    return spark.createDataFrame(rows, DOCS).withColumn("text_1", F.lit(1))


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_bpe_is_the_library_s(docs, empty, library):
    rows = bpe.round_trip(docs, PATH).collect()
    assert len(rows) == docs.count() and bpe.round_trip(empty, PATH).count() == 0
    for r in rows:
        text = "no id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert all(r.text == ("no id" if r.doc_id is None else TEXTS[r.doc_id] or "") for r in back)


def test_token_files_round_trip(spark, docs, empty, library, tmp_path):
    token_files.write(docs, str(tmp_path / "t"), PATH, 2, 50_257, block_tokens=50)
    rows = sorted(token_files.read_documents(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, *range(8), 7][: len(rows)] or [r.doc_id for r in rows] == [None, 0, 1, 2, 3, 4, 5, 6, 7, 7]
    at, flat = 0, []
    for r in rows:
        ids = library.encode("no id" if r.doc_id is None else TEXTS[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.token_ids) == (at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
        flat += ids
    part = sorted(token_files.read_range(spark, str(tmp_path / "t"), 100, 200).collect())
    assert [i for r in part for i in r.token_ids] == flat[100:300]
    token_files.write(empty, str(tmp_path / "e"), PATH, 2, 50_257)
    assert token_files.read_documents(spark, str(tmp_path / "e")).count() == 0
    ids = np.arange(1000) % 7
    assert (token_files.unpack(token_files.pack(ids, 3), 3, 5, 900) == ids[5:905]).all()


def test_chat_format_keeps_maximal_conversations(spark):
    turns = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, "user", "ab"), (5, 0, None, None), (None, 0, "user", "<|im_end|>")]
    rows = {r.conv_id: r for r in chat_format.render(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert set(rows) == {2, 4, 5, None} and rows[2].n_logged == 2
    assert rows[2].rendered == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"
    assert "<| im_end|>" in rows[None].rendered


def test_secret_scan(spark):
    key, uuid = "AKIA" + "Q7Z" * 6, "123e4567-e89b-12d3-a456-426614174000"
    text = f"é Password: 'hunter22' {key} {'0a' * 16} zQ9x7Kp2Vw8Rt5Yb3Nm6Jh1 {uuid} token=abc plain words"
    row = secret_scan.scan(spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).orderBy("doc_id").collect()
    one = row[0]
    assert (one.n_assign, one.n_access, one.n_hex, one.n_random, row[1].spans) == (1, 1, 1, 1, "")
    spans = [s.split(":") for s in one.spans.split(",")]
    assert [text[int(a) : int(b)] for _, a, b in spans] == ["Password: 'hunter22", key, "0a" * 16, "zQ9x7Kp2Vw8Rt5Yb3Nm6Jh1"]
    base = ",".join(":".join(s) for s in spans[:3])
    assert one.base_sha256 == hashlib.sha256(base.encode()).hexdigest()


def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.predict(docs, language_id.fit(docs, per_language=60), keep=["lang"]).where(language_id.held_out(F.col("doc_id")))
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    odd = spark.createDataFrame([(1, None), (2, "123 !"), (3, "")], "doc_id bigint, text string")
    assert {(r.lang_pred, r.score) for r in language_id.predict(odd, None).collect()} == {("und", 0.0)}


def reached(n, links):
    label = list(range(n))
    while True:
        new = label[:]
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("most", [16_384, 3])
def test_trie_links_join_what_brute_force_joins(spark, most):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [b ^ np.uint64(1 << int(k)) ^ np.uint64(1 << int(j)) for b in base for k, j in rng.integers(0, 64, (4, 2))]
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64)])).view(np.int64)
    found = simhash.trie_links(spark.createDataFrame([(int(f),) for f in fps], "fp bigint"), 3, most).collect()
    place = {int(f): i for i, f in enumerate(fps)}
    brute = [(i, j) for i in range(len(fps)) for j in range(i) if bin((int(fps[i]) ^ int(fps[j])) & (2**64 - 1)).count("1") <= 3]
    assert reached(len(fps), [(place[r.a], place[r.b]) for r in found]) == reached(len(fps), brute)


def test_simhash_groups(spark, docs, empty):
    rows = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert rows[(0, 0)] == rows[(1, 0)] == 0 and {c for (d, _), c in rows.items() if d in (6, 7)} == {6}
    assert simhash.near_duplicates(empty).count() == 0


def test_line_dedup_keeps_the_first(spark, empty):
    rows = [(i, f"shared line \nown {i}\n", "en", f"s{i}", 0) for i in range(6)] + [(9, None, None, None, None), (10, "", "en", None, 0)]
    found = {r.doc_id: r for r in line_dedup.dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert found[0].text == "shared line \nown 0\n" and found[3].text == "own 3\n" and found[3].n_removed == 1
    assert found[9].text is None and found[10].text == "" and line_dedup.dedup(empty).count() == 0


@pytest.mark.parametrize("most", [2048, 8])
def test_embedding_links(spark, most):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 64))
    vectors = np.concatenate([b + 0.2 * rng.normal(size=(6, 64)) for b in base] + [base[:1]] * 3).astype(np.float32)
    rows = [(i, [float(x) for x in v], int(i % 2)) for i, v in enumerate(vectors)]
    rows += [(100, None, 1), (101, [0.0] * 64, 1), (102, [float("nan")] * 64, 1), (103, rows[0][1], None), (104, [], 0)]
    found = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"), most=most).collect()}
    v = vectors.astype(np.float64)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    links = [(i, j) for i in range(len(v)) for j in range(len(v)) if i != j and i % 2 == j % 2 and unit[i] @ unit[j] >= 0.93]
    label = reached(len(v), links)
    for i in range(len(v)):
        assert (found[i].n_links, found[i].component_id) == (sum(a == i for a, _ in links), label[i])
    assert all(found[i].n_links == 0 and found[i].component_id == i and found[i].kept for i in range(100, 105))


def test_mixing_meets_targets(spark, empty):
    rows = [(i, "w " * (i % 7), "en", (None, "a", "b", "c")[i % 4], 0) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"size": mixing.words(F.col("text")), "key": mixing.order_key()})
    found = mixing.assign(docs.select("doc_id", "source", "size", "key")).collect()
    per = {}
    for r in found:
        assert 0 <= r.taken <= 3 * r.size
    for r in mixing.assign(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 1
        per[r.source] = r.target
    assert sum(per.values()) == pytest.approx(sum(r.size for r in found)) and per["b"] > per["a"]
    mixed = mixing.mix(docs.drop("size", "key"))
    assert mixed.select(F.sum(mixing.words(F.col("text")))).first()[0] == sum(r.taken for r in found)
    assert mixing.assign(empty.withColumns({"size": F.lit(0), "key": mixing.order_key()})).count() == 0


def test_mixing_takes_the_same_texts_however_rows_are_dealt(spark):
    rows = [(None if i % 3 else 5, f"words of number {i} " * (i % 4), "en", f"s{i % 2}" if i % 7 else None, 0) for i in range(200)] + [(None, "copy of a text", None, "s0", 1)] * 30
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS key", "2 AS tie", "3 AS taken", "4 AS size")
    found = [sorted(map(str, mixing.mix(docs.repartition(n)).collect())) for n in (3, 7, 1)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 50
    ranges = docs.select(F.substring(mixing.order_key(), 1, mixing.RANGE_DIGITS).alias("r")).where("doc_id IS NULL").distinct().count()
    assert ranges > 100  # rows without an id are spread


def test_fingerprints(spark, docs):
    rows = sorted(fingerprints.edited_fingerprints(docs).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert len(rows) == docs.count()
    order = ["no id", *(t or "" for t in TEXTS)]
    for r in rows:
        i = 0 if r.doc_id is None else r.doc_id + 1
        text, after = order[i], order[(i + 1) % len(order)]
        q = len(text) // 4
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256((text[: len(text) - q] + after[:q]).encode()).hexdigest()
        own, edited, following = ({p.strip(" \t\r\n") for p in re.findall(fingerprints.PARAGRAPH, t)} - {""} for t in (text, text[: len(text) - q] + after[:q], after))
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert r.near_edited == pytest.approx(like(own, edited)) and r.near_next == pytest.approx(like(own, following))
    assert len({r.fingerprint for r in rows if r.doc_id in (6, 7)}) == 1


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in llm_queries.queries()) == list(range(1, 11))
