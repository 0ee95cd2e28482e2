"""Odd rows of line dedup, chat formatting and the secret scan: no id, repeated ids and rows, ties, clashing names, empty tables."""

import random
import re
import string

import public_tokenizers
from pyspark.sql import functions as F

from groundloom.llm import chat_format, line_dedup, secret_scan, simhash

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_lines_of_documents_without_an_id_and_of_repeated_ids(spark):
    rows = [(None, f"shared\nno id {i}\nshared", f"s{i}") for i in range(6)] + [(3, "shared\nfirst\n shared\t\nlast", "t"), (3, "other text\nshared", "u"), (3, "other text\nshared", "u")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 AS n_lines", "2 AS doc", "3 AS gone", "4 AS row", "5 AS lines")
    found = line_dedup.dedup(docs)
    assert found.columns == ["doc_id", "text", "source", "doc", "gone", "row", "lines", "n_lines", "n_removed"]
    out = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in found.collect()]
    own, rest = "shared\nfirst\nlast", "other text\nshared"
    assert sorted(t for d, t, *_ in out if d is None) == [f"no id {i}" for i in range(6)]
    texts = sorted(t for d, t, *_ in out if d == 3)
    # The line stays in one of the two texts of the smallest id.
    assert texts in (sorted([own, "other text", "other text"]), sorted(["first\nlast", rest, rest]))


def test_a_document_of_many_shared_lines(spark):
    lines = [f"line {i}" for i in range(3000)]
    rows = [(k, "\n".join(lines * 2), f"s{k}") for k in range(6)]
    found = {r.doc_id: r for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert found[0].text == "\n".join(lines) and found[0].n_removed == 3000
    assert found[1].text == "" and found[1].n_removed == found[1].n_lines == 6000


def test_turns_of_one_number_and_repeated_rows(spark):
    turns = [(1, 0, "user", t) for t in "abc"] + [(2, 0, "user", t) for t in "cab"] + [(3, 0, "user", "a")] * 2
    logged = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS a", "2 AS place", "3 AS n_turns")
    rows = {r.conv_id: r for r in chat_format.render(logged).collect()}
    assert set(rows) == {1, 3} and rows[1].n_logged == 2 and rows[3].n_turns == 2
    assert sorted(re.findall("user\n(.)", rows[1].rendered)) == ["a", "b", "c"]
    assert chat_format.render(logged.limit(0)).count() == 0


def naive(text):
    """Base spans by a scan of every place, kind by kind."""
    words, joint = r"(?:password|passwd|secret|token|api_?key)", r"[\"']?\x20*[:=]\x20*[\"']?"
    out = []
    for kind, pattern in (("assign", words + joint + r"([A-Za-z0-9+/_.=-]+)"), ("access", r"(AKIA[A-Z0-9]+)"), ("hex", r"([0-9a-f]+)")):
        at, least = 0, {"assign": 6, "access": 20, "hex": 24}[kind]
        while at < len(text):
            m = re.compile(pattern, re.I | re.A if kind == "assign" else 0).match(text, at)
            if m and len(m[1]) >= least:
                out.append((m.start(), ("assign", "access", "hex").index(kind), kind, m.end()))
            at = max(at + 1, m.end() if m else 0)
    return sorted(out)


def test_base_spans_against_a_scan_of_every_place(spark):
    rng = random.Random(5)
    parts = ["password", "Secret", "API_KEY", "apikey", "tokeN", ": '", "=", " ", "\"", "AKIA", "QWERTY123456789012", "0123456789abcdef" * 2, "x9-._", "é", "\n", "hunter2", "ABCDEF0123", "deadbeef"]
    texts = ["".join(rng.choices(parts, k=30)) for _ in range(300)] + ["", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").selectExpr("*", "1 AS spans", "2 AS n_hex")
    for r in secret_scan.scan(df, RANKS, public_tokenizers.PATTERN).collect():
        base = naive(texts[r.doc_id] or "")
        found = [s for s in r.spans.split(",") if s and not s.startswith("random")]
        assert found == [f"{kind}:{s}:{e}" for s, _, kind, e in base]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(b[1] == k for b in base) for k in range(3))
    assert secret_scan.scan(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_precision_and_recall_of_random_strings():
    """Labelled runs: random strings against words, names and paths joined as in code and addresses."""
    rng = random.Random(6)
    encoding = secret_scan._encoding(RANKS, public_tokenizers.PATTERN)
    hit = lambda t: bool(secret_scan.random_spans(t, secret_scan.pattern_spans(t), encoding, 1.6))
    words = "account settings overview user profile download version release container network response handler configuration server client application international communication".split()
    random_ones = ["".join(rng.choices(string.ascii_letters + string.digits, k=rng.randrange(20, 41))) for _ in range(500)]
    plain = [rng.choice("_-/=").join(rng.choices(words, k=rng.randrange(3, 6))) for _ in range(500)]
    recall = sum(hit(f"see {t} there") for t in random_ones) / 500
    wrong = sum(hit(f"see {t} there") for t in plain)
    assert recall > 0.98 and wrong <= 5


def bits(text, width=3):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c in string.ascii_uppercase else c for c in text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)] * bool(words)
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_in_hex_against_bit_by_bit(spark):
    texts = ["", None, " \t ", "One", "one two", "One TWO three", "a b c a b c a b c", "É é x\x0by z w", "w " * 3000, *(" ".join(random.Random(i).choices(string.ascii_lowercase, k=40)) for i in range(20))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").selectExpr("*", "1 AS fp", "2 AS least")
    rows = simhash.near_duplicates(df).select("doc_id", simhash.hex_of(F.col("fp")).alias("hex")).collect()
    assert {r.doc_id: r.hex for r in rows} == {i: f"{bits(t):016x}" for i, t in enumerate(texts)}
