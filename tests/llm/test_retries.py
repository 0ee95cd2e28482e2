"""Fingerprints of texts that differ in more paragraphs than a sketch has cells, and of empty tables."""

import re

import pytest

from groundloom.llm import fingerprints


def test_pairs_that_need_a_larger_sketch(spark):
    texts = [f"line {i} of text {k}" for k in range(4) for i in range((5, 40, 300, 40)[k])]
    texts = ["\n".join(t for t in texts if t.endswith(f"text {k}")) for k in range(4)] + ["one line", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "1 AS d", "2 AS own", "3 AS pair")
    rows = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    parts = lambda t: {p.strip(" \t\r\n") for p in re.findall(fingerprints.PARAGRAPH, t)} - {""}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, t in enumerate(texts):
        after, q = texts[(i + 1) % len(texts)], len(t) // 4
        assert rows[i].near_next == pytest.approx(like(parts(t), parts(after)))
        assert rows[i].near_edited == pytest.approx(like(parts(t), parts(t[: len(t) - q] + after[:q])))
    assert fingerprints.edited_fingerprints(docs.limit(0)).count() == 0
