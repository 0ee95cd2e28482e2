"""Rows of one group compared in blocks, and the records that the library reads."""

from groundloom.config import MatchConfig
from groundloom.functions.vectors import letter_counts, model_embedder
from groundloom.operators import matching
from groundloom.sources import jsonl


def test_blocks_lose_and_repeat_no_pair(spark):
    left = spark.createDataFrame([("a", f"l{k}") for k in range(23)] + [("b", "l0"), ("only left", "x")], "g string, l string")
    right = spark.createDataFrame([("a", f"r{k}") for k in range(17)] + [("b", "r0"), ("only right", "y")], "g string, r string")
    want = sorted((a.g, a.l, b.r) for a in left.collect() for b in right.collect() if a.g == b.g)
    for block in (1, 4, 1024):
        assert sorted(tuple(r) for r in matching.in_blocks(left, right, ["g"], ["l"], ["r"], block).collect()) == want
    assert matching.in_blocks(left.limit(0), right, ["g"], ["l"], ["r"]).count() == 0


def test_vectors_of_many_names_in_one_source(spark):
    refs = spark.createDataFrame([("s", f"{chr(97 + k)}{chr(97 + j)}qq{k}") for k in range(20) for j in range(20)], "source_id string, w string")
    names = spark.createDataFrame([("s", "qqab9"), ("s", "zzzz")], "source_id string, v string")
    found = {r.v: (r.ref, r.method) for r in matching.match_entities(names, refs, MatchConfig(), letter_counts).collect()}
    assert found == {"qqab9": ("abqq0", "embedding")}


def test_first_and_limited(spark):
    df = spark.createDataFrame([("s", 2, "b"), ("s", 1, None), ("t", 3, "c")], "k string, n int, v string")
    assert sorted((r.k, r.v) for r in jsonl.first_of(df, "k", "n", ["v"]).collect()) == [("s", None), ("t", "c")]
    assert [r.n for r in jsonl.limited(df, 2, "n").collect()] == [1, 2] and jsonl.limited(df, None, "n").count() == 3


def test_a_model_embeds_names(spark):
    def load():
        return lambda texts: [[float(t.count("q")), float(len(t)), 1.0] for t in texts]

    refs = spark.createDataFrame([("s", "qqqq"), ("s", "abcd")], "source_id string, w string")
    names = spark.createDataFrame([("s", "xqqqx"), ("t", "qqqq")], "source_id string, v string")
    found = [tuple(r) for r in matching.match_entities(names, refs, MatchConfig(), model_embedder(load)).collect()]
    assert found == [("s", "xqqqx", "qqqq", "embedding")]
