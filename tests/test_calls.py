"""Calls of a backend: order, overlap, waits, rate, usage and chunks."""

import time

import pytest
from pyspark.sql import functions as F

from groundloom.config import ExtractConfig
from groundloom.operators import extract


def slow():
    """A backend as workers load it."""

    def load():
        def generate(text, cluster, chunk):
            began = time.monotonic()
            time.sleep(0.2)
            if text == "fail":
                raise ValueError
            return [text], [(began, "to", time.monotonic())], {"prompt_tokens": len(text), "completion_tokens": 2, "cost": 0.5}

        return generate

    return load


def test_calls_overlap_and_rows_keep_their_order(spark):
    texts = spark.createDataFrame([(k, f"text {k}") for k in range(40)], "id int, text string").coalesce(1)
    config = ExtractConfig(concurrency=8, calls_per_task=8)
    rows = extract.backend_graph(texts, "id", "text", slow(), config).collect()
    spans = [(float(r.relations[0].s), float(r.relations[0].o)) for r in rows]
    under_way = [sum(a <= x < b for a, b in spans) for x, _ in spans]
    assert 4 <= max(under_way) <= 8
    assert [r.id for r in rows] == list(range(40)) and all(r.entities == [f"text {r.id}"] and r.calls == 1 and r.seconds >= 0.19 for r in rows)
    assert sum(r.cost_usd for r in rows) == 20.0


def test_waits_double_and_errors_stay(spark, monkeypatch):
    assert extract.waits(ExtractConfig()) == [2.0, 4.0, 8.0, 16.0]

    def load():
        def generate(text, cluster, chunk):
            raise ValueError(text)

        return generate

    config = ExtractConfig(max_retries=4, backoff_multiplier=0.05)
    (row,) = extract.backend_graph(spark.createDataFrame([(1, "x")], "id int, text string"), "id", "text", load, config).collect()
    assert row.calls == 4 and "ValueError" in row.error and 0.35 <= row.seconds < 5


def test_the_cluster_s_rate_is_shared(spark):
    texts = spark.createDataFrame([(k, "t") for k in range(12)], "id int, text string")
    config = ExtractConfig(concurrency=8, calls_per_task=4, calls_per_second=10.0)
    began = time.monotonic()
    rows = extract.backend_graph(texts, "id", "text", lambda: lambda *x: ([], []), config).collect()
    # 6 calls in each of 2 tasks, one every 0.2 seconds.
    assert len(rows) == 12 and time.monotonic() - began >= 0.9


def test_log_and_summary(spark, tmp_path):
    texts = spark.createDataFrame([(1, "aa"), (2, "bbbb"), (3, "aa"), (4, ""), (5, "fail")], "id int, text string").coalesce(1)
    config = ExtractConfig(max_retries=2, backoff_multiplier=0.0)
    run = lambda: extract.cached_graphs(texts, "id", "text", "t", str(tmp_path), lambda df: extract.backend_graph(df, "cache_key", "text", slow(), config), config)
    log = extract.call_log([run().calls, run().calls])
    rows = log.orderBy("seq").collect()
    assert [(r.cum_calls, r.cum_prompt_tokens, r.cum_cost_usd) for r in rows[:3]] == [(1, 2, 0.5), (2, 6, 1.0), (2, 6, 1.0)]
    assert rows[-1].cum_calls == 2 and [r.cached for r in rows] == [False, False, True, False] + [True, True, True, False]
    total = extract.call_summary(log).first()
    assert (total.api_calls, total.estimated_cost_usd, total.prompt_tokens, total.completion_tokens, total.attempts, total.failed, total.cache_hits) == (2, 1.0, 6, 4, 6, 2, 4)


def test_chunks_end_with_sentences_and_lose_nothing(spark):
    texts = ["One. Two! Three? Four", "x" * 25 + ". y", "", None, "a.b.c.d.e.f.g.h", "no end at all here", "...!!!", "ends. \n\n "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", extract.chunks(F.col("t"), 10).alias("c")).collect()
    for r in rows:
        assert "".join(r.c) == (r.t or "") and all(0 < len(c) <= 10 for c in r.c)
    assert rows[0].c == ["One. Two! ", "Three? ", "Four"] or rows[0].c == ["One. Two! ", "Three? Four"[:10], "r"]


def test_chunked_graphs_resume_from_the_cache(spark, tmp_path):
    texts = spark.createDataFrame([(1, "Aa bb. Cc dd. Ee ff."), (2, "Cc dd. Aa xx."), (3, None)], "id int, text string")
    asked = spark.sparkContext.accumulator(0)

    def load():
        def generate(text, cluster, chunk):
            asked.add(1)
            if "Ee" in text and not (tmp_path / "up").exists():
                raise ValueError("down")
            return text.strip(" .").split(), [tuple([*text.strip(" .").split(), "x"])]

        return generate

    config = ExtractConfig(context_chunk_chars=7, max_retries=1)
    run = lambda: extract.chunked_graphs(texts, "id", "text", "c", str(tmp_path / "cache"), lambda df: extract.backend_graph(df, "cache_key", "text", load, config), config).graphs
    first = {r.id: r for r in run().collect()}
    assert "down" in first[1].error and first[1].entities == [] and first[2].entities == ["Aa", "Cc", "dd", "xx"] and first[3].entities == []
    before = asked.value
    (tmp_path / "up").touch()
    second = {r.id: r for r in run().collect()}
    assert asked.value == before + 1 and second[1].entities == ["Aa", "Cc", "Ee", "bb", "dd", "ff"] and len(second[1].relations) == 3


@pytest.mark.parametrize("concurrency, share", [(4, 10), (8, 5)])
def test_more_texts_are_called_for_in_rounds(spark, monkeypatch, concurrency, share):
    """No task reads more than its share, and no more calls than asked for are under way."""
    monkeypatch.setattr(extract, "FILE_ROWS", 10)
    monkeypatch.setattr(extract, "TASK_BYTES", 1)

    def load():
        seen = []

        def generate(text, cluster, chunk):
            seen.append(text)
            began = time.monotonic()
            time.sleep(0.05)
            return [text], [(began, len(seen), time.monotonic())]

        return generate

    texts = spark.createDataFrame([(k, f"text {k}") for k in range(40)], "id int, text string").coalesce(1)
    rows = extract.backend_graph(texts, "id", "text", load, ExtractConfig(concurrency=concurrency, calls_per_task=4)).collect()
    assert sorted((r.id, *r.entities) for r in rows) == [(k, f"text {k}") for k in range(40)]
    assert max(int(r.relations[0].r) for r in rows) <= share
    spans = [(float(r.relations[0].s), float(r.relations[0].o)) for r in rows]
    assert max(sum(a <= x < b for a, b in spans) for x, _ in spans) <= concurrency
