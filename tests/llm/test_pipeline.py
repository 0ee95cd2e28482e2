"""The pipeline's stages on a small table with null and repeated ids, repeated rows and clashing column names."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, lang_pred string, __kept string, token_ids string, node int, size int, n_lines int"
EN, DE = "the quick brown fox jumps over the lazy dog and runs away into the woods at night", "der schnelle braune fuchs springt über den faulen hund und läuft nachts in den wald"


def row(i, text, lang="en", source="s0"):
    return (i, text, lang, source, len(text or ""), 0.5, "x", "y", "z", 1, 2, 3)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [row(i, f"{(EN, DE)[i % 2]} {i} {i * i} {i**3}\nshared by many sites\n", ("en", "de")[i % 2], f"s{i % 7}") for i in range(40)]
    rows += [row(100, rows[0][1]), row(None, "only one without an id stands here alone for ever"), row(None, rows[1][1]), row(5, "another text under an id that was given before"), row(5, rows[5][1])]
    rows += [row(101, None), row(102, ""), row(103, "123 !"), row(104, "shared by many sites", source="s3")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_known_language(spark, docs):
    found = corpus_pipeline.known_language(spark, docs, "")
    assert found.columns == docs.columns
    assert rows_of(found) == rows_of(docs.where(F.col("text").rlike("[a-z]")))
    assert corpus_pipeline.known_language(spark, docs.limit(0), "").count() == 0


def test_unshared_lines(spark, docs):
    found = corpus_pipeline.unshared_lines(spark, docs, "")
    assert found.columns == docs.columns and found.where("doc_id = 104").count() == 0
    texts = {(r.doc_id, r.text) for r in found.collect()}
    assert (0, f"{EN} 0 0 0\nshared by many sites\n") in texts and (2, f"{EN} 2 4 8\n") in texts
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and r.n_lines == 3 for r in found.collect())


def test_one_of_each_group(spark, docs):
    rows = corpus_pipeline.one_of_each_group(spark, docs, "").collect()
    kept = [(r.doc_id, r.text) for r in rows]
    assert len(kept) == len(set(kept)) and (5, "another text under an id that was given before") in kept
    assert (100, f"{EN} 0 0 0\nshared by many sites\n") not in kept and sum(d is None for d, _ in kept) == 1
    assert rows_of(spark.createDataFrame(rows, docs.schema)) == rows_of(corpus_pipeline.one_of_each_group(spark, docs.repartition(5), ""))


def test_mixed(spark, docs):
    found = corpus_pipeline.mixed(spark, docs, "")
    assert found.columns == docs.columns
    count = lambda df: df.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert abs(count(found) - count(docs)) <= found.select("source").distinct().count()


def test_tokens_decode_to_the_text(spark, docs):
    library = Tokenizer.from_file(corpus_pipeline.BYTE_BPE)
    given = sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    rows = corpus_pipeline.tokens(spark, docs, "").collect()
    assert sorted((str(r.doc_id), library.decode(r.token_ids, skip_special_tokens=False)) for r in rows) == given
    assert all(r.n_tokens == len(r.token_ids) for r in rows)


def test_run_is_its_stages_in_order(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = docs
    for _, stage in corpus_pipeline.STAGES:
        found = stage(spark, now, "")
        now = spark.createDataFrame(found.collect(), found.schema)
    assert rows_of(corpus_pipeline.run(spark, str(tmp_path))) == rows_of(now)
    docs.limit(0).write.parquet(str(tmp_path / "e/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "e")).count() == 0
