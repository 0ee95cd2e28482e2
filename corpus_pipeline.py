"""A training corpus from the documents table, by five operators of groundloom.llm, each stage a written table.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of documents.
Null text or source, null and repeated ids and empty tables go through as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundloom.llm import bpe, language_id, line_dedup, mixing, scratch, simhash
from groundloom.llm.batches import keep_batches_small

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
#: SQL for run()'s rows: none, as the first stage trains a network.
ORACLE_SQL = None


#: Below this score (the mean probability of the likeliest language) a document is in none of the languages.
LEAST_SCORE = 0.3


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns named c0, c1 and on, which clash with no operator's own, and those names by the given ones."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _given(found: DataFrame, names: dict[str, str]) -> DataFrame:
    return found.select(*(F.col(plain).alias(c) for c, plain in names.items()))


def _lengths(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which the network sees a language; null text, text without a letter and scores under LEAST_SCORE go."""
    keep_batches_small(spark)
    plain, names = _plain(docs)
    columns = {"id_col": names["doc_id"], "text_col": names["text"]}
    net = language_id.fit(plain, lang_col=names["lang"], **columns)
    found = language_id.predict(plain, net, keep=list(names.values()), **columns)
    return _given(found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)), names)


def unshared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sources share; those of which nothing is left go."""
    plain, names = _plain(docs)
    found = line_dedup.dedup(plain, id_col=names["doc_id"], text_col=names["text"], source_col=names["source"])
    empty = (F.col("n_removed") > 0) & (F.btrim(names["text"], F.lit(" \t\r\n")) == "")
    return _lengths(_given(found.where(~F.coalesce(empty, F.lit(False))), names))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word Jaccard similarity of 0.8 or more).

    The one of the smallest id stays, an id before none; of rows of one id the smallest by hash of the text,
    then of the other columns. Rows of one id with different texts are documents of their own.
    """
    keep_batches_small(spark)
    near = simhash.similar_texts(docs)
    names = docs.columns
    node = F.xxhash64(F.coalesce("text", F.lit("")))
    rest = F.xxhash64(*(F.col(f"`{c}`") for c in names if c != "text"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), node.alias("node"), rest.alias("rest"))
    order = F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("doc_id"), "node", "rest")
    texts = rows.groupBy("node").agg(F.min(order).alias("first"))
    groups = texts.join(near, "node", "left").groupBy(F.coalesce("component", "node")).agg(F.min("first").alias("first"))
    kept = scratch.table(groups.select("first.node", "first.rest"), "kept")
    return rows.join(kept, ["node", "rest"], "left_semi").dropDuplicates(["node", "rest"]).select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    plain, names = _plain(docs)
    found = mixing.mix(plain, text_col=names["text"], id_col=names["doc_id"], source_col=names["source"])
    return _lengths(_given(found, names))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token_ids and n_tokens of each mixed document; bpe.decode gives its text back."""
    keep_batches_small(spark)
    found = bpe.encode(docs, BYTE_BPE, keep=["lang", "source"])
    return found.withColumn("n_tokens", F.size("token_ids").cast("bigint"))


STAGES = [
    ("language ID", known_language),
    ("line dedup", unshared_lines),
    ("SimHash near-dedup", one_of_each_group),
    ("mixing sources to target weights", mixed),
    ("BPE encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; each reads the Parquet that the one before it wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(docs, f"stage-{k}")
    return docs
