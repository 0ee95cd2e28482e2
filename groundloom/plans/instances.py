"""Instances, graphs and scores from the documents and labels tables.

A labelled document is an answer about itself: its first half is the context, its first line the question and
its second half the response; a document of low quality or toxic text is the positive class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundloom.config import Config
from groundloom.functions.vectors import letter_counts
from groundloom.operators import extract, scoring
from groundloom.sources.jsonl import first_of, write_jsonl
from groundloom.sources.staging import new_path, staged


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    key = F.col("doc_id").cast("string")
    half = F.floor(F.length("text") / 2).cast("int")
    first_line = F.element_at(F.split("text", "\n"), 1)
    return docs.select(
        key.alias("response_id"),
        key.alias("source_id"),
        F.col("lang").alias("task"),
        F.col("source").alias("gen_model"),
        F.when(F.substring(F.md5(key), 1, 1) < "8", "train").otherwise("test").alias("split"),
        F.substring("text", F.lit(1), half).alias("context"),
        F.when(first_line != "", first_line).alias("query"),
        F.substring("text", half + 1, F.length("text")).alias("response"),
        F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("y"),
    )


def graphs(given: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Graphs of the responses, contexts and questions; contexts and questions once for each source."""
    sources = first_of(given, "source_id", "response_id", ["context", "query"])
    answers = extract.offline_graph(given.select("response_id", "source_id", "response"), "response", phrases=True).drop("response")
    for c in ("context", "query"):
        sources = extract.offline_graph(sources, c).withColumn(c, F.struct("entities", "relations")).drop("entities", "relations")
    sources = staged(sources, "source-graphs")
    return staged(answers, "answer-graphs"), sources.select("source_id", "context.*"), sources.select("source_id", "query.*")


def scored(given: DataFrame, config: Config, vectors: bool = True) -> DataFrame:
    return scoring.score(*graphs(given), config.match, letter_counts if vectors else None)


def rows(spark: SparkSession, sf_dir: str, config: Config | None = None, alpha: float = 0.7) -> DataFrame:
    """Evaluation rows of all instances."""
    given = instances(spark, sf_dir)
    return staged(scoring.eval_rows(scored(given, config or Config()), given, alpha), "eval-rows")


def written_corpus(spark: SparkSession, sf_dir: str) -> str:
    """A folder of source and response records as JSON lines, made from the tables.

    A document is a source: its first half is the text of a QA, Data2txt or Summary record by its number. It is
    answered by its second half if it is labelled, and by the assistant's turns of the conversation of its
    number; the user's turns name no source. Every fifth source has an older record before its own.
    """
    docs, key = read(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    half = F.floor(F.length("text") / 2).cast("int")
    context, first_line = F.substring("text", F.lit(1), half), F.element_at(F.split("text", "\n"), 1)
    kind = F.element_at(F.array(*map(F.lit, ("QA", "Data2txt", "Summary"))), (F.col("doc_id") % 3 + 1).cast("int"))
    about = F.struct(F.col("n_chars").alias("chars"), F.array("lang", "source").alias("marks"))
    business = F.to_json(F.struct(F.col("source").alias("name"), F.col("lang").alias("language"), about.alias("about"), F.array(F.struct(context.alias("review_text"))).alias("review_info")))
    info = F.when(kind == "QA", F.to_json(F.struct(context.alias("passages"), first_line.alias("question")))).when(kind == "Data2txt", business).otherwise(context)
    prompt = F.when(kind == "Summary", F.concat(F.lit("Summarize in "), "lang"))
    sources = docs.select("doc_id", F.lit(1).alias("version"), key.alias("source_id"), kind.alias("task_type"), "source", info.alias("source_info"), prompt.alias("prompt"))
    older = sources.where("doc_id % 5 = 0").withColumns({"version": F.lit(0), "task_type": F.lit("Summary"), "source_info": F.lit("old")})
    folder = new_path(spark, "corpus")
    write_jsonl(sources.unionByName(older).orderBy("version", "doc_id").drop("version", "doc_id"), f"{folder}/source_info.jsonl")

    span = lambda label, implied: F.struct(label.alias("label_type"), implied.alias("implicit_true"))
    spans = F.filter(F.array(span(F.when(F.col("toxic") == 1, "toxic"), F.col("quality").cast("string")), span(F.when(F.col("quality") == 0, "low quality"), F.lit("no"))), lambda s: s["label_type"].isNotNull())
    split = F.when(F.substring(F.md5(key), 1, 1) < "8", "train").otherwise("test")
    own = docs.join(read(spark, sf_dir, "labels"), "doc_id").select(
        key.alias("id"), key.alias("source_id"), F.col("source").alias("model"), split.alias("split"), F.lit("good").alias("quality"),
        F.substring("text", half + 1, F.length("text")).alias("response"), spans.alias("labels"),
    )
    turns = read(spark, sf_dir, "conversations").where("role IN ('assistant', 'user')")
    conv = F.col("conv_id").cast("string")
    said = turns.select(F.concat(F.lit("t"), conv, F.lit("-"), "turn").alias("id"), F.when(F.col("role") == "user", F.concat(F.lit("c"), conv)).otherwise(conv).alias("source_id"), F.col("text").alias("response"))
    write_jsonl(own.unionByName(said, allowMissingColumns=True), f"{folder}/response.jsonl")
    return folder
