"""Runs a corpus of JSON lines to graphs, scores, tuning, evaluation and audits.

python -m groundloom.plans.cli [--data-dir D] [--output-dir O] [--config C] [--stage all|extract|score|tune|evaluate]
    [--limit N] [--fake-extractor] [--extractor MODULE:NAME] [--embedder MODULE:NAME] [--cache FOLDER] [--no-audit]

Folders not given are those of the configuration. --limit takes the first answers of the file.
--extractor names a function without arguments that gives a backend's generate(text, cluster, chunk_size), and
--embedder one that gives a function from a list of texts to their vectors; without them, or with
--fake-extractor, the offline extractor and letter counts are used. Each stage reads what those before it wrote.
"""

from __future__ import annotations

import argparse
import importlib
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundloom.config import Config, load_config
from groundloom.functions.metrics import risk
from groundloom.functions.vectors import Embedder, letter_counts, model_embedder
from groundloom.operators import extract, scoring, tuning
from groundloom.plans import evaluate
from groundloom.sources import jsonl
from groundloom.sources.staging import staged

STAGES = ("all", "extract", "score", "tune", "evaluate")
GRAPHS = ("answers", "contexts", "questions")


def _named(name: str):
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def extract_graphs(instances: DataFrame, config: Config, cache: str, load=None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Graphs of answers, contexts and questions with their errors, contexts and questions once for each source; and the log of calls."""
    sources = jsonl.first_of(instances, "source_id", "response_id", ["context", "query"])
    found = extract.chunked_graphs if config.extract.own_chunks else extract.cached_graphs

    def of(texts: DataFrame, key: str, column: str, kind: str) -> extract.Extracted:
        if load:
            made = lambda df: extract.backend_graph(df, "cache_key", "text", load, config.extract)
        else:
            made = lambda df: extract.offline_graph(df, "text", phrases=kind == "answers").drop("text")
        return found(texts, key, column, kind, cache, made, config.extract)

    done = {"contexts": of(sources, "source_id", "context", "contexts"), "questions": of(sources, "source_id", "query", "questions"), "answers": of(instances, "response_id", "response", "answers")}
    graphs = {k: x.graphs for k, x in done.items()}
    graphs["answers"] = graphs["answers"].join(instances.select("response_id", "source_id"), "response_id")
    return graphs, extract.call_log([x.calls for x in done.values()])


def _good(graphs: dict[str, DataFrame]) -> list[DataFrame]:
    """Answers, contexts and questions of the sources whose graphs are whole."""
    bad = graphs["contexts"].where("error IS NOT NULL").select("source_id").union(graphs["questions"].where("error IS NOT NULL").select("source_id"))
    return [graphs[k].where("error IS NULL").drop("error").join(bad, "source_id", "left_anti") for k in GRAPHS]


def _text(spark: SparkSession, value: str, path: str) -> None:
    spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser()
    for name in ("config", "data-dir", "output-dir", "extractor", "embedder", "cache"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--stage", choices=STAGES, default="all")
    parser.add_argument("--limit", type=int)
    parser.add_argument("--fake-extractor", action="store_true")
    parser.add_argument("--no-audit", action="store_true")
    given = parser.parse_args(args)
    config = load_config(given.config) if given.config else Config()
    load = _named(given.extractor) if given.extractor and not given.fake_extractor else None
    embed: Embedder = model_embedder(_named(given.embedder)) if given.embedder and not given.fake_extractor else letter_counts
    spark, out, began = SparkSession.builder.getOrCreate(), given.output_dir or config.output_dir, time.time()
    data = config.data
    instances = staged(jsonl.load_instances(spark, given.data_dir or data.dir, data.exclude_implicit_true, data.splits, given.limit), "instances")
    wants = lambda stage: given.stage in ("all", stage)

    if given.stage != "evaluate":
        graphs, calls = extract_graphs(instances, config, given.cache or config.cache_dir or f"{out}/graph-cache", load)
        jsonl.write_jsonl(calls, f"{out}/usage")
        for k in GRAPHS:
            graphs[k].write.mode("overwrite").parquet(f"{out}/graphs/{k}")
        graphs = {k: spark.read.parquet(f"{out}/graphs/{k}") for k in GRAPHS}
        jsonl.write_failures(evaluate.failures(instances, graphs["answers"], graphs["contexts"], graphs["questions"]), f"{out}/failed")
    if given.stage == "extract":
        return
    if given.stage != "evaluate":
        scoring.score(*_good(graphs), config.match, embed).write.mode("overwrite").parquet(f"{out}/scored")
    if given.stage == "score":
        return
    scored, alpha = spark.read.parquet(f"{out}/scored"), config.evaluate.alpha
    if wants("tune"):
        rows = staged(scoring.eval_rows(scored, instances, 0.7 if alpha is None else alpha), "train-rows").where("split = 'train'")
        tuned = evaluate.tune(rows, config.evaluate)
        answers, contexts, questions = _good(graphs)
        train = tuning.sample(answers.join(rows.select("response_id"), "response_id", "left_semi"), config.evaluate.sweep_answers)
        sweep = tuning.threshold_sweep(train, contexts, questions, rows, embed, config.match, config.evaluate, tuned["alpha"])
        tuned["tau_sweep"] = [r.asDict() for r in sweep.orderBy("tau_e", "tau_r").collect()]
        _text(spark, json.dumps(tuned), f"{out}/tuning")
    if given.stage == "tune":
        return
    tuned = json.loads(spark.read.text(f"{out}/tuning").first()[0])
    alpha, theta = tuned["alpha"], tuned["theta"]
    rows = staged(scoring.eval_rows(scored, instances, alpha), "eval-rows")
    test = rows.where("split = 'test'")
    results = evaluate.tables(test, alpha, theta, config.evaluate)
    jsonl.write_csv(rows, f"{out}/metrics")
    failed = spark.read.schema(jsonl.FAILURES).json(f"{out}/failed").count()
    summary = staged(evaluate.summary(results, test.withColumn("h", risk(F.col("EG"), F.col("RP"), alpha)), tuned, config.match, theta, failed), "summary")
    jsonl.write_csv(summary.coalesce(1), f"{out}/summary")
    if not config.evaluate.histograms:
        del results["histogram"]
    settings = {"model": config.extract.model, "embedding_model": config.match.embedding_model, "empty_response_graph_policy": config.evaluate.empty_response_graph_policy}
    usage = extract.call_summary(spark.read.schema(extract.CALLS).json(f"{out}/usage")).first().asDict()
    _text(spark, evaluate.report(results, tuned, usage, summary.first().asDict(), settings), f"{out}/report")
    print(json.dumps(summary.select(*evaluate.SHORT).first().asDict()))
    if not given.no_audit:
        kept = evaluate.audits(scored, instances, alpha, theta, config.evaluate.empty_response_impute_h, {"run": round(time.time() - began, 3)})
        kept.select("split", F.col("record").alias("value")).write.mode("overwrite").partitionBy("split").text(f"{out}/audits")


if __name__ == "__main__":
    main()
