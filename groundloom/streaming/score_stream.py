"""Scores answers as they arrive: each micro-batch is joined to the static graphs of its sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from groundloom.config import MatchConfig
from groundloom.functions.vectors import Embedder
from groundloom.operators import extract, scoring


def score_stream(answers: DataFrame, contexts: DataFrame, questions: DataFrame, out: str, checkpoint: str, config: MatchConfig, embed: Embedder | None = None) -> StreamingQuery:
    """answers: a stream of response_id, source_id and response. A batch that is run again replaces its own folder."""

    def one(batch: DataFrame, number: int) -> None:
        graphs = extract.offline_graph(batch, "response", phrases=True).drop("response")
        scoring.score(graphs, contexts, questions, config, embed).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return answers.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
