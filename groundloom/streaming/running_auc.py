"""A running AUC of answers as their risks arrive, each answer once however often it is delivered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from groundloom.functions.metrics import finite
from groundloom.operators import ranking

#: Ranges of a score between 0 and 1.
RANGES = 4096


def running_counts(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """stream (response_id, y, h and the time `at`) -> at_range, y, n: counts by range of the score, of the answers so far.

    An answer that comes again within `late` of the first time is dropped; the state held is the ids of that
    while, and a row for each range and class. Risks outside 0 to 1 count in the outer ranges, undefined ones not at all.
    """
    once = stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["response_id"]).where(finite(F.col("h")))
    place = F.least(F.greatest(F.floor(F.col("h") * RANGES), F.lit(0)), F.lit(RANGES)).cast("int")
    return once.groupBy(place.alias("at_range"), "y").agg(F.count(F.lit(1)).alias("n"))


def auc_of_counts(counts: DataFrame) -> DataFrame:
    """n, n_pos, u and auc of counts by range; scores of one range count as equal."""
    return ranking.auc(counts, [], h="at_range", weight=F.col("n"))


def run(stream: DataFrame, out: str, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """Keeps the counts as they stand after each micro-batch in the table of that batch's own folder; a batch that is run again replaces it."""

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return running_counts(stream, late).writeStream.outputMode("complete").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
