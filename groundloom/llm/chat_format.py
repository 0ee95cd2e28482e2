"""Chat formatting of maximal conversations.

A log that writes a conversation anew after each turn holds it many times over, as ever longer prefixes.
Each turn gets the hash of all turns up to it: the exclusive or of 128-bit hashes of (place, role, text).
A conversation whose last hash is the hash of a longer one's prefix is dropped by an anti-join; of equal
conversations the smallest id stays. What is left is rendered turn by turn.

Turns are ordered by `turn`, null first; turns of equal number by an MD5 of role and text. A null role is
"unknown", a null text is empty. Rows without conv_id are one conversation, whose id is null. An empty table
gives no rows; other columns are ignored. A conversation is one row of the result, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundloom.llm import scratch

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: The markers' common head cannot stand in a turn's own text.
MARKER, ESCAPED = "<|im_", "<| im_"


def _turns(logged: DataFrame) -> DataFrame:
    turns = logged.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = F.md5(F.concat("role", F.lit("\x1f"), "text"))
    return turns.withColumns({"order": order, "a": F.xxhash64("role", "text"), "b": F.xxhash64(F.lit(1), "role", "text")})


def prefixes(logged: DataFrame) -> DataFrame:
    """conv_id, place, n_turns and the hash (p, q) of the turns up to each place. Only hashes are dealt out."""
    order = Window.partitionBy("conv_id").orderBy("turn", "order")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = _turns(logged).select("conv_id", "turn", "order", "a", "b").withColumn("place", F.row_number().over(order))
    placed = placed.withColumn("n_turns", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))
    mixed = placed.withColumns({"x": F.xxhash64("place", "a", "b"), "y": F.xxhash64(F.lit(1), "place", "a", "b")})
    return mixed.select("conv_id", F.col("place").cast("bigint").alias("place"), "n_turns", F.bit_xor("x").over(so_far).alias("p"), F.bit_xor("y").over(so_far).alias("q"))


def maximal(logged: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_logged (equal conversations it stands for) of conversations that prefix no longer one."""
    rows = scratch.table(prefixes(logged), "prefixes")
    whole = rows.where("place = n_turns").groupBy("n_turns", "p", "q").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_logged"))
    inner = rows.where("place < n_turns").select(F.col("place").alias("n_turns"), "p", "q").distinct()
    return whole.join(inner, ["n_turns", "p", "q"], "left_anti").select("conv_id", "n_turns", "n_logged")


def render(logged: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_logged and the rendered text of each maximal conversation."""
    kept = maximal(logged).withColumnRenamed("conv_id", "kept_id")
    turns = _turns(logged).join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id")))
    said = turns.groupBy("conv_id", "n_turns", "n_logged").agg(F.sort_array(F.collect_list(F.struct("turn", "order", "role", "text"))).alias("said"))

    def show(t):
        return F.concat(F.lit(OPEN), t["role"], F.lit("\n"), F.replace(t["text"], F.lit(MARKER), F.lit(ESCAPED)), F.lit(f"{CLOSE}\n"))

    return said.select("conv_id", "n_turns", "n_logged", F.array_join(F.transform("said", show), "").alias("rendered"))
