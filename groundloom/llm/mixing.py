"""Mixing sources to target weights by hash-random order and distributed prefix sums.

Size is the number of words of a text (null: 0). Sources take weights in turn by code point, null last, and
share the total size by weight; a target above `most` times its source's size is held there and the excess
is shared again. A source gives whole epochs of its documents and then, in the order of a hash of the
document id, documents up to its exact budget; the last one is cut at the word where the budget ends.

Documents of one id and size are taken in the order of a hash of their rows, so reruns cut the same text however
the rows are dealt; rows alike in all columns are alike in what comes out. A null id is placed by a digest of its
text. Sources without words have target 0. An empty table mixes to no rows. Other columns pass through; columns
named like a result's are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Leading hex digits of the order key that name a range of it: 16 ** 3 ranges a source.
RANGE_DIGITS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def order_key(id_col: str = "doc_id", text_col: str = "text", seed: str = "mix") -> Column:
    """The hash by which documents are taken."""
    placed_by = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)))
    return F.md5(F.concat(F.lit(f"{seed}:"), placed_by))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, size of documents -> source, source_size, target; one row per source, so the windows hold few rows.

    With sources in the order of cap / weight, those before the first that stays under its cap are held at
    their caps, and the others share what is left by weight.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", w.cast("bigint"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = per.withColumn("cap", most * F.col("source_size")).select(
        "*",
        F.row_number().over(order).alias("place"),
        (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
    )
    free = F.when(F.col("cap") * F.col("weight_left") >= F.col("left") * F.col("weight"), F.struct("place", "left", "weight_left"))
    found = ranked.withColumn("free", F.min(free).over(every))
    share = F.col("free.left") * F.col("weight") / F.col("free.weight_left")
    return found.select("source", "source_size", F.when(F.col("place") < F.col("free.place"), F.col("cap").cast("double")).otherwise(share.cast("double")).alias("target"))


def assign(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, source_col: str = "source", order: tuple[str, ...] = ("key", "doc_id", "size")) -> DataFrame:
    """docs (with columns `size` and, a hex hash, `key`) and source_size, target and taken: the words that the mix takes, repeats counted.

    A source's documents are taken in an order of which the key is the first column.

    Ranges of the order key are summed first and their sums added up within a source; then each range adds
    up its own documents. A source of any share is spread over all its ranges.
    """
    docs = docs.drop("__source", "__null", "__range", "source_size", "target", "taken")
    keyed = docs.withColumns({"__source": F.coalesce(source_col, F.lit("")), "__null": F.col(source_col).isNull(), "__range": F.substring(order[0], 1, RANGE_DIGITS)})
    own = ["__source", "__null"]
    ranges = keyed.groupBy(*own, "__range").agg(F.sum("size").alias("n"))
    plan = targets(ranges.select(F.when(~F.col("__null"), F.col("__source")).alias("source"), F.col("n").alias("size")), weights, most)
    plan = plan.select(F.coalesce("source", F.lit("")).alias("__source"), F.col("source").isNull().alias("__null"), "source_size", "target")
    lower = Window.partitionBy(*own).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(*own, "__range", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("__before")).join(plan, own)
    inside = Window.partitionBy(*own, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = keyed.join(starts, [*own, "__range"]).withColumn("__start", F.col("__before") + F.sum("size").over(inside) - F.col("size"))
    budget = F.floor(F.col("target") + 0.5)
    full = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    part = F.least(F.greatest(budget - full * F.col("source_size") - F.col("__start"), F.lit(0)), F.col("size"))
    return placed.withColumn("taken", (full * F.col("size") + part).cast("bigint")).select(*docs.columns, "source_size", "target", "taken")


def mix(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", seed: str = "mix", **how) -> DataFrame:
    """The mixed documents themselves: one row per repeat, the one at the budget's end cut after its last taken word."""
    names = docs.columns
    tie = F.xxhash64(*(F.to_json(F.struct(F.col(f"`{c}`"))) if docs.schema[c].dataType.typeName() in ("map", "variant") else F.col(f"`{c}`") for c in names))
    given = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("__row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), order_key(id_col, text_col, seed).alias("key"), tie.alias("tie"))
    text = F.col(f"__row.{text_col}")
    full = F.floor(F.col("taken") / F.col("size")).cast("int")
    rest = (F.col("taken") - full * F.col("size")).cast("int")
    pieces = F.regexp_extract_all(text, F.lit(rf"({WORD}[\x20\x09-\x0D]*)"), F.lit(1))
    cut = F.array_join(F.slice(pieces, F.lit(1), rest), "")
    copies = F.concat(F.array_repeat(text, full), F.when(rest > 0, F.array(cut)).otherwise(F.array().cast("array<string>")))
    taken = assign(given, order=("key", "doc_id", "size", "tie"), **how).where(F.col("taken") > 0).select("__row", F.explode(copies).alias("__text"))
    return taken.select(*(F.col("__text").alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in names))
