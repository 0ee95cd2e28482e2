"""Removal of lines that many sites share, by distinct-site sketches.

A line is what stands between newlines, compared without blanks, tabs and returns at its ends; empty lines
are never removed. Its spread is the number of distinct sites (sources) that hold it: a HyperLogLog sketch
per line hash, merged by aggregation. Where the estimate is within `band` of `min_sites`, the spread is
counted exactly. A line of spread min_sites or more stays once, where it first stands in the document of
the smallest id that holds it, and goes everywhere else.

Null text stays null; null and empty source are one site. A document is an id and a text: rows of one id
with different texts are documents of their own, in the order of a hash of the text, and so are rows without
an id, after all others; rows of equal id and text are alike. An empty table gives no rows. Other columns
pass through, but n_lines and n_removed, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundloom.llm import scratch

LAST = 2**63 - 1
#: 2 ** 12 registers: a standard error of 1.6 %.
LG_K = 12


def _core(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _key(line: Column) -> Column:
    core = _core(line)
    return F.struct(F.xxhash64(core).alias("a"), F.xxhash64(F.lit(1), core).alias("b"))


def shared_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """lines (key, site, doc) -> key, first (its smallest document) of each line of spread min_sites or more."""
    band = max(1.0, 3 * 1.04 * min_sites / 2 ** (LG_K / 2))
    spread = lines.groupBy("key").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min("doc").alias("first"))
    spread = spread.select("key", "first", F.hll_sketch_estimate("sketch").alias("estimate")).where(F.col("estimate") >= min_sites - band)
    spread = scratch.table(spread, "spread")
    sure = spread.where(F.col("estimate") > min_sites + band).select("key", "first")
    near = spread.where(F.col("estimate") <= min_sites + band).select("key", "first")
    pairs = lines.join(near, "key", "left_semi").select("key", "site").distinct()
    exact = pairs.groupBy("key").count().where(F.col("count") >= min_sites).join(near, "key").select("key", "first")
    return sure.unionByName(exact)


def gone_lines(lines: DataFrame, shared: DataFrame) -> DataFrame:
    """doc and the places of the lines that it loses."""
    hits = lines.join(shared, "key").select("doc", "key", "place", (F.col("doc") == F.col("first")).alias("own")).distinct()
    again = hits.where("own").groupBy("doc", "key").agg(F.min("place").alias("kept"), F.collect_list("place").alias("places"))
    again = again.select("doc", "kept", F.explode("places").alias("place")).where("place != kept")
    return hits.where("not own").select("doc", "place").union(again.select("doc", "place")).groupBy("doc").agg(F.collect_list("place").alias("gone"))


def dedup(docs: DataFrame, min_sites: int = 5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with the text less its shared lines, and n_lines, n_removed."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    text = F.col(f"row.{text_col}")
    doc = F.struct(F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("id"), F.xxhash64(text_col).alias("h"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), doc.alias("doc"))
    each = docs.select(doc.alias("doc"), F.coalesce(source_col, F.lit("")).alias("site"), F.posexplode(F.split(text_col, "\n")).alias("place", "line"))
    lines = scratch.table(each.where(_core(F.col("line")) != "").select("doc", "site", "place", _key(F.col("line")).alias("key")), "lines")
    shared = scratch.table(shared_lines(lines, min_sites), "shared")
    # A table of its own: Spark can then split a join's large partitions.
    gone = scratch.table(gone_lines(lines, shared), "gone")
    scratch.drop(lines, shared)
    joined = rows.join(gone.select(F.col("doc").alias("of"), "gone"), F.col("doc") == F.col("of"), "left")
    found = joined.select("row", "gone", F.split(text, "\n").alias("lines"))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size("lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    less = F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")
    return found.select(
        *(F.when(F.col("gone").isNull(), text).otherwise(less).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names),
        n_lines.cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
    )
