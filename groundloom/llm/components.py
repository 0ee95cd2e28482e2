"""Connected components of a graph of any size by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundloom.llm import scratch


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _round(edges: DataFrame) -> DataFrame:
    """edges (u > v): one large star, then one small star. Each vertex's neighbours meet in aggregates and joins only."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _least(both).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = _least(large)
    small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(low.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the smallest node that links reach) of every node of a link between two nodes.

    Each round is a written table, so lineage stays short; rounds end when the links don't change. Links
    with a null end and loops are ignored.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    now = scratch.table(edges.where(f"`{a}` != `{b}`").select(u.alias("u"), v.alias("v")).distinct(), "links")
    state = _state(now)
    while state[0]:
        then, now = now, scratch.table(_round(now), "links")
        new = _state(now)
        scratch.drop(then)
        if new == state:
            break
        state = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels of a task's own rows (the smallest place reached) after the links a-b between places."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        label = label.copy()
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
