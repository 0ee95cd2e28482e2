"""A Merkle manifest of a dataset: persistent trees of row digests, in aligned blocks, with a version for each tampered row.

A row's leaf is the digest of its columns. The leaves of a source, by ascending id, are folded in runs of
`arity` until one node is left, and those of all sources likewise. Every level that is a power of the block
size is a table of its own: a task holds the tree of one block, of at most `arity ** height` nodes, and hands
its top on. On the way back each block is told the siblings above its top, which all its leaves share; a
tampered leaf makes a version of the block's tree that copies the nodes above the leaf only and shares all
others, and the version goes on through the siblings above to a root of its own.

Null values are digested as `-`. A null id comes first in its source, and is never tampered with by
`newlines_deleted`. Equal ids are ordered by their leaves, so rows alike in all columns may stand in either
order. A null source comes before all others, apart from an empty one. An empty table has no rows and no root.
Further columns are left out.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundloom.llm import scratch

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*columns: Column) -> Column:
    """The digest of a row's columns, each with its size in bytes before it."""
    shown = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in shown)), 256)


def newlines_deleted(columns: tuple[str, ...] = COLUMNS) -> list[Column]:
    """The columns of a row (id first, text last) whose text loses its line feeds where 2 divides the CRC-32 of the id."""
    hit = F.coalesce(F.crc32(F.col(columns[0]).cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return [*map(F.col, columns[:-1]), F.when(hit, F.translate(columns[-1], "\n", "")).otherwise(F.col(columns[-1]))]


class Tree:
    """The nodes over some neighbouring leaves; versions of it share all they don't change."""

    def __init__(self, leaves: list[str], arity: int, height: int) -> None:
        """Folds leaves `height` times; a run of one is folded too."""
        self.arity, self.levels = arity, [leaves]
        for _ in range(height):
            below = self.levels[-1]
            self.levels.append([digest(*below[k : k + arity]) for k in range(0, len(below), arity)])

    def siblings(self, at: int) -> list[tuple[str, str]]:
        """For each fold over leaf `at`, the run's nodes before it and after it, joined."""
        out = []
        for nodes in self.levels[:-1]:
            first = at - at % self.arity
            out.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + self.arity])))
            at //= self.arity
        return out


def copies(node: str, siblings: list[tuple[str, str]]) -> list[str]:
    """The nodes of a version above a changed one: they are copied, what stands beside them is shared."""
    out = []
    for before, after in siblings:
        node = digest(before, node, after)
        out.append(node)
    return out


def _tree_key(source: Column) -> Column:
    """A name for a source's tree that sorts as sources do: none, then by bytes."""
    return F.coalesce(F.concat(F.lit("1"), source), F.lit("0"))


def ordered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes (a written table) with `pos`, their place in their tree by `order`, and `n`, the tree's number of nodes.

    Rows are sorted into ranges, and the number of a row parts those alike in all keys; a range's rows are
    numbered where they stand, and the ranges of a tree are added up.
    """
    keys = ["tree", *order, "__n"]
    ranged = nodes.withColumn("__n", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__n")
    # This number holds the range in its upper bits and the row's place in the range in its lower ones.
    ranged = scratch.table(ranged.withColumn("__at", F.monotonically_increasing_id()), "ranged").withColumn("__part", F.shiftright("__at", 33))
    ranges = ranged.groupBy("tree", "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("tree", "__part", (F.coalesce(F.sum("__rows").over(before), F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__rows").over(whole).alias("n"))
    return ranged.join(ranges, ["tree", "__part"]).select(*nodes.columns, (F.col("__at") + F.col("__shift")).alias("pos"), "n")


class Shape:
    """The arity of trees and the number of folds in a block."""

    def __init__(self, arity: int, height: int) -> None:
        self.arity, self.height, self.width = arity, height, arity**height

    def folds(self, n: int) -> int:
        """How often a block of a level of n nodes is folded: until one node is left, at most `height` times."""
        k = 0
        while k < self.height and self.arity**k < n:
            k += 1
        return k

    def tree(self, rows: pa.Table) -> Tree:
        return Tree(rows["node"].to_pylist(), self.arity, self.folds(rows["n"][0].as_py()))

    def in_blocks(self, nodes: DataFrame):
        return nodes.groupBy("tree", F.floor(F.col("pos") / self.width).alias("block"))


def _upper_tables(nodes: DataFrame, shape: Shape) -> list[DataFrame]:
    """nodes (tree, pos, n, node) and the written tables of their blocks' tops, of those tops' blocks and on, up to one node a tree."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by("pos")
        n, pos = rows["n"][0].as_py(), rows["pos"][0].as_py()
        return pa.table({"tree": rows["tree"].slice(0, 1), "pos": [pos // shape.width], "n": [-(-n // shape.width)], "node": shape.tree(rows).levels[-1]}, schema)

    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("node", pa.string())])
    out, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1 or len(out) == 1:
        tops = shape.in_blocks(out[-1].select("tree", "pos", "n", "node")).applyInArrow(run, "tree string, pos bigint, n bigint, node string")
        out.append(scratch.table(tops, "tops"))
        most = -(-most // shape.width)
    return out


def _pairs(path: list[str]) -> list[tuple[str, str]]:
    return [*zip(path[::2], path[1::2], strict=True)]


def _paths(nodes: DataFrame, above: DataFrame, shape: Shape) -> DataFrame:
    """tree, pos, subroot, path of nodes: what stands beside them in their block, then beside their block's top (above)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.sort_by("pos")
        tree, shared = shape.tree(rows), right["path"][0].as_py()
        paths = [[*(x for pair in tree.siblings(k) for x in pair), *shared] for k in range(len(rows))]
        return pa.table({"tree": rows["tree"], "pos": rows["pos"], "subroot": right["subroot"].to_pylist() * len(rows), "path": paths}, schema)

    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("subroot", pa.string()), ("path", pa.list_(pa.string()))])
    found = shape.in_blocks(nodes.select("tree", "pos", "n", "node")).cogroup(above.groupBy("tree", F.col("pos").alias("block")))
    return scratch.table(found.applyInArrow(run, "tree string, pos bigint, subroot string, path array<string>"), "paths")


def manifest(df: DataFrame, tampered: list[Column] | None = None, columns: tuple[str, ...] = COLUMNS, arity: int = 3, height: int = 7) -> DataFrame:
    """The id, leaf, subroot, root, proof_sha256, folded_root and verified of each row.

    columns: the id, the source, and whatever else a leaf digests, in its order; tampered: those columns as
    they are found later, by default as they are. folded_root is the root of the row's version, and
    proof_sha256 the digest of the nodes beside its path.
    """
    shape = Shape(arity, height)
    was, now = [*map(F.col, columns)], tampered or [*map(F.col, columns)]
    changed = F.lit(False)
    for a, b in zip(was, now, strict=True):
        changed |= ~a.eqNullSafe(b)
    rows = df.select(was[0].alias("doc_id"), _tree_key(was[1].cast("string")).alias("tree"), leaf(*was).alias("node"), F.when(changed, leaf(*now)).alias("found"))
    leaves = scratch.table(ordered(scratch.table(rows, "leaves"), ["doc_id", "node"]), "placed")
    tables = _upper_tables(leaves, shape)
    subroots = scratch.table(tables[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "node"), "subroots")
    sources = scratch.table(ordered(subroots, ["of"]), "sources")
    over = _upper_tables(sources, shape)
    root = next((r.node for r in over[-1].select("node").take(1)), None)
    # Back down: through the tree of the sources, then through each source's own.
    paths = over[-1].select("tree", "pos", F.lit("").alias("subroot"), F.array().cast("array<string>").alias("path"))
    for nodes in over[-2::-1]:
        paths = _paths(nodes, paths, shape)
    paths = sources.join(paths.drop("tree", "subroot"), "pos").select(F.col("of").alias("tree"), F.lit(0).cast("bigint").alias("pos"), F.col("node").alias("subroot"), "path")
    for nodes in tables[-2:0:-1]:
        paths = _paths(nodes, paths, shape)
    return _proved(leaves, paths, root, shape).withColumnRenamed("doc_id", columns[0])


def _proved(leaves: DataFrame, above: DataFrame, root: str | None, shape: Shape) -> DataFrame:
    """What manifest returns, of leaves and of the paths of their blocks' tops."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.sort_by("pos")
        tree, shared = shape.tree(rows), _pairs(right["path"][0].as_py())
        proofs, folded = [], []
        for at, (node, found) in enumerate(zip(rows["node"].to_pylist(), rows["found"].to_pylist(), strict=True)):
            beside = tree.siblings(at)
            proofs.append(digest(*(x for pair in [*beside, *shared] for x in pair)))
            version = found or node
            for nodes in (beside, shared):
                version = [version, *copies(version, nodes)][-1]
            folded.append(version)
        n = len(rows)
        return pa.table({"doc_id": rows["doc_id"], "leaf": rows["node"], "subroot": right["subroot"].to_pylist() * n, "root": [root] * n, "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded]})

    found = shape.in_blocks(leaves.select("doc_id", "tree", "pos", "n", "node", "found")).cogroup(above.groupBy("tree", F.col("pos").alias("block")))
    kind = leaves.schema["doc_id"].dataType.simpleString()
    return found.applyInArrow(run, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
