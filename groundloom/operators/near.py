"""Pairs of rows whose vectors have a cosine of a threshold or more, found exactly, group by group.

Groups that fit into a block are compared as they are, many of them in a task. In larger ones, rows of one vector
are compared once, and the group is parted by pivots: each vector goes to the nearest of some vectors of the group, and as angles on the sphere obey the triangle inequality, two parts
whose pivots are further apart than both parts' radii and the threshold's angle together hold no pair and never
meet. Parts are cut into blocks, and each pair of blocks is a task's matrix product.

How much the pivots save depends on the vectors: parts of well separated clusters hardly meet, while among
vectors spread over many dimensions nearly all parts do, and the comparisons stay quadratic in the group.

Null groups are no groups; null and zero vectors, and those that hold NaN, are near to none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundloom.sources.staging import staged

BLOCK = 2048
#: Width of a ring around a pivot in radians, and the number of rings.
RING, RINGS = 0.3, 11
#: Share of a group's pairs up to which its parts are used.
MOST = 0.3
#: Wider than the rounding of an angle.
SLACK = 1e-6


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    # 0.0 is added so that no zero is negative, and equal vectors have equal bytes.
    return (np.asarray(lists.flatten(), np.float64) + 0.0).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


class Side:
    """Vectors of a task."""

    def __init__(self, rows: pa.Table) -> None:
        self.v, self.n = _matrix(rows["v"]), rows["n"].to_numpy()

    def cosines(self, own: Sequence[int], other: Side, its: Sequence[int]) -> np.ndarray:
        """Of all pairs of some rows of the two sides."""
        return self.v[own] @ other.v[its].T / np.sqrt(np.outer(self.n[own], other.n[its]))


def _common(a: pa.Table, b: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each group g that both tables have, the numbers of its rows in either, ascending."""
    codes = np.zeros(len(a) + len(b), np.int64)
    for sides in zip(*(t["g"].combine_chunks().flatten() for t in (a, b)), strict=True):
        of = pa.concat_arrays(sides).dictionary_encode()
        codes = np.unique(codes * len(of.dictionary) + of.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    rows, names, starts = [], [], []
    for own in (codes[: len(a)], codes[len(a) :]):
        order = np.argsort(own, kind="stable")
        name, start = np.unique(own[order], return_index=True)
        rows.append(order)
        names.append(name)
        starts.append([*start.tolist(), len(order)])
    for i, j in zip(*(x.tolist() for x in np.intersect1d(*names, assume_unique=True, return_indices=True)[1:]), strict=True):
        yield rows[0][starts[0][i] : starts[0][i + 1]], rows[1][starts[1][j] : starts[1][j + 1]]


def _vectors(df: DataFrame, group: list[str], keys: list[str], vector: str, each: bool = False) -> DataFrame:
    """g, id, v, n: the distinct vectors of each group, zero ones left out; the least key of a vector's rows is its id. each: one for every row, which _keep leaves out if it is zero."""
    columns = F.struct(*group).alias("g"), F.struct(*keys).alias("id"), F.col(f"{vector}.v").cast("array<double>").alias("v"), F.col(f"{vector}.n").cast("double").alias("n")
    if each:
        return df.select(*columns)  # a filter would make each vector once more
    return df.where(F.col(f"{vector}.n") > 0).select(*columns).groupBy("g", "v", "n").agg(F.min("id").alias("id"))


def _members(df: DataFrame, vectors: DataFrame, group: list[str], vector: str, name: str) -> DataFrame:
    """__g and df's own columns without group and vector, with the id of each row's vector."""
    own = df.select(F.struct(*group).alias("__g"), F.col(f"{vector}.v").cast("array<double>").alias("__v"), *(c for c in df.columns if c not in (vector, *group)))
    return own.join(vectors.select(F.col("g").alias("__g"), F.col("v").alias("__v"), F.col("id").alias(name)), ["__g", "__v"]).drop("__v")


def _parts(df: DataFrame, sizes: DataFrame, pivots: DataFrame, block: int) -> DataFrame:
    """df (g, id, v, n) of the groups of sizes with `angle`, that to the nearest pivot, and `part`, the ring around it in which it lies."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        angle = np.zeros(0)
        nearest = np.zeros(0, np.int64)
        if len(left):
            own, its = Side(left), Side(right.sort_by("pivot"))
            angles = np.arccos(np.clip(own.cosines([*range(len(left))], its, [*range(len(right))]), -1, 1))
            nearest = angles.argmin(1)
            angle = angles[np.arange(len(left)), nearest]
        part = (nearest * RINGS + np.minimum(angle / RING, RINGS - 1).astype(np.int64)).astype(np.int32)
        return left.select(["g", "id", "v", "n"]).append_column("part", pa.array(part)).append_column("angle", pa.array(angle))

    schema = f"g {df.schema['g'].dataType.simpleString()}, id {df.schema['id'].dataType.simpleString()}, v array<double>, n double, part int, angle double"
    chunks = lambda c: F.ceil(F.col(c) / block).cast("int")
    left = df.join(sizes, "g").select("g", "id", "v", "n", F.pmod(F.xxhash64("v"), chunks("size")).cast("int").alias("chunk"))
    told = pivots.join(sizes.select(F.col("g").alias("of"), F.col("size").alias("rows")), F.col("g") == F.col("of"))
    right = told.select("g", "pivot", "v", "n", F.explode(F.sequence(F.lit(0), chunks("rows") - 1)).alias("chunk"))
    return left.groupBy("g", "chunk").cogroup(right.groupBy("g", "chunk")).applyInArrow(run, schema)


def _pivots(df: DataFrame, block: int) -> DataFrame:
    """g, pivot, v, n: eight vectors for each block, by their hash, and one at least: a share of a group, so their number grows with it."""
    picked = df.where(F.pmod(F.xxhash64("v", F.lit(7)), F.lit(1 << 30)) < F.lit(float(1 << 30) * min(1.0, 8.0 / block))).select("g", "v", "n")
    least = df.groupBy("g").agg(F.min(F.struct("v", "n")).alias("x")).select("g", "x.v", "x.n")
    each = picked.unionByName(least).distinct().groupBy("g").agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("x"))
    return each.select("g", F.posexplode("x").alias("pivot", "x")).select("g", "pivot", "x.v", "x.n")


def _whole(df: DataFrame) -> DataFrame:
    return df.select("g", "id", "v", "n", F.lit(0).alias("part"), F.lit(math.pi).alias("angle"))


def _stats(df: DataFrame, side: str, block: int) -> DataFrame:
    count = F.count(F.lit(1))
    return df.groupBy("g", F.col("part").alias(f"p{side}")).agg(F.ceil(count / block).cast("int").alias(f"b{side}"), count.alias(f"c{side}"), F.min("angle").alias(f"l{side}"), F.max("angle").alias(f"h{side}"))


MET = ("g", "pl", "pr", "bl", "br", "cl", "cr")


def _arranged(left: DataFrame, right: DataFrame, least: float, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both sides with parts, and the pairs of parts that may hold a pair: g, pl, pr, their numbers of blocks bl, br and of rows cl, cr, and `alone`, where a group has several parts.

    Pairs of parts are left out by the least angle between their vectors. Where more than MOST of a group's pairs
    would be compared all the same, its parts only cost copies of rows, and it is one part.
    """
    sizes = [df.groupBy("g").agg(F.count(F.lit(1)).alias(name)) for df, name in ((left, "l"), (right, "r"))]
    both = staged(sizes[0].join(sizes[1], "g").select("g", "l", "r", (F.greatest("l", "r") > block).alias("large")), "sizes")
    large = both.where("large").select("g")
    rest, far = both.select("g"), None
    if not large.isEmpty():
        pivots = staged(_pivots(right.join(large, "g"), block), "pivots")
        far = [staged(_parts(df, both.where("large").select("g", F.col(k).alias("size")), pivots, block), "parts") for df, k in ((left, "l"), (right, "r"))]
        own = [
            _stats(df, s, block).join(pivots.select("g", (F.col("pivot") * RINGS).cast("int").alias("first"), F.col("v").alias(f"v{s}"), F.col("n").alias(f"n{s}")).withColumnRenamed("g", f"g{s}"), (F.col("g") == F.col(f"g{s}")) & (F.col(f"p{s}") - F.col(f"p{s}") % RINGS == F.col("first"))).drop(f"g{s}", "first")
            for df, s in zip(far, "lr", strict=True)
        ]
        dot = F.aggregate(F.zip_with("vl", "vr", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / F.sqrt(F.col("nl") * F.col("nr")))))
        pairs = own[0].join(own[1], "g").withColumn("d", apart)
        nearest = F.greatest(F.col("d") - F.col("hl") - F.col("hr"), F.col("ll") - F.col("d") - F.col("hr"), F.col("lr") - F.col("d") - F.col("hl"))
        met = staged(pairs.where(nearest <= math.acos(max(-1.0, min(1.0, least))) + SLACK).select(*MET), "meetings")
        kept = met.groupBy("g").agg(F.sum(F.col("cl") * F.col("cr")).alias("kept"))
        parted = staged(large.join(kept, "g", "left").join(both.select("g", "l", "r"), "g").where(F.coalesce("kept", F.lit(0)) <= F.col("l") * F.col("r") * MOST).select("g"), "parted")
        rest = rest.join(parted, "g", "left_anti")
        far = [df.join(parted, "g") for df in far]
    near = [_whole(df.join(rest, "g")) for df in (left, right)]
    alone = F.lit(False).alias("alone")
    meetings = _stats(near[0], "l", block).join(_stats(near[1], "r", block), "g").select(*MET, alone)
    if far:
        meetings = meetings.unionByName(met.join(parted, "g").select(*MET, F.lit(True).alias("alone")))
        near = [a.unionByName(b) for a, b in zip(near, far, strict=True)]
    return *near, staged(meetings, "meetings")


def _nullable(column: pa.ChunkedArray) -> pa.Array:
    """A column of structs, fields that are never null being declared as ones that may be."""
    whole = column.combine_chunks()
    return pa.StructArray.from_arrays(whole.flatten(), names=[f.name for f in whole.type])


def _keep(hits, digits: int | None, other: bool, distinct: bool = False):
    """Of two tables of g, id, v, n: the pairs of equal groups for which hits(their cosines) is true.

    Its columns are in the order of the right ids. digits: to which cosines are rounded first; other: pairs of
    equal ids are no pairs; distinct: of the right rows of one vector, the first stands for all.
    """

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        a, b = (t.filter(pc.greater(t["n"], 0.0)) for t in (a, b))
        if len(a) and len(b):
            b = b.take(pc.sort_indices(b["id"].combine_chunks().field(0)))
            left_side, right_side = Side(a), Side(b)
            ids = [t["id"].combine_chunks().field(0).to_numpy(zero_copy_only=False) for t in (a, b)] if other else []
            for own, its in _common(a, b):
                if distinct:
                    first: dict[bytes, int] = {}
                    for k in its.tolist():
                        first.setdefault(right_side.v[k].tobytes(), k)
                    its = np.array([*first.values()])
                found = left_side.cosines(own, right_side, its)
                if digits is not None:
                    found = np.round(found, digits)
                found[np.isnan(found)] = -2.0
                if other:
                    found[ids[0][own][:, None] == ids[1][its]] = -2.0
                i, j = np.nonzero(hits(found))
                out.append((own[i], its[j], found[i, j]))
        i, j, cos = (np.concatenate(x) for x in zip(*out, strict=True))
        taken = {"g": (a if len(a) else b)["g"].take(i), "lid": a["id"].take(i), "rid": b["id"].take(j)}
        return pa.table({**{name: _nullable(column) for name, column in taken.items()}, "cos": cos})

    return run


def _found_schema(left: DataFrame, right: DataFrame) -> str:
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((left, "g"), (left, "id"), (right, "id"))]
    return "g {}, lid {}, rid {}, cos double".format(*kinds)


def _compared(left: DataFrame, right: DataFrame, meetings: DataFrame, hits, block: int, digits: int | None = None, other: bool = False) -> DataFrame:
    """g, lid, rid, cos of the pairs for which hits(cosines of two blocks) is true, over all pairs of blocks of parts that meet.

    digits: to which cosines are rounded first; other: pairs of equal ids are no pairs.
    """

    bundles = max(1, (meetings.agg(F.sum(F.col("cl") + F.col("cr"))).first()[0] or 0) // (2 * block))

    def side(df: DataFrame, s: str, other_side: str):
        dealt = df.join(meetings.withColumnRenamed(f"p{s}", "part"), ["g", "part"]).withColumnRenamed("part", f"p{s}")
        dealt = dealt.withColumn(f"k{s}", F.pmod(F.xxhash64("v"), F.col(f"b{s}")).cast("int")).withColumn(f"k{other_side}", F.explode(F.sequence(F.lit(0), F.col(f"b{other_side}") - 1)))
        # Groups of one part and block go together, as many as fill a block; each other pair of blocks has a task of its own.
        alone = F.col("alone") | (F.col("bl") > 1) | (F.col("br") > 1)
        place = F.struct("pl", "pr", "kl", "kr", F.when(alone, F.xxhash64("g")).otherwise(F.pmod(F.xxhash64("g"), F.lit(bundles))).alias("bundle"))
        return dealt.select("g", "id", "v", "n", place.alias("place")).groupBy("place")

    return side(left, "l", "r").cogroup(side(right, "r", "l")).applyInArrow(_keep(hits, digits, other), _found_schema(left, right))


def _together(left: DataFrame, right: DataFrame, rows: int, hits, block: int, digits: int | None = None, other: bool = False, distinct: bool = False) -> DataFrame:
    """g, lid, rid, cos of the pairs for which hits is true, of groups that fit into a block: as many to a task as fill one. rows: how many both sides have."""
    bundle = F.pmod(F.xxhash64("g"), F.lit(max(1, rows // (2 * block))))
    sides = (df.withColumn("bundle", bundle).groupBy("bundle") for df in (left, right))
    return next(sides).cogroup(next(sides)).applyInArrow(_keep(hits, digits, other, distinct), _found_schema(left, right))


def _by_size(left: DataFrame, right: DataFrame, group: list[str], block: int) -> tuple[tuple[DataFrame, DataFrame], int, tuple[DataFrame, DataFrame] | None]:
    """The rows of the groups that fit into a block on both sides and their number, and those of larger groups, if there are any."""
    sides = left.dropna(subset=group), right.dropna(subset=group)
    each = [df.groupBy(*group).agg(F.count(F.lit(1)).alias("n")) for df in sides]
    sizes = each[0].unionByName(each[1]).groupBy(*group).agg(F.max("n").alias("n"), F.sum("n").alias("rows"))
    most, rows = sizes.agg(F.max("n"), F.sum(F.when(F.col("n") <= block, F.col("rows")))).first()
    if (most or 0) <= block:
        return sides, rows or 0, None
    sizes = staged(sizes, "group-sizes")
    of = lambda which: tuple(df.join(sizes.where(which).select(*group), group, "left_semi") for df in sides)
    return of(F.col("n") <= block), rows or 0, of(F.col("n") > block)


def near_pairs(left: DataFrame, right: DataFrame, group: list[str], l_key: list[str], r_key: list[str], l_vec: str, r_vec: str, least: float, block: int = BLOCK) -> DataFrame:
    """All pairs of rows of one group with cosine >= least, and `cos`. Vectors are structs of v and n, its squared length.

    Columns of the two sides differ but for group.
    """
    hits = lambda cos: cos >= least
    small, rows, large = _by_size(left, right, group, block)
    own = [[c for c in df.columns if c not in (vec, *group)] for df, vec in ((left, l_vec), (right, r_vec))]
    found = _together(_vectors(small[0], group, own[0], l_vec, True), _vectors(small[1], group, own[1], r_vec, True), rows, hits, block)
    pairs = found.select("g.*", "lid.*", "cos", "rid.*").select(*group, "cos", *own[0], *own[1])
    if not large:
        return pairs
    left, right = large
    sides = _vectors(left, group, l_key, l_vec), _vectors(right, group, r_key, r_vec)
    sides = staged(sides[0], "left-vectors"), staged(sides[1], "right-vectors")
    found = _compared(*_arranged(*sides, least, block), hits, block)
    found = found.withColumnsRenamed({"g": "__g", "lid": "__l", "rid": "__r"})
    far = found.join(_members(left, sides[0], group, l_vec, "__l"), ["__g", "__l"]).join(_members(right, sides[1], group, r_vec, "__r"), ["__g", "__r"])
    return pairs.unionByName(far.select("__g.*", *(c for c in far.columns if c not in ("__g", "__l", "__r"))))


def compared_pairs(left: DataFrame, right: DataFrame, group: list[str], l_key: list[str], r_key: list[str], l_vec: str, r_vec: str, least: float, block: int = BLOCK) -> int:
    """How many pairs of vectors near_pairs compares."""
    sides = staged(_vectors(left, group, l_key, l_vec), "left-vectors"), staged(_vectors(right, group, r_key, r_vec), "right-vectors")
    return _arranged(*sides, least, block)[2].agg(F.sum(F.col("cl") * F.col("cr"))).first()[0] or 0


def nearest(queries: DataFrame, refs: DataFrame, group: list[str], query: str, ref: str, least: float = -1.0, digits: int | None = None, other: bool = False, block: int = BLOCK) -> DataFrame:
    """group, query, ref, cos: the reference of the largest cosine, of equals the smallest, if that is `least` or more.

    Vectors are columns named vec_ and the row's own. digits: to which cosines are rounded before they are
    compared; other: a reference of the query's own name is left out.
    """
    l_vec, r_vec = f"vec_{query}", f"vec_{ref}"

    def hits(cos: np.ndarray) -> np.ndarray:
        """Of each row the first of the largest, as columns are in the order of the references."""
        out = np.zeros(cos.shape, bool)
        at = cos.argmax(1)
        some = np.flatnonzero(cos[np.arange(len(cos)), at] >= least)
        out[some, at[some]] = True
        return out

    small, rows, large = _by_size(queries, refs, group, block)
    found = _together(_vectors(small[0], group, [query], l_vec, True), _vectors(small[1], group, [ref], r_vec, True), rows, hits, block, digits, other, not other)
    near = found.select("g.*", f"lid.{query}", f"rid.{ref}", "cos")
    if not large:
        return near
    queries, refs = large
    # Of the references of one vector only the smallest, its id, can be the answer.
    sides = staged(_vectors(queries, group, [query], l_vec, other), "query-vectors"), staged(_vectors(refs, group, [ref], r_vec, other), "reference-vectors")
    found = _compared(*_arranged(*sides, least, block), hits, block, digits, other)
    best = found.groupBy("g", "lid").agg(F.min(F.struct((-F.col("cos")).alias("far"), F.col(f"rid.{ref}").alias(ref), "cos")).alias("x"))
    if other:
        return near.unionByName(best.select("g.*", f"lid.{query}", f"x.{ref}", "x.cos"))
    best = best.select(F.col("g").alias("__g"), F.col("lid").alias("__l"), f"x.{ref}", "x.cos")
    return near.unionByName(_members(queries, sides[0], group, l_vec, "__l").join(best, ["__g", "__l"]).select("__g.*", query, ref, "cos"))
