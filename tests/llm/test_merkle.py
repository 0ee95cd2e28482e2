"""The manifest against trees built row by row, over several block heights."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from groundloom.llm import merkle

DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def shown(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes, arity):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][k : k + arity]) for k in range(0, len(out[-1]), arity)])
    return out


def beside(tree, at, arity):
    for nodes in tree[:-1]:
        first = at // arity * arity
        yield nodes[first:at], nodes[at + 1 : first + arity]
        at //= arity


def plain(rows, arity):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    leaf = lambda r: digest(*map(shown, r))
    by = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    trees = {s: levels([leaf(r) for r in by[s]], arity) for s in sources}
    over = levels([trees[s][-1][0] for s in sources], arity)
    out = []
    for k, s in enumerate(sources):
        for at, r in enumerate(by[s]):
            path = [*beside(trees[s], at, arity), *beside(over, k, arity)]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            node = leaf((*r[:4], r[4].replace("\n", "")) if hit else r)
            for before, after in path:
                node = digest(*before, node, *after)
            root = over[-1][0]
            out.append((r[0], trees[s][0][at], trees[s][-1][0], root, digest(*(x for p in path for side in p for x in side)), node, node == root))
    return sorted(map(str, out))


ROWS = [(i, f"s{i * i % 7}" if i % 11 else None, None if i % 5 == 0 else "en", i % 3 or None, f"line {i}\nnext é" if i % 4 else None) for i in range(150)]
ODD = [(None, "s0", None, None, "no id\n"), (None, "s0", None, None, "no id\n"), (9, "s4", "en", 1, "again\n"), (9, "s4", "en", 1, "again\n"), (9, "s4", "en", 2, ""), (1000, "", None, None, "\n\n"), (1001, "über", "de", 5, "alone\nhere"), (1002, "a|b", "x", 0, "y" * 30_000 + "\n")]


@pytest.mark.parametrize(("arity", "height"), [(3, 7), (3, 1), (2, 2), (5, 1)])
def test_against_trees_of_all_rows(spark, arity, height):
    docs = spark.createDataFrame(ROWS + ODD, DOCS).repartition(5).selectExpr("*", "1 AS pos", "2 AS node", "3 AS tree", "4 AS n", "5 AS leaf")
    found = merkle.manifest(docs, merkle.newlines_deleted(), arity=arity, height=height)
    assert sorted(str(tuple(r)) for r in found.collect()) == plain(ROWS + ODD, arity)


def test_a_source_of_copies_and_a_single_row(spark):
    rows = [(None, None, None, None, "copy\n")] * 60 + [(1, "z", None, None, "q")]
    found = merkle.manifest(spark.createDataFrame(rows, DOCS), merkle.newlines_deleted(), height=2)
    assert sorted(str(tuple(r)) for r in found.collect()) == plain(rows, 3)
    one = merkle.manifest(spark.createDataFrame(rows[-1:], DOCS), merkle.newlines_deleted()).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == digest() and one.verified


def test_empty_table_other_columns_and_every_change_is_seen(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0
    df = spark.range(40).select(F.col("id").alias("key"), (F.col("id") % 3).cast("string").alias("part"), F.lit(1.5).alias("x"))
    columns = ("key", "part", "x")
    same = merkle.manifest(df, columns=columns)
    assert same.columns[0] == "key" and same.where("verified").count() == 40
    changed = merkle.manifest(df, [F.col("key"), F.col("part"), F.when(F.col("key") == 5, 2.5).otherwise(F.col("x"))], columns)
    assert [r.key for r in changed.where("NOT verified").collect()] == [5]
