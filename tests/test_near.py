"""The exact threshold join against all pairs, and what it compares."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from groundloom.functions.vectors import letter_counts, measured
from groundloom.operators import near


def frame(spark, rows, name):
    df = spark.createDataFrame(rows, f"g string, {name} string, v array<double>")
    return df.select("g", name, measured(F.col("v")).alias(f"vec_{name}"))


def vectors(rng, n, dims=5):
    centres = rng.normal(size=(6, dims))
    return [(centres[k % 6] + rng.normal(size=dims) * 0.3).round(1).tolist() for k in range(n)]


def all_pairs(left, right, least):
    out = []
    for g, a, x in left:
        for h, b, y in right:
            if g == h and np.dot(x, x) > 0 and np.dot(y, y) > 0:
                cos = np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y))
                if cos >= least:
                    out.append((g, a, b, cos))
    return sorted(out)


def tables(rng):
    sides = []
    for name, n in (("a", 90), ("b", 70)):
        rows = [("big", f"{name}{k}", v) for k, v in enumerate(vectors(rng, n))]
        rows += [(f"small{k % 5}", f"{name}{k}", v) for k, v in enumerate(vectors(rng, 20))]
        rows += [("big", f"{name} again", rows[0][2]), ("big", f"{name} zero", [0.0] * 5), (f"only {name}", name, [1.0] * 5)]
        sides.append(rows)
    return sides


def test_pairs_are_all_pairs_at_every_block_size(spark):
    left, right = tables(np.random.default_rng(1))
    frames = frame(spark, left, "a"), frame(spark, right, "b")
    for least, block in ((0.9, 8), (-1.0, 30), (0.9, 2048)):
        found = near.near_pairs(*frames, ["g"], ["a"], ["b"], "vec_a", "vec_b", least, block)
        got = sorted((r.g, r.a, r.b, r.cos) for r in found.collect())
        want = all_pairs(left, right, least)
        assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want])
    assert near.near_pairs(frames[0].limit(0), frames[1], ["g"], ["a"], ["b"], "vec_a", "vec_b", 0.9).count() == 0


def test_nearest_is_the_least_of_the_largest(spark):
    left, right = tables(np.random.default_rng(2))
    frames = frame(spark, left, "a"), frame(spark, right, "b")
    best = {}
    for g, a, b, cos in all_pairs(left, right, 0.8):
        best[g, a] = min(best.get((g, a), (9, "")), (-round(cos, 9), b))
    for block in (6, 2048):
        found = {(r.g, r.a): (-r.cos, r.b) for r in near.nearest(*frames, ["g"], "a", "b", 0.8, digits=9, block=block).collect()}
        assert {k: v[1] for k, v in found.items()} == {k: v[1] for k, v in best.items()}
    own = near.nearest(frames[0], frames[0].withColumnsRenamed({"a": "b", "vec_a": "vec_b"}), ["g"], "a", "b", digits=9, other=True)
    found = {(r.g, r.a): r.b for r in own.collect()}
    assert found["big", "a0"] == "a again" and found["big", "a again"] == "a0" and all(a != b for (_, a), b in found.items())


def test_clusters_that_are_apart_never_meet(spark):
    """A source of 50,000 names in 300 clusters of 32 dimensions: under a tenth of all pairs is compared, and no pair is lost."""
    rng, n = np.random.default_rng(3), 50_000
    centres = rng.normal(size=(300, 32))
    points = (centres[rng.integers(0, 300, n)] + rng.normal(size=(n, 32)) * 0.12).round(3)
    df = spark.createDataFrame(pd.DataFrame({"g": "s", "a": [f"n{k:05}" for k in range(n)], "v": points.tolist()}), "g string, a string, v array<double>")
    left = df.select("g", "a", measured(F.col("v")).alias("vec_a"))
    right = left.withColumnsRenamed({"a": "b", "vec_a": "vec_b"})
    args = (["g"], ["a"], ["b"], "vec_a", "vec_b", 0.95, 512)
    assert near.compared_pairs(left, right, *args) < n * n / 10
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    want = sum(int((unit[k : k + 1000] @ unit.T >= 0.95).sum()) for k in range(0, n, 1000))
    asked = left.where(F.substring("a", -2, 2) == "00")
    found = near.near_pairs(asked, right, *args)
    few = [k for k in range(0, n, 100)]
    assert found.count() == int((unit[few] @ unit.T >= 0.95).sum()) and want > n


def test_small_and_large_groups_rows_of_one_vector_and_no_vectors(spark):
    """Groups within a block and beyond it in one call: of equal references the smallest, null groups and NaN near to none."""
    same = [("small", f"n{k}", [1.0, -0.0]) for k in (3, 1, 2)] + [("small", "far", [0.0, 1.0]), ("small", "bad", [float("nan"), 1.0]), (None, "n0", [1.0, 0.0])]
    same += [("large", f"n{k:02}", [1.0, float(k % 3)]) for k in range(20)]
    refs = frame(spark, same, "b")
    asked = frame(spark, [("small", "a", [2.0, 0.0]), ("small", "nan", [float("nan"), 0.0]), (None, "a", [1.0, 0.0]), ("large", "a", [1.0, 0.0]), ("large", "c", [1.0, 2.0])], "a")
    for block in (8, 2048):
        found = {(r.g, r.a, r.b) for r in near.nearest(asked, refs, ["g"], "a", "b", 0.9, block=block).collect()}
        assert found == {("small", "a", "n1"), ("large", "a", "n00"), ("large", "c", "n02")}
        pairs = near.near_pairs(asked, refs, ["g"], ["a"], ["b"], "vec_a", "vec_b", 0.99, block).collect()
        assert sorted((r.g, r.a, r.b) for r in pairs) == sorted(
            [("small", "a", f"n{k}") for k in (1, 2, 3)] + [("large", "a", f"n{k:02}") for k in range(20) if k % 3 == 0] + [("large", "c", f"n{k:02}") for k in range(20) if k % 3 == 2]
        )


def test_a_vector_is_made_once(spark):
    rows = spark.createDataFrame([("g", "ab"), ("g", ""), ("g", None)], "g string, v string").withColumn("vec_v", measured(letter_counts(F.col("v"))))
    plan = near._vectors(rows, ["g"], ["v"], "vec_v", True)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan
    refs = spark.createDataFrame([("g", "ba"), ("g", "-"), ("h", "ab")], "g string, w string").withColumn("vec_w", measured(letter_counts(F.col("w"))))
    assert [tuple(r) for r in near.near_pairs(rows, refs, ["g"], ["v"], ["w"], "vec_v", "vec_w", -1.0).select("v", "w").collect()] == [("ab", "ba")]
