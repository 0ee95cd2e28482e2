import random

import pytest
from pyspark.sql import functions as F

from groundloom.config import EvalConfig
from groundloom.operators import extract, ranking, tuning


def frame(spark, pairs):
    return spark.createDataFrame([(str(i), h, y) for i, (h, y) in enumerate(pairs)], "response_id string, h double, y int")


@pytest.fixture
def tied():
    rng = random.Random(3)
    return [(rng.randrange(8) / 8, rng.randrange(2)) for _ in range(300)]


def test_auc_is_the_share_of_ordered_pairs(spark, tied):
    pos, neg = [h for h, y in tied if y], [h for h, y in tied if not y]
    expected = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert ranking.auc(frame(spark, tied), []).first().auc == pytest.approx(expected)
    assert ranking.auc(frame(spark, [(0.1, 1), (0.2, 1)]), []).first().auc is None


def test_threshold_is_the_smallest_of_the_best(spark, tied):
    values = sorted({h for h, _ in tied})
    tries = [values[0] - 1e-9] + [x for a, b in zip(values, [*values[1:], None]) for x in ([a, (a + b) / 2] if b is not None else [a])]

    def f1(t):
        tp, fp, fn = (sum((h >= t) == s and y == v for h, y in tied) for s, v in ((True, 1), (True, 0), (False, 1)))
        return 2 * tp / (2 * tp + fp + fn)

    row = ranking.best_threshold(frame(spark, tied)).first()
    assert row.theta == max(sorted(tries), key=f1) and row.f1 == pytest.approx(f1(row.theta))
    one = ranking.best_threshold(frame(spark, [(0.1, 1)])).first()
    assert (one.theta, one.f1) == (0.5, None)


def test_buckets_are_left_closed(spark):
    given = spark.createDataFrame([(n,) for n in (999, 1000, 16000, 1000000)], "context_len int")
    found = [r[0] for r in given.select(ranking.bucket_of(given.context_len, EvalConfig().context_length_edges)).collect()]
    assert found == [0, 1, 5, None]


def test_folds_take_each_class_in_turn(spark, tied):
    counts = tuning.folds(frame(spark, tied), 5).groupBy("y", "fold").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in counts if r.y == y]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_backend_errors_stay_in_their_row(spark):
    def load():
        def generate(text, cluster, size):
            if text == "bad":
                raise RuntimeError("no")
            return ["b", "a"], [("a", "r", "b"), ("a", "b")]

        return generate

    from groundloom.config import ExtractConfig

    given = spark.createDataFrame([("1", "good"), ("2", "bad"), ("3", " ")], "id string, text string")
    rows = {r.id: r for r in extract.backend_graph(given, "id", "text", load, ExtractConfig(max_retries=2, backoff_multiplier=0.0)).collect()}
    assert rows["1"].entities == ["a", "b"] and len(rows["1"].relations) == 1 and rows["1"].error is None
    assert "no" in rows["2"].error and rows["3"].entities == [] and rows["3"].error is None


def test_exact_p_is_that_of_all_arrangements(spark):
    from itertools import combinations

    for n1 in range(1, 8):
        for n0 in range(1, 8):
            total, counts = 0, [0] * (n1 * n0 + 1)
            for taken in combinations(range(n1 + n0), n1):
                counts[sum(taken) - n1 * (n1 - 1) // 2] += 1
                total += 1
            assert ranking.u_counts(n1, n0) == counts
            for u in range(n1 * n0 + 1):
                assert abs(ranking.p_value(0.0, n1, n0, float(u), 0.0) - sum(counts[u:]) / total) < 1e-12
    df = spark.createDataFrame([(0.1 * k, int(k > 3)) for k in range(7)], "h double, y int")
    r = ranking.mann_whitney(df).first()
    assert ranking.p_value(r.z, r.n1, r.n0, r.u, r.ties) == 1 / 35
    tied = ranking.mann_whitney(df.unionByName(df)).first()
    assert tied.ties > 0 and ranking.p_value(tied.z, tied.n1, tied.n0, tied.u, tied.ties) == ranking.p_value(tied.z)


def test_average_precision_and_a_metric_of_one_s_own(spark):
    rows = [(k, f"r{k:03}", (k * 37 % 50) / 50 if k % 9 else None, int(k % 3 == 0)) for k in range(200)]
    df = spark.createDataFrame(rows, "id int, response_id string, h double, y int").withColumn("w", F.col("id") % 4)

    def plain(weighted):
        good = [(h, y, w) for (k, _, h, y), w in zip(rows, [k % 4 for k in range(200)], strict=True) if h is not None]
        weight = lambda a: sum(w if weighted else 1 for *_, w in a)
        pos = [r for r in good if r[1] == 1]
        return sum((w if weighted else 1) * weight([r for r in pos if r[0] >= h]) / weight([r for r in good if r[0] >= h]) for h, _, w in pos if w or not weighted) / weight(pos)

    assert abs(ranking.average_precision(df, []).first().ap - plain(False)) < 1e-12
    assert abs(ranking.average_precision(df, [], weight=F.col("w")).first().ap - plain(True)) < 1e-12
    assert ranking.average_precision(df.where("y = 0"), []).first().ap is None
    own = {"ap": lambda d: ranking.average_precision(d, ["rep"], weight=F.col("w")).select("rep", F.col("ap").alias("v"))}
    (band,) = tuning.bootstrap(df, 0.5, EvalConfig(bootstrap_replicates=60), metrics=own).collect()
    assert band.metric == "ap" and band.n > 50 and band.lo < plain(False) < band.hi


def test_draws_of_few_scores_are_spread(spark, monkeypatch):
    held, plain = {}, tuning.staged
    monkeypatch.setattr(tuning, "staged", lambda df, name: held.setdefault(name, df) if name == "draws" else plain(df, name))
    tuning.bootstrap(frame(spark, [(0.1, 0), (0.9, 1)] * 20), 0.5, EvalConfig(bootstrap_replicates=40))
    assert held["draws"].select(F.spark_partition_id()).distinct().count() > 1
