"""Buckets longer than an Arrow batch, edges of the table, and recall against all pairs."""

import numpy as np
import pytest

from groundloom.llm import embedding_dedup

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def table(spark, vectors, labels):
    return spark.createDataFrame([(i, [float(x) for x in v], int(k)) for i, (v, k) in enumerate(zip(vectors, labels, strict=True))], SCHEMA)


def brute(vectors, labels, threshold):
    v = vectors.astype(np.float64)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = (unit @ unit.T >= threshold) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    return near


@pytest.mark.parametrize("most", [2048, 100])
def test_a_bucket_longer_than_a_batch(spark, most):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rng = np.random.default_rng(3)
        vectors = (rng.normal(size=64) + 0.01 * rng.normal(size=(450, 64))).astype(np.float32)
        found = embedding_dedup.near_duplicates(table(spark, vectors, np.zeros(450)), most=most).collect()
        assert {(r.n_links, r.component_id) for r in found} == {(449, 0)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_recall_of_all_pairs(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 64))
    # Noise that leaves pairs at cosines about the threshold.
    vectors = np.concatenate([base, base + rng.choice([0.2, 0.27, 0.35], (400, 1)) * rng.normal(size=(400, 64))]).astype(np.float32)
    labels = np.concatenate([np.arange(400) % 2] * 2)
    near = brute(vectors, labels, 0.93)
    found = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(table(spark, vectors, labels)).collect()}
    assert all(found[i] <= n for i, n in enumerate(near.sum(axis=1)))
    assert sum(found.values()) >= 0.99 * near.sum() and near.sum() > 400


def test_empty_tables_odd_rows_and_clashing_columns(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [1.0, 0.001], 1), (3, [None, 1.0], 1), (4, [1.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS cls", "2 AS n_links", "3 AS kept", "4 AS bucket")
    found = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()), key=str)
    assert found == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (None, 0, None, False)], key=str)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
