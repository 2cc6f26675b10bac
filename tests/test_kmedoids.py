"""Clustering by rounds of jobs against the loop that holds a sample."""

from __future__ import annotations

import numpy as np
import pytest

from sortwright.operators import cluster


@pytest.mark.parametrize(("seed", "k"), [(0, 3), (1, 5)])
def test_equals_the_loop(spark, seed, k):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, 6))
    v = np.concatenate([c + 0.3 * rng.normal(size=(20, 6)) for c in centres])
    v = np.concatenate([v, v[:3]])  # equal rows
    rows = spark.createDataFrame([(f"k{i:03}", x.tolist(), 1, "x") for i, x in enumerate(v)], "name string, vec array<double>, cluster int, _key string").repartition(3)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    found = {r["name"]: r["cluster"] for r in cluster.k_medoids(rows, "name", k, seed=seed, span=7).collect()}
    assert [found[f"k{i:03}"] for i in range(len(v))] == cluster.lloyd(unit, k, seed)


def test_few_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, vec array<double>")
    assert {r["cluster"] for r in cluster.k_medoids(rows, "id", 5).collect()} == {0, 1}
    assert cluster.k_medoids(rows.limit(0), "id", 3).collect() == []
    assert {r["id"]: r["cluster"] for r in cluster.k_medoids(rows, "id", 2, start=[2, 1]).collect()} == {2: 0, 1: 1}
