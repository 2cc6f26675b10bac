"""Nearest examples in blocks against the array path and brute force."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sortwright.operators import knn, rank

DOC = "id int, vec array<double>, nearest string, key int, cell string"


def brute(docs, examples, k):
    width = max([len(v) for _, v in docs + [(s, v) for s, _, v in examples] if v] or [1])

    def unit(v):
        x = np.zeros(width)
        x[: len(v or [])] = v or []
        return x / (np.linalg.norm(x) or 1)

    out = {}
    for i, v in docs:
        scored = sorted((-round(float(unit(v) @ unit(e)), 9), s) for s, _, e in examples)
        out[i] = [s for _, s in scored[:k]]
    return out


def frames(spark, docs, examples):
    d = spark.createDataFrame([(i, v, "old", 1, "x") for i, v in docs], DOC).repartition(3)
    return d, spark.createDataFrame(examples, "seq int, category string, vec array<double>").repartition(2)


@pytest.mark.parametrize("size", [64, 700, 1 << 20])
def test_blocks(spark, size, monkeypatch):
    monkeypatch.setattr(knn, "SCORES", 4000)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 6)).round(2)
    examples = [(3 * i, f"c{i % 4}", base[i % 30].tolist()) for i in range(90)] + [(1000, "short", [1.0]), (1001, "none", None), (1002, "empty", []), (1003, "zero", [0.0] * 6)]
    docs = [(i, v.tolist()) for i, v in enumerate(base)] + [(100, None), (101, []), (102, [0.0] * 6), (103, [2.0, 0.0]), (7, base[7].tolist())]
    d, e = frames(spark, docs, examples)
    found = knn.nearest_by_blocks(d, e, 5, size=size)
    assert found.columns == ["id", "vec", "key", "cell", "nearest"]
    rows = found.collect()
    assert len(rows) == len(docs)
    want = brute(docs, examples, 5)
    for r in rows:
        assert [n["seq"] for n in r["nearest"]] == want[r["id"]], r["id"]
        assert all(n["category"] == dict((s, c) for s, c, _ in examples)[n["seq"]] for n in r["nearest"])


def test_nearest_takes_any_number(spark):
    rng = np.random.default_rng(2)
    examples = [(i, "c", rng.normal(size=4).tolist()) for i in range(50)]
    d, e = frames(spark, [(i, rng.normal(size=4).tolist()) for i in range(20)], examples)
    e = e.withColumns({"name": F.concat(F.lit("n"), "seq"), "snippet": F.lit("s")})
    d = d.drop("nearest")
    few, many = rank.nearest(d, e, 3).collect(), rank.nearest(d, e, 3, most=10).collect()
    key = lambda r: r["id"]
    for a, b in zip(sorted(few, key=key), sorted(many, key=key)):
        assert [(n["seq"], n["category"], n["name"], n["snippet"], round(n["score"], 9)) for n in a["nearest"]] == [(n["seq"], n["category"], n["name"], n["snippet"], round(n["score"], 9)) for n in b["nearest"]]
        assert rank.taught(F.lit(None), 0.1) is not None


def test_beyond_an_array(spark):
    """More examples than one row may hold: each document finds itself."""
    rows = spark.range(25_000).select("id", F.array(F.cos("id"), F.sin("id"), F.cos(F.col("id") * 3), F.sin(F.col("id") * 7)).alias("vec"))
    found = rank.nearest(rows.where("id % 50 = 0"), rows.select(F.col("id").alias("seq"), F.lit("c").alias("category"), "vec"), 2)
    assert found.count() == 500 and found.where("nearest[0].seq = id and size(nearest) = 2").count() == 500


def test_defined_cases(spark):
    d, e = frames(spark, [(1, [1.0])], [(1, "a", [1.0]), (1, "b", [1.0])])
    with pytest.raises(ValueError):
        knn.nearest_by_blocks(d, e, 2)
    assert knn.nearest_by_blocks(d, e.limit(0), 2).first()["nearest"] == []
    assert knn.nearest_by_blocks(d.limit(0), e.limit(1), 2).collect() == []


def written(spark):
    """Bytes of shuffle files that this application has written so far."""
    time.sleep(1)
    seen = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(seen.apply(i).totalShuffleWrite() for i in range(seen.size()))


@pytest.mark.parametrize("held", [1 << 26, 9_000])
def test_small_blocks_write_no_square(spark, held, monkeypatch):
    """Blocks of single examples, with all of them in one part and in several: a row is dealt once, not once for each block."""
    monkeypatch.setattr(knn, "BYTES", held)
    rng = np.random.default_rng(3)
    vecs = [v.tolist() for v in rng.normal(size=(500, 6)).round(1)]
    examples = [(i, "c", v) for i, v in enumerate(vecs)]
    d, e = frames(spark, list(enumerate(vecs)), examples)
    before = written(spark)
    rows = knn.nearest_by_blocks(d, e, 3, size=64).collect()
    assert written(spark) - before < 1_000_000
    want = brute(list(enumerate(vecs)), examples, 3)
    assert {r["id"]: [n["seq"] for n in r["nearest"]] for r in rows} == want
