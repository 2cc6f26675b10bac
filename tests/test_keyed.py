"""Keyed stores: the last writer wins, files stay bounded, and what a crash or a second writer leaves does no harm."""

from __future__ import annotations

import json
import random
from pathlib import Path

from sortwright.sources.keyed import KeyedStore

SCHEMA = "key string, n int, tags array<string>"


def rows(spark, held):
    return spark.createDataFrame([(k, n, [f"t{n}"]) for k, n in held], SCHEMA).repartition(3)


def content(df):
    return {r["key"]: (r["n"], r["tags"]) for r in df.collect()}


def files(path):
    return [p for p in Path(path).rglob("*.parquet")]


def test_ten_runs(spark, tmp_path):
    rng = random.Random(1)
    store, want = KeyedStore(spark, f"{tmp_path}/store", SCHEMA, buckets=2, runs=3), {}
    for n in range(10):
        some = [f"k{rng.randrange(40)}" for _ in range(15)]
        store.put(rows(spark, [(k, n) for k in some] + [(None, n)]))
        want |= {k: (n, [f"t{n}"]) for k in some}
        assert content(store.read()) == want
        assert len(files(tmp_path / "store")) <= 2 * 2 * (3 + 1) + 2
    again = KeyedStore(spark, f"file://{tmp_path}/store/", SCHEMA)
    assert content(again.read()) == want and len(again.manifest().runs) <= 3
    asked = spark.createDataFrame([("k1", "a", 1), ("k1", "b", 2), ("nowhere", "c", 3), (None, "d", 4)] + [(f"k{i}", "e", 5) for i in range(40)], "at string, key string, held int")
    found = again.lookup(asked, "at")
    assert found.columns == ["at", "key", "held"]
    out = found.collect()
    assert len(out) == 44 and all((r["held"] and (r["held"]["n"], r["held"]["tags"])) == want.get(r["at"]) for r in out)


def test_lookup_does_not_shuffle_the_store(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/store", SCHEMA, buckets=4)
    for n in range(2):
        store.put(rows(spark, [(f"k{i}", n) for i in range(50)]))
    plan = store.lookup(spark.range(20).selectExpr("concat('k', id) as at"), "at")._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    depth = [next((i for i, c in enumerate(line) if c.isalnum()), 0) for line in lines]
    scans = [i for i, line in enumerate(lines) if "Bucketed: true" in line]
    assert len(scans) == 2
    for i in scans:
        above, at = [], depth[i]
        for j in range(i, -1, -1):
            if depth[j] < at:
                at = depth[j]
                above.append(lines[j])
                if "SortMergeJoin" in lines[j]:
                    break
        assert "SortMergeJoin" in above[-1] and not any("Exchange" in line for line in above), above


def test_newest_of_equal_rows(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/store", SCHEMA)
    assert content(store.read()) == {} and content(store.lookup(rows(spark, [("a", 1)]), "key").select("key", "n", "tags")) == {"a": (1, ["t1"])}
    store.merge()
    store.put(rows(spark, []))
    store.put(rows(spark, [("a", 1), ("a", 3), ("a", 2)]))
    assert content(store.read()) == {"a": (3, ["t3"])}


def test_buckets_grow(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/store", SCHEMA, buckets=1, runs=1, bucket_bytes=1000)
    held = [(f"key number {i}", i) for i in range(400)]
    store.put(rows(spark, held[:200]))
    store.put(rows(spark, held[200:]))
    assert store.manifest().buckets >= 4 and len(content(store.read())) == 400
    store.put(rows(spark, [("key number 7", -1)]))
    assert content(store.lookup(spark.createDataFrame([("key number 7",)], "key string"), "key").select("key", "held.n", "held.tags")) == {"key number 7": (-1, ["t-1"])}


def test_crashes_and_second_writers(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/store", SCHEMA, runs=2)
    store.put(rows(spark, [("a", 1)]))
    store._write(rows(spark, [("a", 9)]), 8)  # a run that no manifest names
    (tmp_path / "store/manifest-7.json").write_text('{"buckets": 8, "ru')  # torn
    assert content(store.read()) == {"a": (1, ["t1"])}
    other = KeyedStore(spark, f"{tmp_path}/store", SCHEMA, runs=2)
    base = store.manifest()
    other.put(rows(spark, [("b", 2)]))
    assert not store._commit(base, 8, ())  # the other was first
    store.put(rows(spark, [("c", 3)]))
    store.put(rows(spark, [("b", 4)]))
    assert content(other.read()) == {"a": (1, ["t1"]), "b": (4, ["t4"]), "c": (3, ["t3"])}
    named = {r for m in (tmp_path / "store").glob("manifest-*.json") if m.name != "manifest-7.json" for r, _ in json.loads(m.read_text())["runs"]}
    assert {p.name for p in (tmp_path / "store").glob("run-*")} <= named
