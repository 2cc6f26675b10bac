"""The mix where rows have no id, or share one: against its SQL, and the documents taken against the plan."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from sortwright.llm import mixing, oracles

DOCS = "doc_id long, text string, source string, lang string, size int, times string"


def documents(seed, without_id):
    rng = random.Random(seed)
    rows = []
    for i in range(240):
        text = " ".join(rng.choices(["alpha", "beta!", "gamma#", "delta"], k=rng.randint(1, 30))) + f" {i}"
        doc = None if rng.random() < without_id else i if rng.random() < 0.7 else rng.randint(0, 20) * 1000
        rows.append((doc, text, rng.choice(["s1", "s2", "s3", "s4", None])))
    used = Counter((d, s) for d, _, s in rows if d is not None)
    rows = [r for r in rows if r[0] is None or used[r[0], r[2]] == 1]  # an id stands once in a source, else the SQL leaves ties open
    return rows + [(None, "", "s1"), (None, None, "s2"), (9999, None, "s2")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "en", 1, "x") for r in rows], DOCS).repartition(3)


@pytest.mark.parametrize("without_id", [0.0, 0.3, 1.0])
def test_rows_without_id_follow_the_sql(spark, without_id):
    rows = documents(1, without_id)
    c = duckdb.connect()
    documents_ = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "source": pa.array([r[2] for r in rows], pa.string())})
    c.register("documents", documents_)
    want = Counter((a, b, d, round(t, 6), k) for a, b, d, t, k in c.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({oracles.mix()})").fetchall())
    found = mixing.mix(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in found) == want


@pytest.mark.parametrize("without_id", [0.0, 0.3, 1.0])
def test_documents_taken_are_those_of_the_plan(spark, without_id):
    rows = documents(2, without_id) + [(7, "one text of its own", "s1"), (7, "another text", "s1"), (7, "another text", "s4")] + [(None, "a copy without an id " * 3, "s2")] * 25 + [(8, "a copy with an id " * 3, "s3")] * 25
    docs = frame(spark, rows)
    plan = mixing.mix(docs).collect()
    taken = mixing.mixed_documents(docs)
    assert taken.columns == docs.columns
    got = Counter((r["doc_id"], r["source"], len((r["text"] or "").split())) for r in taken.collect())
    want = Counter()
    for r in plan:
        want[r["doc_id"], r["source"], r["size"]] += r["times"]
    assert got == +want
    by, goal = defaultdict(int), {}
    for r in plan:
        by[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
    words = defaultdict(int)
    for (_, source, size), n in got.items():
        words[source] += size * n
    assert {s: n for s, n in words.items() if n} == {s: n for s, n in by.items() if n}
    assert all(abs(by[s] - goal[s]) <= 30 for s in goal)
