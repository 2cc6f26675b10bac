"""Free names against a loop that takes items one by one."""

from __future__ import annotations

import random
from pathlib import PurePath

import pytest

from sortwright.plans import free

ITEM = "at long, place string, name string, kind string, n int, _pos string"


def loop(items, taken):
    """at -> free name, as one item after another would get it."""
    used, out = set(taken), {}
    for at, place, name, kind, *_ in sorted(items):
        stem, ext = (name, "") if kind == "folder" else (PurePath(name).stem, PurePath(name).suffix)
        free_, n = name, 1
        while (place, free_) in used:
            n += 1
            free_ = f"{stem} ({n}){ext}"
        used.add((place, free_))
        out[at] = free_
    return out


def check(spark, items, taken=(), span=4):
    frame = spark.createDataFrame([(*i, 7, "x") for i in items], ITEM).repartition(3)
    there = spark.createDataFrame(list(taken), "place string, name string") if taken else None
    found = free.free_names(frame, "place", "name", "at", there, "kind", span=span)
    assert found.columns == [*frame.columns, "free_name"]
    rows = found.collect()
    got = {r["at"]: r["free_name"] for r in rows}
    assert len(rows) == len(items) and got == loop(items, taken)
    assert len({(r["place"], r["free_name"]) for r in rows}) == len(rows)


def files(*names, place="p"):
    return [(i, place, n, "file") for i, n in enumerate(names)]


def test_numbered_neighbours(spark):
    check(spark, files("a.txt", "a.txt", "a (2).txt"))
    check(spark, files("b.txt"), [("p", "b.txt"), ("p", "b (2).txt")])
    check(spark, files("a (2).txt", "a.txt", "a.txt", "a.txt", "a (4).txt", "a (4) (2).txt", "a (4).txt", "a (3).txt"))
    check(spark, [(0, "p", "x", "folder"), (1, "p", "x", "file"), (2, "q", "x", "file"), (3, "p", "x.y", "folder"), (4, "p", "x.y", "folder"), (5, "p", "x.y", "file"), (6, "p", "x.y", "file")])


@pytest.mark.parametrize("seed", range(6))
def test_random_names(spark, seed):
    rng = random.Random(seed)
    names = ["a.txt", "a (2).txt", "a (3).txt", "a (2) (2).txt", "a (02).txt", "a (1).txt", "a (9).txt", "b", "b (2)", "b (2) (3)", ".rc", ".rc (2)", "a.tar.gz", "a.tar (2).gz", "A.txt", "a (2).TXT"]
    if seed == 5:
        names += ["c.d (3)", "c (2).d (3)", "c (2).d", "c.d"]
    items = [(i, rng.choice("pq"), rng.choice(names), "folder" if seed > 3 and rng.random() < 0.3 else "file") for i in range(250)]
    taken = [(rng.choice("pq"), rng.choice(names)) for _ in range(6)] * 2
    check(spark, items, taken, span=rng.choice([3, 16, 1 << 16]))


def test_many_copies_and_late_numbers(spark):
    items = files(*["img.jpg"] * 60, *[f"img ({k}).jpg" for k in range(2, 120, 3)], *["img.jpg"] * 60)
    check(spark, items, span=7)
    check(spark, [(-i, *rest) for i, *rest in items], span=7)


def test_defined_cases(spark):
    assert free.free_names(spark.createDataFrame([], ITEM), "place", "name", "at").collect() == []
    rows = spark.createDataFrame([(1, None, "a", "file", 1, ""), (2, None, "a", "file", 1, ""), (3, "", "a", "file", 1, ""), (4, None, None, "file", 1, "")], ITEM).drop("_pos")
    assert {r["at"]: r["free_name"] for r in free.free_names(rows, "place", "name", "at").collect()} == {1: "a", 2: "a (2)", 3: "a", 4: None}
