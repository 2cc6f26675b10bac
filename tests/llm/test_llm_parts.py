"""Benchmarks beyond one automaton: the parts together find what one automaton does."""

from __future__ import annotations

import random

import pytest

from sortwright.llm import decontam

DOCS = "doc_id long, text string, key string, hits int"


def world(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["é", "漢字", "Übung"]
    items = [(i % 30 if i % 7 else None, " ".join(rng.choices(words, k=rng.choice([3, 8, 20, 60])))) for i in range(60)] + [(900, None), (901, ""), (902, " ".join(rng.choices(words, k=700))), (903, "x" * 400)]
    docs = []
    for i in range(120):
        text = rng.choices(words, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            passage = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(passage) + 1)
            text += passage[a : a + rng.choice([5, 13, 15, 100])]
        docs.append((i if i % 11 else None, "  ".join(text).upper() if i % 5 else ", ".join(text), "k", 1))
    return docs + [(500, None, "k", 1), (501, "", "k", 1), (7, docs[3][1], "k", 1)], items


@pytest.mark.parametrize("most", [300, 2000])
def test_parts_are_one_whole(spark, most):
    docs, items = world(1)
    frame, held = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    assert len(list(decontam.item_parts(held, "item_id", "text", 13, most))) > 3
    key = lambda r: repr(r)
    whole, parts = (sorted(map(tuple, decontam.contamination(frame, held, max_item_bytes=n).collect()), key=key) for n in (1 << 20, most))
    assert parts == whole and any(r[5] for r in whole) and len(whole) == len(docs)
    kept, again = (sorted(map(tuple, decontam.drop_contaminated(frame, held, max_item_bytes=n).collect()), key=key) for n in (1 << 20, most))
    assert kept == again and 0 < len(kept) < len(docs)


def test_pieces_of_a_long_item_have_its_windows(spark):
    _, items = world(2)
    held = spark.createDataFrame(items, "item_id long, text string")
    whole = decontam.item_windows([tuple(r) for r in held.collect()])
    parts: dict = {}
    for part in decontam.item_parts(held, "item_id", "text", 13, 500):
        for window, ids in decontam.item_windows(part).items():
            parts.setdefault(window, set()).update(ids)
    assert parts == whole
