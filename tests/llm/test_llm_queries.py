"""The registered queries: SQL where there is some, and the pipeline's stages one after another."""

from __future__ import annotations

import pytest
from oracle import SMALL, same

import corpus_pipeline
from sortwright.llm import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_matches_sql(spark, tmp_path, name):
    same(queries.queries()[name](spark, SMALL), oracles.SQL[name], str(tmp_path / "out"))


def test_thirteen_operators_are_registered():
    names = queries.queries()
    assert all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 14)) and "pipeline" in names


def test_pipeline(spark):
    docs = queries.table(spark, SMALL, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns
        if name != "mixing":
            assert docs.count() <= before
            before = docs.count()
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Null and empty texts, null and repeated ids, and a clashing column pass; copies and passages of the benchmark go."""
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, "a"), (2, text.upper(), "a"), (3, None, None), (4, "", "a"), (None, None, None), (None, "few words", "b"), (7, "same id one two three four", "b"), (7, "same id one two three four", "b"), (8, " ".join(f"q{i}" for i in range(20)), "b")]
    docs = spark.createDataFrame([(*r, "en", 1, "x") for r in rows], "doc_id long, text string, source string, lang string, n_chars long, digest string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(20)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (None, None, None), (9, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r["doc_id"] for r in out}
    assert 1 in kept and not {2, 8} & kept
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_values(spark, tmp_path):
    """The rows of the whole run against each stage's rule by hand; of the mix, how often a document is taken comes from its plan."""
    import random
    import zlib
    from collections import Counter

    import numpy as np
    from tokenizers import Tokenizer

    from sortwright.llm import mixing

    rng = random.Random(4)
    words = [f"word{i}" for i in range(500)]
    exam = " ".join(f"q{i}" for i in range(20))
    texts = [" ".join(rng.choices(words, k=rng.randint(60, 150))) for _ in range(30)]
    near = [t.replace(t.split()[30], "Changed", 1) for t in texts[:6]]
    far = [" ".join(t.split()[:40] + rng.choices(words, k=60)) for t in texts[6:9]]
    dirty = [f"{exam} " + " ".join(rng.choices(words, k=n)) for n in (30, 300, 500)]
    rows = [(i, t, f"s{i % 3}" if i % 7 else None) for i, t in enumerate([*texts, *near, texts[3].upper(), *far, *dirty, "", None, "few words"])]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, exam.upper()), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = {i: shingles(t) for i, t, _ in rows}, {i: i for i, _, _ in rows}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    one = [r for r in rows if root[r[0]] == r[0]]
    assert len(one) == len(rows) - 7

    def hits(t):
        w, q = (t or "").split(), exam.split()
        inside = set()
        for a in range(len(q) - 12):
            inside |= {k for i in range(len(w)) if [x.lower() for x in w[i : i + 13]] == q[a : a + 13] for k in range(i, i + 13)}
        return len(inside), len(w)

    clean = [r for r in one if not hits(r[1])[0] or 20 * hits(r[1])[0] < hits(r[1])[1]]
    assert len(clean) == len(one) - 2
    plan = mixing.mix(spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in clean], schema)).collect()
    times = {r["doc_id"]: r["times"] for r in plan}
    tokenizer = Tokenizer.from_file(queries.vocabulary_path())
    start, want = 0, []
    for i, t, _ in clean:
        for _ in range(times[i]):
            ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
            want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    assert max(times.values()) > 1 and Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == Counter(want)


def test_toxicity_query(spark):
    found = queries.op4_toxicity(spark, SMALL)
    assert found.count() == queries.table(spark, SMALL, "documents").count() and found.where("severity < 0 or p_toxic > 1").count() == 0


def test_quality_query(spark):
    """Of the trusted documents that pass the base rules at least 99 in 100 stay."""
    found = queries.op7_quality(spark, SMALL)
    labels = queries.table(spark, SMALL, "labels").where("quality = 1 and toxic = 0")
    clean = found.join(labels, "doc_id").where("not base_failed")
    assert clean.count() > 40 and clean.where("kept").count() >= 0.99 * clean.count()


def test_labelled_junk_is_rejected(spark):
    found = queries.op7_quality(spark, "/root/testdata/sf0.01").where("not base_failed").join(queries.table(spark, "/root/testdata/sf0.01", "labels"), "doc_id")
    assert found.where("quality = 0").count() > 20 and found.where("quality = 0 and kept").count() == 0
    assert found.where("quality = 1 and not kept").count() == 0
