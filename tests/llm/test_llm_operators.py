"""The corpus operators against brute force, on small fixtures with nulls, repeats, ties and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sortwright.llm import decontam, huffman, likelihood, minhash, mixing, reputation, secrets, substring, toxicity, winnow
from sortwright.llm.tokens import encoder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, digest string, at long, n long, kinds string"


def frame(spark, rows, schema=SCHEMA):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, s, "x", 1, 2, "y") for i, t, s in rows], schema).repartition(3)


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=rng.randint(60, 200))) for _ in range(n // 3)]
    shared = " ".join(rng.choices(words, k=60))
    rows = [(i, t, f"s{i % 4}") for i, t in enumerate(base)]
    for i, t in enumerate(base):
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((100 + i, " ".join(w), "s1"))
    rows += [(200, base[0], None), (201, base[0].upper(), "s1"), (202, f"before {shared}\nafter", "s2"), (203, f"other\t{shared} end", "s3"), (204, "x " * 90, "s1"), (205, None, "s1"), (206, "", "s2"), (207, "one two", None), (208, "one two", "s2"), (None, base[1], "s1"), (None, "lone text of a few words without an id", None), (209, "é ü   ñ " * 30, "s1"), (210, " ".join(base), "s9")]
    rows += [(100, rows[20][1], "s1")]
    return rows


def words_of(text):
    return WORD.findall(text or "")


# Token file


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from(list("aA zZ'sS.,!09éßÉñ¿<|>İ́ \n\t\x1c½²Σ漢🙂")), max_size=60))
def test_encoding_follows_the_library(text):
    import pyarrow as pa

    own = encoder(VOCABULARY)
    ids, at = own.encode(pa.array([text, None, "x " + text]))
    plain = Tokenizer.from_file(VOCABULARY)
    want = [plain.encode(t, add_special_tokens=False).ids for t in (text, "", "x " + text)]
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=1, max_size=300), st.integers(9, 16))
def test_code_lengths(counts, limit):
    counts = np.array(counts)
    bits = huffman.code_lengths(counts, limit)
    assert bits.max() <= limit and sum(2.0 ** -int(b) for b in bits) <= 1
    import heapq

    heap, free = [(int(c), i, 0) for i, c in enumerate(counts)], 0
    heapq.heapify(heap)
    k = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        free += a[0] + b[0]
        k += 1
        heapq.heappush(heap, (a[0] + b[0], k, max(a[2], b[2]) + 1))
    if heap[0][2] <= limit and len(counts) > 1:
        assert int((counts * bits).sum()) == free


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=700))
def test_code_round_trip(ids):
    ids = np.array(ids)
    values, counts = np.unique(ids, return_counts=True)
    code = huffman.Code(values, huffman.code_lengths(counts))
    payload, marks = code.encode(ids)
    assert code.decode(payload, marks, len(ids)).tolist() == ids.tolist()


def test_token_file(spark, tmp_path):
    rows = corpus()
    path = f"file://{tmp_path}/tokens"
    huffman.write_tokens(frame(spark, rows), path, VOCABULARY, block_ids=500)
    plain = Tokenizer.from_file(VOCABULARY)
    want = sorted(((i is not None, i or 0), np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for i, t, _ in rows)
    back = huffman.read_tokens(spark, path).orderBy("shard", "block", "place").collect()
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in back) == Counter((k[1] if k[0] else None, raw) for k, raw in want)
    assert [r["doc_id"] for r in back] == [k[1] if k[0] else None for k, _ in want]
    start, expected = 0, []
    for r in back:
        expected.append((r["doc_id"], start, len(r["ids"]) // 4, zlib.crc32(bytes(r["ids"]))))
        start += len(r["ids"]) // 4
    assert sorted(map(repr, (tuple(r) for r in huffman.read_digests(spark, path).collect()))) == sorted(map(repr, expected))
    huffman.write_tokens(frame(spark, []), f"{path}-none", VOCABULARY)
    assert huffman.read_digests(spark, f"{path}-none").collect() == []


# Mixing


def test_mix(spark):
    rows = corpus()
    found = mixing.mix(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    total, by = sum(r["size"] for r in found), defaultdict(list)
    for r in found:
        by[r["source"]].append(r)
        assert r["size"] * 0 <= r["taken"] <= 3 * r["size"]
    order = sorted((s for s in by if s is not None)) + [None]
    size = {s: sum(r["size"] for r in by[s]) for s in by}
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_, rest = dict.fromkeys(order, 0.0), set(order), float(total)
    while rest > 1e-9 and open_:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if target[s] + level * weight[s] > 3 * size[s]}
        for s in open_:
            target[s] += level * weight[s]
        rest = sum(target[s] - 3 * size[s] for s in full)
        for s in full:
            target[s] = 3.0 * size[s]
        open_ -= full
    for s in order:
        assert by[s][0]["target"] == pytest.approx(target[s]) and by[s][0]["source_size"] == size[s]
        assert abs(sum(r["taken"] for r in by[s]) - target[s]) <= max(r["size"] for r in by[s]) / 2 + 1e-6
        assert max(r["times"] for r in by[s]) - min(r["times"] for r in by[s]) <= 1
    again = mixing.mix(frame(spark, list(reversed(rows)))).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))
    assert mixing.mix(frame(spark, [])).collect() == []
    docs = mixing.mixed_documents(frame(spark, rows[:20]))
    assert docs.columns == frame(spark, rows).columns


# Substrings


def removed_by_force(rows, width):
    count, texts = Counter(), [words_of(t) for _, t, _ in rows]
    for w in texts:
        count.update(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    out = []
    for (i, _, _), w in zip(rows, texts):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if count[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches,width", [(1, 35), (3, 35), (5, 12)])
def test_substring_dedup(spark, batches, width):
    rows = corpus(batches)
    found = substring.repeated_words(frame(spark, rows), width=width, n_batches=batches).collect()
    assert sorted((tuple(r)[:4] for r in found), key=repr) == removed_by_force(rows, width)
    for r in found:
        assert sum(c["end"] - c["start"] for c in r["cuts"]) == r["n_removed"]


def test_substring_empty(spark):
    assert substring.repeated_words(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        substring.repeated_words(frame(spark, []), width=8)


def thue_morse(n=1024):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def long_text(rng, n):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**7)}" for _ in range(n))


def test_substring_of_look_alike_words(spark):
    """Words on which any polynomial hash modulo a power of two agrees are told apart."""
    one, two = thue_morse()
    lead = " ".join(f"w{i}" for i in range(34))
    rows = [(1, f"{lead} {one}", "s"), (2, f"{lead} {two}", "s")]
    assert {tuple(r)[1:3] for r in substring.repeated_words(frame(spark, rows)).collect()} == {(35, 0)}


def test_substring_of_texts_beyond_a_block(spark):
    rng = random.Random(8)
    a, b, shared = long_text(rng, 250_000), long_text(rng, 150_000), long_text(rng, 40_000)
    rows = [(1, f"{a} {shared}", "s"), (2, f"{shared} {b}", "s"), (3, "short", "s"), (4, None, "s"), (5, f"x {shared[:400]}", "s")]
    found = substring.repeated_words(frame(spark, rows), n_batches=2).collect()
    assert sorted((tuple(r)[:4] for r in found), key=repr) == removed_by_force(rows, 35)


def test_index_is_continued(spark, tmp_path):
    """A second batch, in another session's hands, probes the sorted runs in place and reads candidates alone."""
    path, rows = f"file://{tmp_path}/index", corpus(7)
    first = [r for r in rows if r[0] is None or r[0] < 100]
    second = [r for r in rows if r not in first]
    corpus_df = frame(spark, rows)
    index = substring.FingerprintIndex(spark, path)
    index.add(substring.digests(frame(spark, first)), corpus_df)
    index.close()
    again = substring.FingerprintIndex.open(spark, path)
    plan = again._sorted("prints", again.runs["prints"][0]).join(again._sorted("prints", again.runs["prints"][0]).hint("merge"), "print", "left_semi")
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    read = again.add(substring.digests(frame(spark, second)), corpus_df)
    owners = {hashlib.md5((t or "").encode()).digest() for _, t, _ in rows}
    assert 0 < read.count() < len(owners)
    report = {bytes(r["digest"]): r for r in again.report(corpus_df).collect()}
    want = removed_by_force(rows, 35)
    by_text = {(i, t): None for i, t, _ in rows}
    for i, t in by_text:
        r = report[hashlib.md5((t or "").encode()).digest()] if t is not None else None
        n = len(words_of(t))
        cut = 0 if r is None else n if r["copies"] > 1 and n >= 35 else r["n_cut"] or 0
        assert (i, n, cut) in {w[:3] for w in want}
    for i in range(3):
        again.add(substring.digests(frame(spark, [(900 + i, f"more {i} " + rows[0][1], "s")])), corpus_df.union(frame(spark, [(900 + i, f"more {i} " + rows[0][1], "s")])))
    assert len(again.runs["prints"]) < 4
    again.close()


# Toxicity


def test_ordinal_regression_orders_grades():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 6)) < 0.3
    latent = x @ np.array([2.0, 1.0, -1.5, 0, 0, 0.5]) + rng.logistic(0, 0.5, 3000)
    grades = np.digitize(latent, [0.5, 1.5, 2.5])
    w, cuts = toxicity.fit_ordinal([list(np.flatnonzero(r)) for r in x], grades, 6)
    assert (np.diff(cuts) > 0).all() and w[0] > w[1] > w[5] > w[3] > w[2] - 0.2
    up = 1 / (1 + np.exp(cuts - (x @ w)[:, None]))
    assert np.corrcoef(up.sum(1), grades)[0, 1] > 0.8


def test_toxicity_by_force(spark):
    """Severity is the sum over cuts of the logistic of the weights of a text's words less the cut."""
    model = toxicity.OrdinalModel({b"bad": 2.0, b"worse": 3.5, b"\xc3\xa9": -1.0}, [1.0, 4.0])
    rows = [(1, "BAD, worse!", "s"), (2, "bad bad é", "s"), (3, None, "s"), (4, "", "s"), (None, "worse", "s"), (1, "fine", "s"), (6, "bad " * 400_000, "s")]
    x = {(1, 5.5), (2, 1.0), (3, 0.0), (4, 0.0), (None, 3.5), (1, 0.0), (6, 2.0)}
    want = sorted((repr(i), sum(1 / (1 + np.exp(c - v)) for c in model.cuts), 1 / (1 + np.exp(1.0 - v)) < 0.5) for i, v in x)
    found = sorted((repr(r["doc_id"]), r["severity"], r["kept"]) for r in toxicity.severity(frame(spark, rows), model).collect())
    assert [f[0::2] for f in found] == [w[0::2] for w in want] and [f[1] for f in found] == pytest.approx([w[1] for w in want])


def test_toxicity_held_out(spark):
    rng = random.Random(3)
    clean, bad = [f"w{i}" for i in range(300)], ["scum", "idiot", "moron", "trash"]
    rows, labels = [], []
    for i in range(500):
        toxic = i % 5 == 0
        text = rng.choices(clean, k=rng.randint(20, 60)) + (rng.sample(bad, rng.randint(1, 4)) if toxic else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text).upper() if i % 2 else " ".join(text), "s"))
        labels.append((i, int(toxic) if rng.random() > 0.03 else int(not toxic)))
    rows += [(900, None, "s"), (901, "", "s"), (None, "a scum, an idiot!", "s")]
    model = toxicity.fit(frame(spark, rows), spark.createDataFrame(labels[:350] + [(7777, 1), (3, None)], "doc_id long, toxic int"))
    assert len(model.cuts) == 1
    found = {r["doc_id"]: r for r in toxicity.severity(frame(spark, rows), model).collect()}
    right = sum(found[i]["kept"] == (i % 5 != 0) for i in range(350, 500))
    assert right >= 148 and found[900]["kept"] and found[901]["kept"] and not found[None]["kept"]
    kept = toxicity.drop_toxic(frame(spark, rows), model)
    assert kept.columns == frame(spark, rows).columns and kept.count() == sum(r["kept"] for r in found.values())
    assert toxicity.severity(frame(spark, rows[:3]), toxicity.OrdinalModel()).where("kept and severity = 0").count() == 3
    assert toxicity.fit(frame(spark, []), spark.createDataFrame([], "doc_id long, toxic int")).cuts == []


# Near duplicates


def groups_by_force(rows, percent=85):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = []
    for _, t, _ in rows:
        w = words_of(lower(t))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            same = rows[a][0] is not None and rows[a][0] == rows[b][0]
            n = len(sets[a] & sets[b])
            if (n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)) or (same and sets[a] and sets[b]):
                x, y = root[a], root[b]
                root = [y if r == x else r for r in root]
    out = []
    for i, (doc, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        comp = doc if not sets[i] else min(ids, default=None)
        out.append((doc, len(sets[i]), comp, doc is not None and doc == comp))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [192, 2])
def test_near_duplicates(spark, block):
    rows = [r for r in corpus(5) if r[0] != 100]
    w = [f"v{i}" for i in range(60)]
    rows += [(300 + k, " ".join(w[:k] + [f"q{k}"] + w[k + 1 :]), "fam") for k in range(12)] + [(None, " ".join(w), "fam"), (None, "lone text of a few words without an id", "t")]
    found = minhash.near_duplicates(frame(spark, rows), block=block).collect()
    assert sorted(map(tuple, found), key=repr) == groups_by_force(rows)


def test_large_buckets_lose_no_link(spark):
    """One bucket of many near copies, some of which are linked only through others: pivots and all pairs agree."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.choice([1, 1, 2, 3, 4, 6])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(w), "s"))
    found = sorted(map(tuple, minhash.near_duplicates(frame(spark, rows), block=16, bands=40, rows=2).collect()), key=repr)
    assert found == groups_by_force(rows)


def test_near_duplicates_of_look_alike_words(spark):
    one, two = thue_morse()
    assert {tuple(r) for r in minhash.near_duplicates(frame(spark, [(1, one, "s"), (2, two, "s")])).collect()} == {(1, 1, 1, True), (2, 1, 2, True)}


def test_near_duplicates_beyond_a_block(spark):
    rng = random.Random(9)
    words = long_text(rng, 160_000).split()
    rows = [(5, " ".join(words), "s"), (6, " ".join(words[:-5000]).upper(), "s"), (7, " ".join(words[:80_000]), "s"), (8, "tiny", "s")]
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert found == {5: 5, 6: 5, 7: 7, 8: 8}


@pytest.mark.parametrize("percent,bands", [(85, 16), (80, 24)])
def test_banding_recall(percent, bands):
    """Of 3,000 pairs of sets at the threshold, at most a few in ten thousand share no band."""
    rng, missed, n = np.random.default_rng(5), 0, 400
    common = -(-2 * n * percent // (100 + percent))
    for lo in range(0, 3000, 500):
        sets, at = [], [0]
        for _ in range(500):
            pool = rng.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64)
            sets += [pool[:n], pool[n - common :]]
            at += [at[-1] + n, at[-1] + 2 * n]
        sig = minhash.signatures(np.concatenate(sets), np.array(at), 4 * bands).reshape(-1, 2, bands, 4)
        missed += int((~(sig[:, 0] == sig[:, 1]).all(axis=2).any(axis=1)).sum())
    assert missed <= 2


def test_circulant_signatures_estimate_jaccard():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 1200, dtype=np.uint64)
    a, b = pool[:1000], pool[200:]
    sig = minhash.signatures(np.concatenate([a, b]), np.array([0, 1000, 2000]), 1024)
    assert abs((sig[0] == sig[1]).mean() - 800 / 1200) < 0.06


def test_near_duplicates_empty(spark):
    assert minhash.near_duplicates(frame(spark, [])).collect() == []
    assert [tuple(r) for r in minhash.near_duplicates(frame(spark, [(1, None, None)])).collect()] == [(1, 0, 1, True)]


# URLs


def test_reputation(spark):
    pages = [(1, "http://A.Example.com/en/x?q"), (2, "https://www.example.com/en/"), (3, "http://x.net/es/1#f"), (4, "http://x.net/de/"), (5, None), (6, "no scheme"), (7, "http://good.com"), (8, "http://sub.www.example.com/en/a"), (9, "http://shop.co.uk/a"), (9, "http://shop.co.uk/a"), (None, "http://x.net/de/")]
    bad = [(100 + i, f"http://bad.org/p{i}") for i in range(40)] + [(200 + i, f"http://fine.org/p{i}") for i in range(40)]
    outcomes = [(100 + i, False) for i in range(40)] + [(200 + i, True) for i in range(40)] + [(4, None), (4, True)]
    df = spark.createDataFrame([(*p, "h", 1.0) for p in pages + bad], "page_id long, url string, host string, mean double")
    found = {r["page_id"]: r for r in reputation.judge(df, spark.createDataFrame(outcomes, "page_id long, good boolean")).collect()}
    got = {k: (r["host"], r["path"], r["rule"], r["verdict"]) for k, r in found.items()}
    assert got[1] == ("a.example.com", "/en/x", "example.com/en/", "block") and got[2] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert got[3] == ("x.net", "/es/1", "net/es/", "block") and got[4] == ("x.net", "/de/", None, "allow") and got[5] == ("", "", None, "allow") == got[6]
    assert got[7] == ("good.com", "", None, "allow") and got[8][2] == "www.example.com/en/" and got[120][3] == "block" and got[220][3] == "allow"
    assert df.select(reputation.domain_of(F.lit("a.shop.co.uk")), reputation.domain_of(F.lit("a.b.com")), reputation.suffix_of(F.lit("x"))).first() == ("shop.co.uk", "b.com", "x")
    assert reputation.judge(df.limit(0), spark.createDataFrame([], "page_id long, good boolean")).collect() == []
    assert reputation.judge(df, spark.createDataFrame([], "page_id long, good boolean")).where("rule is null and verdict = 'block'").count() == 0


def test_reputation_of_unlabelled_hosts(spark):
    pages = [(i, f"http://h{i % 4}.bad.biz:8080/p{i}") for i in range(80)] + [(100 + i, f"http://h{i % 4}.fine.org/p{i}") for i in range(80)] + [(900, "http://new.bad.biz/x"), (901, "http://new.fine.org/x"), (902, "http://new.xyz/x")]
    df = spark.createDataFrame(pages, "page_id long, url string")
    outcomes = spark.createDataFrame([(i, i >= 100) for i, _ in pages if i < 900], "page_id long, good boolean")
    found = {r["page_id"]: r["verdict"] for r in reputation.judge(df, outcomes).collect()}
    assert (found[0], found[100], found[900], found[901], found[902]) == ("block", "allow", "block", "allow", "allow")
    assert reputation.judge(df, outcomes.limit(0)).where("verdict = 'block'").count() == 0


def test_share_below_the_floor(spark):
    """Against the closed form: for whole a and b the share is a binomial tail."""
    from math import comb

    cases = [(1, 1), (2, 1), (1, 9), (3, 4), (30, 5), (40, 40), (90, 120), (1, 300)]
    want = {(a, b): sum(comb(a + b - 1, j) for j in range(a, a + b)) / 2 ** (a + b - 1) for a, b in cases}
    df = spark.createDataFrame([(float(a), float(b)) for a, b in cases] + [(0.05, 0.9), (1e6, 9e5), (0.3, 0.3)], "a double, b double")
    found = {(r["a"], r["b"]): r["p"] for r in df.select("a", "b", reputation.below(F.col("a"), F.col("b")).alias("p")).collect()}
    assert all(found[float(a), float(b)] == pytest.approx(p, abs=1e-4) for (a, b), p in want.items())
    assert found[1e6, 9e5] < 1e-6 and found[0.3, 0.3] == pytest.approx(0.5, abs=1e-6) and 0.9 < found[0.05, 0.9] < 1


# Quality


def base_by_force(text):
    text = text or ""
    w = words_of(text)
    count = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    mark = [False] * len(w)
    for k in range(len(w) - 2):
        if count[tuple(w[k : k + 3])] > 1:
            mark[k : k + 3] = [True] * 3
    lines = [x for x in text.split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(mark), len(w) < 50 or 100 * sum(mark) > 50 * len(w)


def test_quality(spark):
    rows = corpus() + [(400, "a b c a b c x\n\nline\nline \nline", "s"), (401, "# * <b> || & 100%\n" * 30, "s"), (402, "z z z z", "s")]
    rows += [(500 + i, " ".join(f"@@{i}{j}" for j in range(80)), "junk") for i in range(5)]
    trusted = spark.createDataFrame([(i,) for i in [*range(20), *range(100, 120), 200, 201, 202, 203, 210]] + [(None,), (3,)], "doc_id long")
    found = likelihood.quality(frame(spark, rows), trusted).collect()
    assert sorted((repr(r["doc_id"]), *tuple(r)[1:7]) for r in found) == sorted((repr(i), *base_by_force(t)) for i, t, _ in rows)
    by = {r["doc_id"]: r for r in found}
    assert all(by[i]["kept"] for i in range(20)) and not any(by[500 + i]["kept"] for i in range(5)) and by[205]["score"] == 0.0
    none = likelihood.quality(frame(spark, rows), spark.createDataFrame([], "doc_id long"))
    assert none.where("score <> 0").count() == 0 and likelihood.quality(frame(spark, []), trusted).collect() == []


def quality_by_force(rows, trusted, buckets):
    """Scores by hand, with the hash of the public xxhash library."""
    import math
    import struct

    import xxhash

    one = lambda w: xxhash.xxh64_intdigest(w.encode(), seed=42)
    long = lambda v, seed: xxhash.xxh64_intdigest(struct.pack("<Q", v), seed=seed)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    grams = []
    for _, t, _ in rows:
        h = [one(w) for w in words_of(t)]
        grams.append([signed(v) % buckets for v in h + [long(b, long(a, 42)) for a, b in zip(h, h[1:])]])
    n, t = [1] * buckets, [1] * buckets
    for (i, _, _), g in zip(rows, grams):
        for x in g:
            n[x] += 1
            t[x] += i in trusted
    base = math.log(sum(n) / sum(t))
    weight = [float(f"{math.log(a / b) + base:.6f}") for a, b in zip(t, n)]
    return [(i, sum(weight[x] for x in g) / len(g) if g else 0.0) for (i, _, _), g in zip(rows, grams)]


@pytest.mark.parametrize("sent", [1_000_000, 1000])
def test_quality_counts_every_label(spark, sent, monkeypatch):
    """The first 20,000 ids by their hash speak against the plain texts, the other 5,000 for them; and all ids are trusted."""
    monkeypatch.setattr(likelihood, "MAX_SENT", sent)
    fancy, plain = (" ".join(f"{x}{j}" for j in range(60)) for x in "fp")
    order = F.row_number().over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = spark.range(25_000).select(F.col("id").alias("doc_id")).withColumn("at", order)
    rows = ids.select("doc_id", F.when((F.col("at") > 20_000) | (F.col("at") <= 10), plain).otherwise(fancy).alias("text"), F.lit("s").alias("source"), "at")
    found = likelihood.quality(rows, rows.where("at between 11 and 2000"), judged=rows.select("doc_id", (F.col("at") > 10).alias("good")))
    assert found.where("kept").count() == 25_000
    assert set(likelihood.weights(rows, rows, "doc_id", "text", "doc_id", 1 << 12)) == {0.0}


def test_quality_scores_and_verdicts(spark):
    rows = corpus(2) + [(500 + i, " ".join(f"@@{i}{j}" for j in range(80)), "junk") for i in range(8)]
    good = set(range(20)) | set(range(100, 110))
    df = frame(spark, rows)
    judged = spark.createDataFrame([(i, True) for i in range(20)] + [(500 + i, False) for i in range(8)] + [(3, None), (None, True)], "doc_id long, good boolean")
    found = likelihood.quality(df, spark.createDataFrame([(i,) for i in good], "doc_id long"), buckets=1 << 12, judged=judged).collect()
    want = quality_by_force(rows, good, 1 << 12)
    got, held = (sorted((repr(i), round(x, 5)) for i, x in side) for side in ([(r["doc_id"], r["score"]) for r in found], want))
    assert [i for i, _ in got] == [i for i, _ in held] and [x for _, x in got] == pytest.approx([x for _, x in held], abs=2e-5)
    bins = defaultdict(lambda: [0, 0])
    failed = {i: base_by_force(t)[5] for i, t, _ in rows}
    for i, x in want:
        if i is not None and not failed[i] and (i in range(20) or i >= 500):
            bins[int(np.floor(x / likelihood.STEP))][i >= 500] += 1
    threshold = likelihood.best_cut({k: tuple(v) for k, v in bins.items()}) * likelihood.STEP
    scores = defaultdict(list)
    for i, x in want:
        scores[i].append(x)
    assert all(r["kept"] == (not r["base_failed"] and r["score"] >= threshold) for r in found)
    assert all(r["kept"] for r in found if r["doc_id"] in range(20)) and not any(r["kept"] for r in found if (r["doc_id"] or 0) >= 500)


def test_best_cut():
    assert likelihood.best_cut({-90: (0, 3), -60: (0, 2), -20: (4, 0), 5: (9, 0)}) == -40
    assert likelihood.best_cut({-90: (0, 3), -80: (1, 0), -60: (0, 2), -20: (4, 0)}) == -40
    assert likelihood.best_cut({-90: (3, 0), -60: (2, 1)}) == -90 and likelihood.best_cut({1: (0, 4), 2: (1, 0)}) == 2
    assert likelihood.best_cut({}) is None and likelihood.best_cut({1: (3, 0)}) is None and likelihood.best_cut({1: (0, 3)}) is None


# Decontamination


def test_contamination(spark):
    items = [(1, " ".join(f"q{i}" for i in range(20))), (2, "Short, ANSWER!"), (3, None), (4, "..."), (None, "hidden item words"), (12, "short answer")]
    doc = "Start " + ", ".join(f"Q{i}" for i in range(2, 16)) + " end"
    rows = [(1, doc, "s"), (2, "é a short -- answer here", "s"), (3, None, "s"), (4, "unshort answer", "s"), (5, "word " * 100 + "short answer", "s"), (6, "hidden item words", "s"), (None, "short answer", "s"), (2, "clean", "s")]
    df = decontam.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r["doc_id"], r["n_words"]): (r["n_hit"], r["items"], [tuple(s) for s in r["spans"]], r["contaminated"]) for r in df.collect()}
    assert found[1, 16] == (14, [1], [(6, 6 + len(doc) - 10)], True)
    assert found[2, 5] == (2, [2, 12], [(4, 19)], True) and found[3, 0] == (0, [], [], False) and found[4, 2] == (0, [], [], False)
    assert found[5, 102] == (2, [2, 12], [(500, 512)], False) and found[6, 3] == (3, [], [(0, 17)], True) and found[None, 2][3] and found[2, 1] == (0, [], [], False)
    kept = decontam.drop_contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == ["2", "3", "4", "5"] and kept.columns == frame(spark, rows).columns
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(frame(spark, rows), nothing).where("contaminated").count() == 0
    assert decontam.contamination(frame(spark, []), nothing).collect() == []
    rng = random.Random(6)
    far = long_text(rng, 200_000) + " " + items[0][1] + " " + long_text(rng, 50_000)
    one = decontam.contamination(frame(spark, [(1, far, "s"), (2, "x", "s")]), spark.createDataFrame(items, "item_id long, text string")).where("doc_id = 1").first()
    assert one["n_hit"] == 20 and one["items"] == [1] and far[one["spans"][0]["start"] : one["spans"][0]["end"]] == items[0][1]
    # Beyond the bound of one automaton the items go in parts, with the same result.
    held = spark.createDataFrame(items, "item_id long, text string")
    whole, parts = (sorted(map(repr, decontam.contamination(frame(spark, rows), held, max_item_bytes=n).collect())) for n in (1 << 20, 200))
    assert whole == parts


def test_item_sets_one_after_another(spark):
    """A worker that still holds the automaton of other items does not use it."""
    docs = frame(spark, [(i, f"only item{i} here", "s") for i in range(6)] * 4)
    for i in range(6):
        found = decontam.contamination(docs, spark.createDataFrame([(i, f"item{i}")], "item_id long, text string")).where("contaminated")
        assert {(r["doc_id"], *r["items"]) for r in found.collect()} == {(i, i)}


# Lines


def lines_by_force(rows, gram=winnow.GRAM, span=winnow.SPAN, heavy=winnow.HEAVY, long=winnow.LONG):
    """The rule by hand: selected lines, their first places, and the stretches around them."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    docs = []
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        docs.append((i, [(k, s) for k, x in enumerate((t or "").split("\n")) if (s := x.strip(" \t\n\v\f\r"))]))
    first, posts = {}, []
    for d, (_, full) in enumerate(docs):
        keys = [md5(x) for _, x in full]
        grams = [md5("\n".join([keys[p + j] if p + j < len(keys) else "" for j in range(gram)])) for p in range(len(keys))]
        chosen = {min((grams[q], q) for q in range(p, min(p + span, len(grams))))[::-1] for p in range(max(len(grams) - span, 0) + 1) if grams}
        chosen |= {(p, md5("\n".join([keys[p]] + [""] * (gram - 1)))) for p, (_, x) in enumerate(full) if len(x) >= heavy}
        for p, g in sorted(chosen):
            posts.append((d, p, g))
            first.setdefault(g, (d, p))
    gone = defaultdict(set)
    for d, p, g in posts:
        home, q = first[g]
        if (home, q) == (d, p):
            continue
        own, other = [x for _, x in docs[d][1]], [x for _, x in docs[home][1]]
        lo, hi = p, p
        if own[p] != other[q]:
            continue
        while lo > 0 and lo - 1 + q - p >= 0 and own[lo - 1] == other[lo - 1 + q - p]:
            lo -= 1
        while hi + 1 < len(own) and hi + 1 + q - p < len(other) and own[hi + 1] == other[hi + 1 + q - p]:
            hi += 1
        if hi - lo + 1 >= min(gram + span - 1, len(own)) or sum(map(len, own[lo : hi + 1])) >= long:
            gone[d].update(range(lo, hi + 1))
    return {i: (len(full), len(gone[d]), sorted(full[k][0] for k in gone[d])) for d, (i, full) in enumerate(docs)}


def test_line_dedup(spark):
    a = [f"line {i}" for i in range(8)]
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "\n".join(a), "s"), (2, "\n".join(["x", *a[2:7], "y"]), "s"), (3, "\n\n".join([" " + x for x in a[:3]]), "s"), (4, "\n".join(a[:2]), "s"), (5, "r\n" * 9, "s"), (6, None, "s"), (7, "", "s"), (None, "\n".join(a[4:8]), "s"), (8, "\n".join(a), "s"), (9, "p\nq\nr\ns\np\nq\nr\ns\np", "s")]
    rows += [(20, f"menu\n{long}\nx", "s"), (21, f"a\nmenu\nb\n{long}\n{long[:200]}", "s"), (22, "one\n\ntwo", "s"), (23, "one\ntwo", "s"), (24, "only", "s"), (25, " only ", "s")]
    found = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["removed"]) for r in winnow.repeated_lines(frame(spark, rows)).collect()}
    assert found == lines_by_force(rows)
    assert found[2][2] == [1, 2, 3, 4, 5] and found[8][1] == 8 and found[5][1] == 8 and found[9][1] == 5 and found[6] == (0, 0, [])
    # Long passages on one line, and copies of short documents, go as well; short repeats stay.
    assert found[21][2] == [3] and found[23][1] == 2 and found[25][1] == 1 and found[3][1] == 3
    assert winnow.repeated_lines(frame(spark, [])).collect() == []
    text = spark.range(1).select(winnow.without_lines(F.lit("a\nb\nc"), F.array(F.lit(1))))
    assert text.first()[0] == "a\nc"


def test_line_dedup_at_random(spark):
    rng = random.Random(11)
    pool = [f"some line {i}" for i in range(30)]
    rows = [(i, "\n".join(rng.choices(pool[: 5 if i % 4 == 0 else 30], k=rng.randint(1, 25))), "s") for i in range(60)]
    rows += [(100 + i, rows[i][1] + ("\nend" if i % 2 else ""), "s") for i in range(20)]
    found = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["removed"]) for r in winnow.repeated_lines(frame(spark, rows)).collect()}
    assert found == lines_by_force(rows)


def test_postings_are_a_fraction(spark):
    n = 4000
    text = "\n".join(f"line {i * 7919 % 100_003}" for i in range(n))
    marked = spark.createDataFrame([(text,)], "t string").select(F.size(winnow._postings(winnow._lines(F.col("t")), winnow.GRAM, winnow.SPAN, winnow.HEAVY)))
    assert marked.first()[0] < 0.55 * n


def test_single_lines(spark):
    rows = [(1, "menu\nx\ny", "s"), (2, "a\nmenu\nb", "s"), (4, "only", "s"), (5, " only ", "s"), (7, "one\ntwo", "s"), (None, "x", "s"), (8, None, "s")]
    found = {r["doc_id"]: r["removed"] for r in winnow.repeated_lines(frame(spark, rows), gram=1, span=1).collect()}
    assert found == {None: [], 1: [1], 2: [1], 4: [], 5: [0], 7: [], 8: []}


def runs(rng, lines, n, most):
    return [x for _ in range(n) for x in [rng.choice(lines)] * rng.randint(1, most)]


@pytest.mark.parametrize(("seed", "gram", "span"), [(1, 2, 3), (2, 2, 3), (3, 1, 1), (4, 3, 2), (5, 2, 3)])
def test_runs_of_equal_lines(spark, seed, gram, span):
    rng = random.Random(seed)
    lines = ["a", "b", "-----", "h" * 120, "k " * 90, *[f"other {i}" for i in range(4)]]
    rows = [(i, "\n".join(runs(rng, lines[: rng.choice([1, 2, 5, 9])], rng.randint(1, 6), rng.choice([3, 9, 25]))), "s") for i in range(70)]
    rows += [(200, "x\n" + "a\n" * 30 + "y", "s"), (201, "z\n" + "a\n" * 77 + "y\nend", "s"), (202, "\n".join(["a"] * 30 + ["q"] + ["a"] * 30 + ["y"]), "s"), (203, "a\nb\n" * 20, "s")]
    found = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["removed"]) for r in winnow.repeated_lines(frame(spark, rows), gram=gram, span=span).collect()}
    want = lines_by_force(rows, gram=gram, span=span)
    assert {i: found[i] for i in want if found[i] != want[i]} == {}


def test_a_long_run_is_no_square(spark):
    rows = [(1, "again\n" * 40_000, "s"), (2, "before\n" + "again\n" * 30_000 + "after", "s"), (3, "again\n" * 3, "s")]
    began = time.time()
    found = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in winnow.repeated_lines(frame(spark, rows)).select("doc_id", "n_lines", "n_removed").collect()}
    assert found == {1: (40_000, 39_999), 2: (30_002, 30_000), 3: (3, 3)}
    assert time.time() - began < 120


def lines_by_all_pairs(rows, gram=winnow.GRAM, span=winnow.SPAN, heavy=winnow.HEAVY, long=winnow.LONG):
    """The rule for every earlier place by hand: each text beside each before it and itself, diagonal by diagonal."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    docs = []
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        full = [(k, s) for k, x in enumerate((t or "").split("\n")) if (s := x.strip(" \t\n\v\f\r"))]
        keys = [md5(x) for _, x in full]
        grams = [md5("\n".join([keys[p + j] if p + j < len(keys) else "" for j in range(gram)])) for p in range(len(keys))]
        chosen = {min((grams[q], q) for q in range(p, min(p + span, len(grams)))) for p in range(max(len(grams) - span, 0) + 1) if grams}
        chosen |= {(md5("\n".join([keys[p]] + [""] * (gram - 1))), p) for p, (_, x) in enumerate(full) if len(x) >= heavy}
        docs.append((i, full, chosen))
    result = {}
    for d, (i, full, chosen) in enumerate(docs):
        own, gone = [x for _, x in full], set()
        for b, (_, far, theirs) in enumerate(docs[: d + 1]):
            other = [x for _, x in far]
            for shift in range(-len(own) + 1, len(other) if b < d else 0):
                lo = max(0, -shift)
                while lo < min(len(own), len(other) - shift):
                    hi = lo
                    while hi < min(len(own), len(other) - shift) and own[hi] == other[hi + shift]:
                        hi += 1
                    if any(lo <= p < hi and (g, p + shift) in theirs for g, p in chosen) and (hi - lo >= min(gram + span - 1, len(own)) or sum(map(len, own[lo:hi])) >= long):
                        gone.update(range(lo, hi))
                    lo = max(hi, lo + 1)
        result[i] = (len(full), len(gone), sorted(full[k][0] for k in gone))
    return result


def test_runs_at_second_places(spark):
    """Runs of four lines of which three stand in a text before the one that holds all four, and a short document with a partner only behind the first."""
    rows = []
    for i in range(40):
        a = [f"run {i} line {j}" for j in range(4)]
        rows += [(3 * i, "\n".join([*a[:3], "other"]), "s"), (3 * i + 1, "\n".join([f"before {i}", *a, "after"]), "s"), (3 * i + 2, "\n".join([f"top {i}", *a, f"end {i}"]), "s")]
    found = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["removed"]) for r in winnow.repeated_lines(frame(spark, rows), every=True).collect()}
    assert found == lines_by_all_pairs(rows)
    assert all(found[3 * i + 2][2] == [1, 2, 3, 4] for i in range(40))
    # The first places alone do not find them all.
    assert any(lines_by_force(rows)[3 * i + 2][1] == 0 for i in range(40))


@pytest.mark.parametrize(("seed", "gram", "span"), [(1, 2, 3), (2, 2, 3), (3, 1, 1), (4, 3, 2), (5, 1, 3)])
def test_every_place_by_force(spark, seed, gram, span):
    rng = random.Random(seed)
    lines = ["a", "b", "-----", "h" * 120, "k " * 90, *[f"other {i}" for i in range(4)]]
    rows = [(i, "\n".join(runs(rng, lines[: rng.choice([1, 2, 5, 9])], rng.randint(1, 6), rng.choice([1, 3, 9]))), "s") for i in range(60)]
    rows += [(200, "a\nb\n" * 20, "s"), (201, None, "s"), (202, "", "s"), (None, "b\n\n a\nb", "s"), (203, "b\na\nb", "s"), (204, "x\nb\na", "s")]
    found = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["removed"]) for r in winnow.repeated_lines(frame(spark, rows), gram=gram, span=span, every=True).collect()}
    want = lines_by_all_pairs(rows, gram=gram, span=span)
    assert {i: found[i] for i in want if found[i] != want[i]} == {} and found.keys() == want.keys()
    assert winnow.repeated_lines(frame(spark, []), every=True).collect() == []


def test_turns_of_lines_are_no_square(spark):
    rows = [(1, "one\ntwo\nthree\n" * 12_000, "s"), (2, "before\n" + "one\ntwo\nthree\n" * 9_000 + "after", "s"), (3, "again\n" * 30_000, "s")]
    began = time.time()
    found = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in winnow.repeated_lines(frame(spark, rows), every=True).select("doc_id", "n_lines", "n_removed").collect()}
    assert found == {1: (36_000, 35_997), 2: (27_002, 27_000), 3: (30_000, 29_999)}
    assert time.time() - began < 120


# Secrets


def test_trigram_queries():
    q = {r.kind: secrets.trigram_query(r.pattern) for r in secrets.BASE + secrets.MORE}
    assert q["hex"] == () and frozenset({"aki", "kia"}) in q["access"][0]
    sets = [s for clause in q["assign"] for s in clause]
    assert frozenset({"tok", "oke", "ken"}) in sets and frozenset({"api", "pik", "ike", "key"}) in sets
    assert secrets.trigram_query("a.b") == () and secrets.trigram_query("(abc|abd)x?") and secrets.trigram_query("(abc)+d*") == ((frozenset({"abc"}),),)


def test_secrets(spark):
    hexed, key = "0123456789abcdef" * 2, "AKIA" + "ABCD1234" * 2
    rows = [
        (1, f'é PassWord = "hunter2!" and api_key:abc token=token: abcdefgh', "s"), (2, f"x{hexed}y {key} {key[:19]}", "s"), (3, None, "s"), (4, "", "s"), (5, "nothing here", "s"), (6, f"secret={hexed}", "s"),
        (7, "ghp_" + "a1" * 18, "s"), (None, "passwd: qwerty1", "s"), (1, "token=other123", "s"), (8, "ſecret=abcdefg", "s"), (9, f"{key}{key}", "s"),
    ]
    found = Counter((r["doc_id"], tuple((s["kind"], s["start"], s["end"]) for s in r["spans"])) for r in secrets.find_secrets(frame(spark, rows)).collect())
    want = Counter()
    for i, t, _ in rows:
        spans = []
        for n, r in enumerate(secrets.BASE + secrets.MORE):
            pattern = "[0-9a-f]+" if r.kind == "hex" else r.pattern
            spans += [(m.start(), n, r.kind, m.end()) for m in re.finditer(pattern, t or "") if len(m[r.group]) >= r.least]
        want[i, tuple((k, s, e) for s, _, k, e in sorted(spans))] += 1
    assert found == want
    assert secrets.find_secrets(frame(spark, [])).collect() == []


def test_memo_of_pieces_is_not_walked():
    """Pieces in the older half of the memo are looked up one by one, and what the memo holds is counted right."""
    from sortwright.llm.tokens import Encoder

    class Held(dict):
        def __iter__(self):
            raise AssertionError("walked")

    def counted(pieces):
        return sum(200 + 2 * len(p) + len(ids) for p, ids in pieces.items() if p != "\n")

    own = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    first, _ = own._words(["alpha", "beta"])
    assert own.used == counted(own.pieces)
    own.old, own.pieces, own.used = Held(own.pieces), {}, 0
    ids, at = own._words(["alpha", "gamma", "beta"])
    assert own.used == counted(own.pieces)
    assert first.tolist() == [*ids[at[0] : at[1]], *ids[at[2] : at[3]]]
