"""Whitening, byte-level BPE and tokenizer alignment against plain versions of the same definitions."""

from __future__ import annotations

import bisect
import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import SMALL
from tokenizers import Tokenizer

from sortwright.llm import align, bpe, queries, whitening

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
BYTE_LEVEL, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = "aA zZ'slle  \t\n\r\x0b\x0c\x1c\x85\xa0 　.,;})!09²é́ñß¿<|>漢🙂▁"
TEXTS = st.text(st.sampled_from(list(ODD)), max_size=60)
DOCS = "doc_id long, text string, ids string, bytes long, key int, n int, pairs string, `groups` string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, "y", "z") for i, t in rows], DOCS).repartition(3)


def documents(n=40):
    rng = random.Random(5)
    words = ["the", "of", "well", "tokeniser", "naïve", "don't", "x;\r\n}", "1234", "漢字", "qzx" * 4, "é" * 3, "  ", "\n\n", "<|endoftext|>", "%&/(", "🙂🙂"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 80)))) for i in range(n)]
    copy = rows[0][1]
    return rows + [(n, None), (n + 1, ""), (n + 2, " "), (n + 3, "a▁b"), (None, copy), (None, copy), (3, copy), (n + 4, "the " * 3000), (n + 5, "x" * 5000 + " " * 3000), (n + 6, "".join(rng.choices("abcdefgh", k=4000)))]


# Byte-level BPE


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def narrow():
    """Forgets at once, and merges pieces of more than four bytes from a heap."""
    return bpe.Codec(bpe.load_ranks(RANKS), PATTERN, memo=0, widest=4)


def test_bpe_follows_the_library(library, narrow):
    own = bpe.codec(RANKS, PATTERN)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(TEXTS, max_size=4))
    def follows(texts):
        for c in (own, narrow):
            ids, at = c.encode(pa.array([*texts, None], pa.string()))
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library.encode_ordinary(t) for t in texts] + [[]]

    follows()


def test_bpe_long_pieces(library):
    rng = random.Random(2)
    own = bpe.codec(RANKS, PATTERN)
    texts = ["a" * 9000, " " * 5000 + "x", "".join(rng.choices("etaoinshr", k=bpe.WIDEST)), "".join(rng.choices("etaoinshr", k=3 * bpe.WIDEST)), "=" * 4097]
    ids, at = own.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library.encode_ordinary(t) for t in texts]


def test_bpe_other_pattern():
    ranks = {bytes([b]): b for b in range(256)} | {b"b ": 256, b"a,": 257, b"b a,": 258}
    own = bpe.Codec(ranks, r"[\s\S]+")
    plain = tiktoken.Encoding("small", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    for text in ("b a,", "a,b a,b b ", "aab a,,"):
        assert own.encode(pa.array([text]))[0].tolist() == plain.encode_ordinary(text)


def test_bpe_later_pairs_of_lower_rank():
    """A merge may make a pair of a lower rank than itself: the leftmost least one still goes first."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abcd": 257, b"cd": 258, b"bcd": 259, b"cda": 260}
    own, narrow = bpe.Codec(ranks, PATTERN), bpe.Codec(ranks, PATTERN, widest=2)
    plain = tiktoken.Encoding("small", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(0)
    for _ in range(300):
        text = "".join(rng.choices("abcd", k=rng.randint(1, 30)))
        assert own.encode(pa.array([text]))[0].tolist() == narrow.encode(pa.array([text]))[0].tolist() == plain.encode_ordinary(text)


def test_pair_table():
    rng = np.random.default_rng(1)
    pairs = {(int(a), int(b)): i for i, (a, b) in enumerate(rng.integers(0, 60, (900, 2)))}
    table = bpe.PairTable(*(np.array(x) for x in ([a for a, _ in pairs], [b for _, b in pairs], list(pairs.values()))))
    left, right = np.indices((61, 61)).reshape(2, -1) - 1
    assert table.find(left, right).tolist() == [pairs.get((a, b), int(bpe.NONE)) for a, b in zip(left.tolist(), right.tolist())]


def test_bpe_frames(spark, library):
    rows = documents()
    tokens = bpe.encode(frame(spark, rows), RANKS, PATTERN)
    key = lambda r: repr(r)
    assert sorted(((r["doc_id"], r["ids"]) for r in tokens.collect()), key=key) == sorted(((i, library.encode_ordinary(t or "")) for i, t in rows), key=key)
    back = bpe.decode(tokens, RANKS, PATTERN, rows=3).collect()
    assert sorted(((r["doc_id"], bytes(r["bytes"])) for r in back), key=key) == sorted(((i, (t or "").encode()) for i, t in rows), key=key)
    wrong = spark.createDataFrame([(1, None, "a"), (2, [], "b"), (3, [65, None], "c"), (4, [-1], "d"), (5, [60000], "e"), (6, [39], "f")], "doc_id long, ids array<long>, bytes string")
    found = bpe.decode(wrong, RANKS, PATTERN)
    assert found.columns == ["doc_id", "ids", "bytes"]
    assert {r["doc_id"]: r["bytes"] and bytes(r["bytes"]) for r in found.collect()} == {1: None, 2: b"", 3: None, 4: None, 5: None, 6: library.decode_single_token_bytes(39)}
    assert bpe.decode(bpe.encode(frame(spark, []), RANKS, PATTERN), RANKS, PATTERN).collect() == []


def test_bpe_query(spark, library):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in queries.table(spark, SMALL, "documents").collect():
        ids = library.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids)).encode()), sha((r["text"] or "").encode())))
    assert sorted(map(tuple, queries.op12_byte_bpe(spark, SMALL).collect())) == sorted(want)


# Alignment


class Plain:
    """The definition, token by token."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(BYTE_LEVEL), sentencepiece.SentencePieceProcessor(model_file=PIECES)
        self.a.encode_special_tokens = True
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letters = {chr(b): b for b in printable}
        for b in range(256):
            if b not in printable:
                letters[chr(256 + len(letters) - len(printable))] = b
        self.letters = letters

    def bytes_a(self, i):
        return bytes(self.letters[c] for c in self.a.id_to_token(i)) if i != 50256 else b"<|endoftext|>"

    def bytes_b(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def groups(self, text):
        if not text:
            return []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        raw_a, raw_b = [self.bytes_a(i) for i in a], [self.bytes_b(i) for i in b]
        if b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            return []
        end_a, end_b = np.cumsum(list(map(len, raw_a))).tolist(), np.cumsum(list(map(len, raw_b))).tolist()
        cuts = sorted(set(end_a) & set(end_b))
        found = [([], []) for _ in cuts]
        for side, ids, ends in ((0, a, end_a), (1, b, end_b)):
            for i, e in zip(ids, ends):
                found[bisect.bisect_left(cuts, e)][side].append(i)
        return found

    def alignment(self, rows):
        every = [self.groups(t) for _, t in rows]
        links = [Counter((x, y) for a, b in g for x in a for y in b) for g in every]
        count = Counter(p for own in links for p in own)
        best = defaultdict(int)
        for (x, _), n in count.items():
            best[x] = max(best[x], n)
        for (i, _), g, own in zip(rows, every, links):
            shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
            yield (i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()), sum(n for (x, y), n in own.items() if count[x, y] == best[x]), sum(n * count[p] for p, n in own.items()), shown)


@pytest.fixture(scope="module")
def plain():
    return Plain()


def test_blocks_follow_the_definition(plain):
    own = align.Aligner(align.byte_level_side(BYTE_LEVEL), align.sentencepiece_side(PIECES))
    own.a.memo.room = 0

    @settings(max_examples=100, deadline=None)
    @given(st.lists(TEXTS, max_size=4))
    def follows(texts):
        rows = own.block(pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())).to_pylist()
        for text, r in zip(texts, rows):
            g = plain.groups(text)
            links = Counter(x * 32000 + y for a, b in g for x in a for y in b)
            assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(links.values()))
            assert r["pairs"] == sorted(links) and r["times"] == [links[p] for p in sorted(links)]

    follows()


def test_alignment(spark, plain, monkeypatch):
    monkeypatch.setattr(align, "POSTINGS", 50)  # many packed rows
    monkeypatch.setattr(align, "COUNTS", 40)  # many buckets
    rows = documents()
    found = align.alignment(frame(spark, rows), BYTE_LEVEL, PIECES)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, plain.alignment(rows)))
    assert align.alignment(frame(spark, []), BYTE_LEVEL, PIECES).collect() == []
    assert {tuple(r)[1:] for r in align.alignment(frame(spark, [(1, None), (2, "")]), BYTE_LEVEL, PIECES).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_one_pair_in_most_documents(spark, plain):
    rows = [(i, "the") for i in range(300)] + [(i, f"the {i} of") for i in range(300, 400)]
    found = align.alignment(frame(spark, rows), BYTE_LEVEL, PIECES)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, plain.alignment(rows)))


def test_large_groups(plain, monkeypatch):
    monkeypatch.setattr(align, "LARGE", 2)
    own = align.Aligner(align.byte_level_side(BYTE_LEVEL), align.sentencepiece_side(PIECES))
    texts = ["".join(random.Random(i).choices(ODD, k=80)) for i in range(30)] + ["=" * 1001, "0123456789" * 30]
    for text, r in zip(texts, own.block(pa.array(range(len(texts)), pa.int64()), pa.array(texts)).to_pylist()):
        links = Counter(x * 32000 + y for a, b in plain.groups(text) for x in a for y in b)
        assert dict(zip(r["pairs"], r["times"])) == links


def test_alignment_query(spark, plain):
    rows = [(r["doc_id"], r["text"]) for r in queries.table(spark, SMALL, "documents").collect()]
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in plain.alignment(rows)]
    assert sorted(map(tuple, queries.op13_alignment(spark, SMALL).collect())) == sorted(want)


# Whitening

VECTORS = "vec_id long, embedding array<float>, n string, component string, v int, deviation string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", 1, "z") for i, v in rows], VECTORS).repartition(3)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 9), st.integers(0, 2**31))
def test_jacobi(size, seed):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(size, size)) * 10.0 ** rng.integers(-4, 4, size)
    m = m @ m.T
    values, columns = whitening.jacobi(m)
    assert np.allclose(np.sort(values.astype(float)), np.linalg.eigvalsh(m), rtol=1e-9, atol=1e-13 * np.trace(m))
    assert np.allclose((columns.T @ columns).astype(float), np.eye(size), atol=1e-14)
    assert np.allclose((columns @ np.diag(values) @ columns.T).astype(float), m, atol=1e-13 * np.trace(m))


def test_jacobi_small_eigenvalues():
    """Graded matrices keep the small ones to full relative accuracy."""
    grade = 10.0 ** -np.arange(0, 16, 2)
    core = np.array([[1 / (1 + abs(i - j)) for j in range(8)] for i in range(8)])
    m = grade[:, None] * core * grade
    values = np.sort(whitening.jacobi(m)[0].astype(float))
    product = np.prod([float(x) for x in values])
    assert math.isclose(product, float(np.prod(grade**2)) * np.linalg.det(core), rel_tol=1e-9) and values[0] > 0


def brute(rows, components=32):
    kept = [(i, [math.floor(64.0 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept], object)
    n, sums = len(x), x.sum(axis=0)
    deviation = [int(((n * r - sums) ** 2).sum()) for r in x]
    centred = np.array([[float(Fraction(int(n * c - s), n)) for c, s in zip(r, sums)] for r in x])
    covariance = centred.T @ centred / n
    values, columns = np.linalg.eigh(covariance)
    order = [k for k in np.argsort(-values) if values[k] > 1e-10 * values.sum()][:components]
    return [i for i, _ in kept], n, deviation, centred, covariance, values[order], columns[:, order]


def check_whitening(spark, rows, components=32):
    found, fit = whitening.whiten(vectors(spark, rows), components=components)
    got = found.collect()
    ids, n, deviation, centred, covariance, values, columns = brute(rows, components)
    assert fit.n == n and np.allclose(fit.covariance, covariance, rtol=1e-12, atol=1e-12 * np.trace(covariance))
    assert sorted((repr(r["vec_id"]), r["deviation"]) for r in got) == sorted((repr(i), d) for i, d in zip(ids, deviation))
    assert np.allclose(fit.explained, values / np.trace(covariance), rtol=1e-6)
    w = np.array([r["whitened"] for r in got])
    assert w.shape == (n, len(values))
    centred_w = w - w.mean(axis=0)
    assert np.abs(centred_w.T @ centred_w / n - np.eye(w.shape[1])).max() < 1e-6
    assert whitening.identity_error(found, fit) < 1e-6
    want = sorted(map(tuple, np.abs(centred @ columns / np.sqrt(values)).tolist()))
    assert np.allclose(sorted(map(tuple, np.abs(w).tolist())), want, atol=1e-5)


def test_whitening(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 5)) * [3, 1, 0.5, 20, 2] + [0, 5, -100, 0, 1]
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (200, None), (201, [1.0, None, 1.0, 1.0, 1.0]), (202, [float("nan")] * 5), (203, [1.0, float("inf"), 0.0, 0.0, 0.0])]
    check_whitening(spark, rows)
    check_whitening(spark, rows, components=2)
    short, fit = whitening.whiten(vectors(spark, [*rows, (300, [1.0]), (301, [])]))
    assert fit.n == 122 and short.where("vec_id >= 300").count() == 0


def test_whitening_large_entries(spark):
    """Products beyond 2^53 are still exact, and a deviation beyond a long is null."""
    rng = np.random.default_rng(4)
    check_whitening(spark, [(i, (rng.normal(size=3) * [2e5, 1e5, 1e5]).tolist()) for i in range(20)])
    found, _ = whitening.whiten(vectors(spark, [(0, [3e7, 0.0]), (1, [-3e7, 1.0]), (2, [1.0, 2.0])]))
    assert {r["vec_id"] for r in found.where("deviation is null").collect()} == {0, 1}
    with pytest.raises(Exception, match="or more"):
        whitening.whiten(vectors(spark, [(0, [1e9]), (1, [2.0])]))


def test_whitening_without_variance(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(i, [0.5, 0.25]) for i in range(5)], [(1, None)], [(1, [])]):
        found, fit = whitening.whiten(vectors(spark, rows))
        assert fit is None and found.collect() == []
    found, fit = whitening.whiten(vectors(spark, [(1, [1.0, 7.0, 2.0]), (2, [3.0, 7.0, 4.0])]))
    assert len(fit.eigenvalues) == 1 and {abs(round(r["whitened"][0], 9)) for r in found.collect()} == {1.0}


def test_whitening_query(spark):
    found = queries.op11_whitening(spark, SMALL).toPandas()
    rows = [(r["vec_id"], r["embedding"]) for r in queries.table(spark, SMALL, "embeddings").collect()]
    ids, n, deviation, centred, covariance, values, columns = brute(rows)
    assert list(found.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(found) == 32 * n and set(found["n"]) == {n} and found["identity_error"].nunique() == 1 and found["identity_error"][0] < 1e-9
    assert dict(zip(found["vec_id"], found["deviation"])) == dict(zip(ids, deviation))
    assert np.allclose(found.groupby("component")["explained"].first(), values / np.trace(covariance), rtol=1e-9)
    wide = found.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    assert np.allclose(np.abs(wide), np.abs(centred @ columns / np.sqrt(values)), atol=1e-6)
