"""Alignment of two tokenizers: which tokens of one meet which of the other, and in how many documents.

Both encode space and text: A a byte-level BPE of the tokenizers library, B a sentencepiece model (which adds the
space). Byte offsets at which tokens of both end cut a document into groups; every A token of a group is linked
with every B token of it. An id pair's count is the number of documents that hold it linked.

One pass encodes and aligns, and writes a row per document with its distinct pairs and how often each is linked.
Then a postings cogroup keyed by A's ids:

* counts of pairs are summed from partial sums of the tasks;
* postings (document, pair, times) are dealt to buckets of A ids, packed in arrays of one task's documents and one
  bucket, so the shuffle moves packed columns and no row for each posting;
* in a bucket the counts come first and then the postings, as one sorted stream that Spark spills. The counts of a bucket are held,
  so the highest of each A id is known there; postings only pass by, each array giving sums for its documents;
* these contributions, at most one for a document and bucket, are summed by document and joined back.

There are as many buckets as the counts need (about ``COUNTS`` each; one A id has at most as many as B has ids), so contributions
grow with the documents. A bucket is cut into slices of documents by the postings it has, so one with an A id that a third of
all postings have gets more slices; each has the bucket's counts. The totals by A id, at most one for each of A's ids, are all that
comes to the driver.

Defined cases: a row is a document, so rows with equal or null ids and equal texts all count; texts that are null, empty,
or that either tokenizer does not give back byte for byte (for B, texts with U+2581) have no tokens: zeros and
empty groups; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._segments import CUTS, Memo, byte_set, ends_in_space, of_texts, piece_edges, segments, slices, token_edges
from ._stage import Workspace
from ._worker import held

#: Postings that a task packs at a time, counts meant for a bucket, the least number of buckets, and the most postings meant for a slice.
POSTINGS = 1 << 20
COUNTS = 1 << 20
BUCKETS = 16
SLICE = 1 << 23
#: Groups with more links than this are counted by their distinct ids.
LARGE = 4096
#: Stretches encoded in one call.
TOGETHER = 512
_SPACE = "▁"
#: What each side's memo may hold, and the bytes of texts that are aligned at a time.
MEMO_BYTES = 64 << 20
SLICE_BYTES = 1 << 20


def _byte_of_letter() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, others are counted from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


def _word(s: bytes) -> bool:
    """At most one space, then no white space at either end and no line feed."""
    rest = s[1:] if s[0] == 0x20 else s
    return rest.isalnum() or not ends_in_space(s) and not CUTS[s[1] if s[0] == 0x20 else s[0]] and b"\n" not in s


class Side:
    """One tokenizer: ids of many stretches at once, and the number of bytes of each id.

    ``together`` encodes texts that begin with a space; ``edges`` finds the places that no token crosses, among
    them those between a line feed and what is no white space (None: texts stay whole).
    """

    def __init__(self, tokens: list[bytes], together: Callable[[list[str]], list[list[int]]], edges: Callable[[np.ndarray], np.ndarray] | None) -> None:
        self.tokens, self.together = tokens, together
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.width = "<u2" if len(tokens) <= 1 << 16 else "<u4"
        self.memo = Memo(self._learn, self.width, MEMO_BYTES)
        feeds = [i for i, t in enumerate(tokens) if t == b"\n"]
        self.edges, self.feed = (edges, feeds[0]) if len(feeds) == 1 else (None, -1)

    def _learn(self, new: list[bytes]) -> list[bytes]:
        """The ids of each stretch; none if they do not give it back.

        Plain words are encoded many to a call, a line feed between them, and parted there.
        """
        out: dict[bytes, bytes] = {}
        each = int(self.width[-1])
        plain = [s for s in new if _word(s)] if self.edges else []
        parts = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        texts = [b"".join([b" \n", b"\n".join(p)]) for p in parts]
        for part, text, ids in zip(parts, texts, self.together([t.decode() for t in texts])):
            if b"".join(map(self.tokens.__getitem__, ids)) != text:
                continue
            ids = np.array(ids, np.int64)
            feed = np.flatnonzero(ids == self.feed)
            if len(feed) == len(part):
                raw, at = ids.astype(self.width).tobytes(), (np.append(feed, len(ids)) * each).tolist()
                out.update((s, raw[a + each : b]) for s, a, b in zip(part, at, at[1:]))
        alone = [s for s in new if s not in out]
        # What begins with white space follows a short word, anything else a line feed; their ids are taken off again.
        before = [b"" if self.edges is None else b" a" if CUTS[s[0]] else b" \n" for s in alone]
        for s, b, ids in zip(alone, before, self.together([(b + s).decode() for b, s in zip(before, alone)])):
            raw = [self.tokens[i] for i in ids]
            skip = next((k for k in range(len(raw) + 1) if b"".join(raw[:k]) == b), 0)
            out[s] = np.array(ids[skip:], self.width).tobytes() if b"".join(raw[skip:]) == s else b""
        return [out[s] for s in new]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids one after another, where those of each text begin, and which texts they give back."""
        flat, first = segments(texts, self.edges)
        if not len(flat):
            return np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64), np.zeros(len(texts), bool)
        ids, size = self.memo.encode(flat.dictionary_encode())
        lost = np.concatenate([[0], np.cumsum(size == 0)])[first]
        return ids.astype(np.int64), of_texts(size, first), (np.diff(lost) == 0) & (np.diff(first) > 0)


def byte_level_side(path: str) -> Side:
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    letters = _byte_of_letter()
    names = [own.id_to_token(i) or "" for i in range(own.get_vocab_size())]
    tokens = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in names]
    kind = own.pre_tokenizer.__getstate__() if own.pre_tokenizer else b""
    # The pattern that the library itself brings parts words before white space; other splitters get whole texts.
    usual = b'"ByteLevel"' in kind and b'"use_regex":true' in kind and b"Sequence" not in kind and own.normalizer is None
    return Side(tokens, lambda texts: [e.ids for e in own.encode_batch_fast(texts, add_special_tokens=False)], piece_edges if usual else None)


def sentencepiece_side(path: str) -> Side:
    """Encodes texts that begin with a space, which the model itself puts before what follows it."""
    from sentencepiece import SentencePieceProcessor

    own = SentencePieceProcessor(model_file=path)
    n = own.get_piece_size()
    names = [own.id_to_piece(i) for i in range(n)]
    tokens = [bytes([int(t[3:5], 16)]) if own.is_byte(i) else t.replace(_SPACE, " ").encode() for i, t in enumerate(names)]
    # Merges join neighbours into tokens: what meets in no token is never joined.
    inner = "".join(t.lstrip(_SPACE) for i, t in enumerate(names) if not own.is_byte(i))
    safe = bytes(ord(c) for c in " \t\n" if (_SPACE if c == " " else c) not in inner)
    meet = np.zeros((256, 256), bool)
    for t in tokens:
        meet[list(t[:-1]), list(t[1:])] = True
    cuts = byte_set(safe)
    return Side(tokens, lambda texts: own.encode([t[1:] for t in texts], num_threads=1), (lambda data: token_edges(data, cuts, meet)) if len(safe) == 3 else None)


@dataclass
class Aligner:
    a: Side
    b: Side

    def __post_init__(self) -> None:
        # How an id is written: behind it a comma, or what ends its side of the group.
        self.table = np.array([f"{i}{end}" for n, ends in ((len(self.a.size), ",|"), (len(self.b.size), ",;")) for i in range(n) for end in ends], "S")
        self.chars = self.table.view(np.uint8).reshape(len(self.table), -1)
        self.written = np.fromiter(map(len, self.table.tolist()), np.int64, len(self.table))

    def block(self, doc_ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        """The rows of some documents; see ``_SCHEMA``."""
        texts = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pc.fill_null(texts.cast(pa.large_string()), ""), pa.scalar("", pa.large_string()))
        a, a_at, good = self.a.encode(texts)
        b, b_at, also = self.b.encode(texts)
        good = good & also & (pc.binary_length(texts).to_numpy() > 1)
        n = len(texts)
        if not good.all():
            a, a_at = a[np.repeat(good, np.diff(a_at))], np.concatenate([[0], np.cumsum(np.diff(a_at) * good)])
            b, b_at = b[np.repeat(good, np.diff(b_at))], np.concatenate([[0], np.cumsum(np.diff(b_at) * good)])
        end_a, end_b = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        mark = np.zeros((2, int(end_a[-1]) + 1 if len(a) else 1), bool)
        mark[0, end_a] = mark[1, end_b] = True
        last_a, last_b = mark[1, end_a], mark[0, end_b]
        in_a, in_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        past_a, past_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        na, nb = np.diff(past_a, prepend=0), np.diff(past_b, prepend=0)
        group_at = np.concatenate([[0], np.cumsum(last_a)])[a_at]
        links = np.concatenate([[0], np.cumsum(na * nb)])[group_at]
        pairs, times, pair_at = self._pairs(a, b, in_a, na, nb, past_a, past_b, group_at)
        return pa.record_batch(
            [
                doc_ids, *(pa.array(np.diff(x), pa.int64()) for x in (a_at, b_at, group_at, links)),
                self._groups(a, b, in_a, in_b, last_a, last_b, past_a, past_b, a_at + b_at, n),
                pa.ListArray.from_arrays(pa.array(pair_at, pa.int32()), pa.array(pairs)), pa.ListArray.from_arrays(pa.array(pair_at, pa.int32()), pa.array(times, pa.int32())),
            ],
            schema=_SCHEMA,
        )

    def _pairs(self, a, b, in_a, na, nb, past_a, past_b, group_at):  # noqa: ANN001, ANN202
        """Distinct pairs of each document, ascending, their links, and where each document's begin."""
        across, size = len(self.b.size), len(self.a.size) * len(self.b.size)
        doc = np.repeat(np.arange(len(group_at) - 1), np.diff(group_at))  # of each group
        large = na * nb > LARGE
        each = np.where(large, 0, nb)[in_a]
        end = np.cumsum(each)
        left = np.repeat(np.arange(len(a)), each)
        right = np.arange(len(left)) - np.repeat(end - each - (past_b - nb)[in_a], each)
        keys, weights = [doc[in_a[left]] * size + a[left] * across + b[right]], [np.ones(len(left), np.int64)]
        for g in np.flatnonzero(large).tolist():
            ids, n = np.unique(a[past_a[g] - na[g] : past_a[g]], return_counts=True)
            other, m = np.unique(b[past_b[g] - nb[g] : past_b[g]], return_counts=True)
            keys.append((doc[g] * size + ids[:, None] * across + other).ravel())
            weights.append((n[:, None] * m).ravel())
        if len(keys) == 1:
            key = np.sort(keys[0])
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
            times = np.diff(np.append(new, len(key)))
        else:
            key, weight = np.concatenate(keys), np.concatenate(weights)
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            times = np.add.reduceat(weight[order], new)
        key = key[new]
        return key % size, times, np.searchsorted(key, np.arange(len(group_at)) * size)

    def _groups(self, a, b, in_a, in_b, last_a, last_b, past_a, past_b, at, n):  # noqa: ANN001, ANN202
        """The groups as text: A's ids and B's of each, in order."""
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + np.concatenate([[0], past_b])[in_a]] = 2 * a + last_a
        code[np.arange(len(b)) + past_a[in_b]] = 2 * (len(self.a.size) + b) + last_b
        size = self.written[code]
        size_at = np.concatenate([[0], np.cumsum(size)])[at]
        out = []
        for d in range(0, n, 64):  # a few documents at a time, as the table's rows are padded
            to = min(n, d + 64)
            cells = self.chars[code[at[d] : at[to]]].ravel()
            raw = cells[cells != 0].tobytes()
            edge = (size_at[d : to + 1] - size_at[d]).tolist()
            out += [raw[s : max(s, e - 1)] for s, e in zip(edge, edge[1:])]
        return pa.array(out, pa.binary()).cast(pa.string())


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])


def aligner(byte_level: str, pieces: str) -> Aligner:
    return held("aligner", (byte_level, pieces), lambda: Aligner(byte_level_side(byte_level), sentencepiece_side(pieces)))


def aligned(docs: DataFrame, byte_level: str, pieces: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``), and its distinct
    pairs (A id times the size of B, plus B id) with their links in pairs and times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(byte_level, pieces)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                yield own.block(part.column("doc_id"), part.column("text"))

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"
    )


#: What is dealt to cells (slices of buckets). Counts (kind 0): pairs and their numbers. Postings (kind 1): documents, how many postings each has, and these.
_DEALT = "cell int, kind int, pairs array<long>, numbers array<long>, docs array<long>, runs array<int>"
_DEALT_SCHEMA = pa.schema([("cell", pa.int32()), ("kind", pa.int32()), ("pairs", pa.list_(pa.int64())), ("numbers", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64())), ("runs", pa.list_(pa.int32()))])


@dataclass
class Deal:
    """bucket: of each A id. first: the first cell of each bucket. slices: how many it has."""

    bucket: np.ndarray
    first: np.ndarray
    slices: np.ndarray

    @classmethod
    def of(cls, ids: int, postings: dict[int, int], distinct: int, tasks: int) -> Deal:
        """postings: how many each A id has. distinct: how many pairs there are."""
        buckets = max(BUCKETS, -(-distinct // COUNTS))
        mixed = np.arange(ids, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        load = np.bincount(bucket[np.fromiter(postings.keys(), np.int64, len(postings))], np.fromiter(postings.values(), np.float64, len(postings)), buckets)
        each = max(1.0, min(SLICE, load.sum() / max(tasks, buckets)))
        slices = np.maximum(1, np.ceil(load / each)).astype(np.int64)
        return cls(bucket, np.cumsum(slices) - slices, slices)

    def cells(self) -> int:
        return int(self.slices.sum())

    def postings(self, a: np.ndarray, docs: np.ndarray) -> np.ndarray:
        of = self.bucket[a]
        return self.first[of] + docs % self.slices[of]

    def counts(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the counts, and to which cell: each to all of its bucket."""
        of = self.bucket[a]
        each = self.slices[of]
        which = np.repeat(np.arange(len(a)), each)
        return which, self.first[of][which] + np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each)


def _packed(kind: int, cell: np.ndarray, pairs: np.ndarray, numbers: np.ndarray, docs: np.ndarray | None) -> pa.RecordBatch:
    """One row for each cell."""
    order = np.argsort(cell, kind="stable")
    cell, pairs, numbers = cell[order], pairs[order], numbers[order]
    new = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    at = pa.array(np.append(new, len(cell)), pa.int32())
    if docs is None:
        none = pa.array(np.zeros(len(new) + 1, np.int32))
        who, runs = pa.ListArray.from_arrays(none, pa.array([], pa.int64())), pa.ListArray.from_arrays(none, pa.array([], pa.int32()))
    else:
        docs = docs[order]
        turn = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (cell[1:] != cell[:-1])]))
        of = pa.array(np.append(np.searchsorted(turn, new), len(turn)), pa.int32())
        who, runs = pa.ListArray.from_arrays(of, pa.array(docs[turn])), pa.ListArray.from_arrays(of, pa.array(np.diff(np.append(turn, len(docs))), pa.int32()))
    return pa.record_batch(
        [pa.array(cell[new], pa.int32()), pa.array(np.full(len(new), kind), pa.int32()), pa.ListArray.from_arrays(at, pa.array(pairs, pa.int64())), pa.ListArray.from_arrays(at, pa.array(numbers, pa.int64())), who, runs],
        schema=_DEALT_SCHEMA,
    )


def _deal_postings(across: int, deal: Deal, postings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, room = [], 0

        def flush() -> pa.RecordBatch:
            pairs, times = (np.concatenate([b.column(c).flatten().to_numpy() for b in kept]) for c in ("pairs", "times"))
            docs = np.concatenate([np.repeat(b.column("key").to_numpy(), b.column("n").to_numpy()) for b in kept])
            return _packed(1, deal.postings(pairs // across, docs), pairs, times, docs)

        for batch in batches:
            size = np.cumsum(batch.column("n").to_numpy().astype(np.int64))
            row = 0
            while row < len(batch):
                before = size[row - 1] if row else 0
                stop = max(row + 1, int(np.searchsorted(size, before + postings - room, "right")))
                kept.append(batch.slice(row, stop - row))
                room += int(size[stop - 1] - before)
                row = stop
                if room >= postings or row < len(batch):
                    yield flush()
                    kept, room = [], 0
        if room:
            yield flush()

    return run


def _deal_counts(across: int, deal: Deal):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, n = batch.column("pair").to_numpy(), batch.column("n").to_numpy()
            # Some counts at a time, as a bucket may have many slices.
            step = max(1, POSTINGS // int(deal.slices.max()))
            for i in range(0, len(pairs), step):
                which, cell = deal.counts(pairs[i : i + step] // across)
                yield _packed(0, cell, pairs[i : i + step][which], n[i : i + step][which], None)

    return run


def _meet(across: int):
    """Sums for the documents of each packed posting row, from a stream in which a cell's counts precede its postings."""
    schema = pa.schema([("key", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts, pairs = None, [], None
        n = best = np.empty(0, np.int64)
        for batch in batches:
            for row in range(len(batch)):
                of, kind = batch.column("cell")[row].as_py(), batch.column("kind")[row].as_py()
                own, numbers = (batch.column(c)[row].values.to_numpy() for c in ("pairs", "numbers"))
                if of != cell:
                    cell, parts, pairs = of, [], None
                if kind == 0:
                    parts.append((own, numbers))
                    continue
                if pairs is None:
                    pairs, n = (np.concatenate(x) for x in zip(*parts))
                    order = np.argsort(pairs)
                    pairs, n, parts = pairs[order], n[order], []
                    new = np.flatnonzero(np.concatenate([[True], pairs[1:] // across != pairs[:-1] // across]))
                    best = (n == np.repeat(np.maximum.reduceat(n, new), np.diff(np.append(new, len(n))))).astype(np.int64)
                at = np.searchsorted(pairs, own)
                runs = batch.column("runs")[row].values.to_numpy()
                begin = np.cumsum(runs) - runs
                yield pa.record_batch([batch.column("docs")[row].values, pa.array(np.add.reduceat(best[at] * numbers, begin)), pa.array(np.add.reduceat(n[at] * numbers, begin))], schema=schema)

    return run


def alignment(docs: DataFrame, byte_level: str, pieces: str, doc_id: str = "doc_id", text: str = "text", show: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair's count is the highest of
    its A id), count_sum (of counts over links) and groups; ``show`` makes of the groups what is kept of them
    (a digest, say) where there are tokens."""
    spark = docs.sparkSession
    work = Workspace(spark, "align")
    own = aligner(byte_level, pieces)
    ids, across = len(own.a.size), len(own.b.size)
    groups = F.when(F.col("n_a") > 0, (show or (lambda g: g))(F.col("groups"))).otherwise("")
    found = aligned(docs, byte_level, pieces, doc_id, text)
    rows = work.save(found.select(F.monotonically_increasing_id().alias("key"), "doc_id", "n_a", "n_b", "n_groups", "n_links", groups.alias("groups"), F.size("pairs").alias("n"), "pairs", "times"), "rows", compression="zstd")
    counts = work.save(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "counts")
    totals = counts.groupBy(F.floor(F.col("pair") / across).cast("int").alias("a")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("pairs")).collect()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    deal = Deal.of(ids, {r["a"]: r["n"] for r in totals}, sum(r["pairs"] for r in totals), 4 * parts)
    dealt = rows.select("key", "n", "pairs", "times").where("n > 0").mapInArrow(_deal_postings(across, deal, POSTINGS), _DEALT)
    dealt = counts.mapInArrow(_deal_counts(across, deal), _DEALT).unionByName(dealt)
    met = dealt.repartition(max(parts, deal.cells() // 4), "cell").sortWithinPartitions("cell", "kind").mapInArrow(_meet(across), "key long, n_best long, count_sum long")
    sums = met.groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    whole = rows.select("key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups").join(sums, "key", "left")
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")), "groups")
