"""Byte-level BPE by a file of ranks: encoding in length-bucketed matrices, and decoding.

A text is cut into pieces by a pattern. A piece that is a token has its rank as id; any other starts as
its bytes' tokens. Pieces of about one length are the rows of a padded matrix: in each round every row
merges its leftmost pair of the least rank, the columns behind it move up by one, and rows without a
mergeable pair leave. Ranks of pairs come from a hash table in numpy (open addressing, linear probing) and are kept beside the
matrix, so a round looks up only the two pairs beside each merge. Pieces longer than ``WIDEST`` bytes would need as many
rounds as bytes: they merge the same pairs in the same order from a heap.

Rows are independent and nothing shuffles. Texts go in blocks of about 1 MB, each distinct stretch
between places that no piece crosses is encoded once, and a memo of at most 48 MB keeps stretches between blocks.

Defined cases: a null or empty text has no ids and decodes to no bytes; rows with repeated or null ids and
equal texts are rows like others; other columns are ignored by ``encode`` and kept by ``decode``, whose result
replaces a column of its name; null ids, and ids with an entry that is null or no token, decode to null; empty tables give empty results.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from ._segments import MEMO_BYTES, PIECES, Memo, of_texts, piece_edges, segments, slices
from ._worker import held

#: Longest piece that is merged in a matrix, and cells of one matrix.
WIDEST = 2048
CELLS = 1 << 21
#: Text that is encoded at a time.
SLICE_BYTES = 1 << 20
#: The rank of a pair that does not merge.
NONE = np.int32(0x7FFFFFFF)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Ranks of pairs of ids. Half the places at most are taken; a place holds a pair's key and rank."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(rank) + 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at, left_over = self._home(key), np.arange(len(key))
        while len(left_over):
            free = left_over[self.keys[at[left_over]] == -1]
            self.keys[at[free]] = key[free]  # of several that want one place the last has it
            self.ranks[at[free]] = rank[free]
            left_over = left_over[self.keys[at[left_over]] != key[left_over]]
            at[left_over] = (at[left_over] + 1) & (len(self.keys) - 1)

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``NONE`` where there is none; negative ids are in no pair."""
        key = left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)
        at = self._home(key)
        there = self.keys[at]
        found = np.where(there == key, self.ranks[at], NONE)
        open_ = np.flatnonzero((there != key) & (there != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            there = self.keys[at[open_]]
            hit = there == key[open_]
            found[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        return found


class Codec:
    """One per Python worker; see ``codec``."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = MEMO_BYTES, widest: int = WIDEST) -> None:
        self.ranks, self.pattern, self.widest = ranks, regex.compile(pattern), widest
        top = max(ranks.values()) + 1
        self.width = "<u2" if top <= 1 << 16 else "<u4"
        self.cuts = pattern == PIECES
        self.alone = [int(r).to_bytes(int(self.width[-1]), "little") for r in range(top)]
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(rank, np.int32))
        tokens = [b""] * top
        for token, r in ranks.items():
            tokens[r] = token
        self.size = np.fromiter(map(len, tokens), np.int64, top)
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.memo = Memo(self._learn, self.width, memo)

    def matrix(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as bytes; all pieces are non-empty and of at most ``widest`` bytes."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n, w = len(pieces), int(lengths.max())
        column = np.arange(w)
        inside = column < lengths[:, None]
        ids = np.full((n, w), -1, np.int32)
        ids[inside] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.full((n, w), NONE, np.int32)  # of the pair that begins in a column
        pair = np.flatnonzero(inside[:, 1:].ravel())
        row, at = pair // max(w - 1, 1), pair % max(w - 1, 1)
        rank[row, at] = self.pairs.find(ids[row, at], ids[row, at + 1])
        out, each = [b""] * n, int(self.width[-1])
        where = np.arange(n)
        while len(where):
            best = rank.argmin(axis=1)  # the first of equal ones
            least = rank[np.arange(len(where)), best]
            done = least == NONE
            if done.any():
                left, full = ids[done], each * ids.shape[1]
                raw, size = left.astype(self.width).tobytes(), each * (left >= 0).sum(axis=1)
                for k, (i, s) in enumerate(zip(where[done].tolist(), size.tolist())):
                    out[i] = raw[k * full : k * full + s]
                go = ~done
                where, ids, rank, best, least = where[go], ids[go], rank[go], best[go], least[go]
                if not len(where):
                    break
            # The merged token takes the pair's first column; what stands behind its second moves up.
            rows, width = np.arange(len(where)), ids.shape[1] - 1
            column = np.arange(width)
            move = column + (column > best[:, None])
            ids = np.take_along_axis(ids, move, 1)
            rank = np.take_along_axis(rank, move, 1)
            ids[rows, best] = least
            after = np.minimum(best + 1, width - 1)
            rank[rows, best] = np.where(best + 1 < width, self.pairs.find(least, np.where(best + 1 < width, ids[rows, after], -1)), NONE)
            some = np.flatnonzero(best > 0)
            before = best[some] - 1
            rank[some, before] = self.pairs.find(ids[some, before], least[some])
        return out

    def heaped(self, piece: bytes) -> bytes:
        """The ids of one long piece, as bytes, by the same merges in the same order."""
        ids = self.single[np.frombuffer(piece, np.uint8)]
        first = self.pairs.find(ids[:-1], ids[1:])
        token = ids.tolist()
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = [*first.tolist(), int(NONE)]
        heap = [(r, i) for i, r in enumerate(rank) if r != NONE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def of(i: int) -> int:
            j = after[i]
            if j >= n:
                return int(NONE)
            key = (token[i], token[j])
            if key not in known:
                known[key] = int(self.pairs.find(np.array(key[:1]), np.array(key[1:]))[0])
            return known[key]

        while heap:
            r, i = heapq.heappop(heap)
            if rank[i] != r:
                continue
            gone = after[i]
            token[i], rank[gone], after[i] = r, -1, after[gone]
            if after[i] < n:
                before[after[i]] = i
            for k in (i, before[i]):
                if k >= 0:
                    rank[k] = of(k)
                    if rank[k] != NONE:
                        heapq.heappush(heap, (rank[k], k))
        return np.array([t for t, r in zip(token, rank) if r != -1], self.width).tobytes()

    def merged(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        """The ids of the pieces, as bytes."""
        found: dict[bytes, bytes] = {}
        buckets: dict[int, list[bytes]] = {}
        for p in pieces:
            whole = self.ranks.get(p)
            if whole is not None:
                found[p] = self.alone[whole]
            elif len(p) > self.widest:
                found[p] = self.heaped(p)
            else:
                # Two widths to an octave, so at most a third of a bucket is padding.
                octave = 1 << (len(p) - 1).bit_length()
                buckets.setdefault(3 * octave // 4 if 4 * len(p) <= 3 * octave else octave, []).append(p)
        for width, own in buckets.items():
            step = max(1, CELLS // width)
            for i in range(0, len(own), step):
                found.update(zip(own[i : i + step], self.matrix(own[i : i + step])))
        return found

    def _learn(self, new: list[bytes]) -> list[bytes]:
        cut = {s: [*map(str.encode, self.pattern.findall(s.decode()))] for s in new if not (self.cuts and (s[1:] if s[0] == 0x20 else s).isalpha())}
        ids = self.merged(set(new).difference(cut).union(chain.from_iterable(cut.values())))
        return [b"".join(map(ids.__getitem__, cut[s])) if s in cut else ids[s] for s in new]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where those of each text begin."""
        flat, first = segments(texts, piece_edges if self.cuts else None)
        if not len(flat):
            return np.empty(0, self.width), np.zeros(len(texts) + 1, np.int64)
        ids, size = self.memo.encode(flat.dictionary_encode())
        return ids, of_texts(size, first)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of valid ids one after another, and the end of each id's."""
        size = self.size[ids]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        return self.bytes[np.repeat(self.begin[ids] - (end - size), size) + np.arange(total)], end


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def codec(path: str, pattern: str) -> Codec:
    return held("bpe", (path, pattern), lambda: Codec(load_ranks(path), pattern))


def encode(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id and ids, by the file of ranks at a path that every executor has."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                ids, at = own.encode(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.record_batch([part.column("doc_id"), lists], names=["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def _bytes_of(own: Codec, column: pa.Array) -> pa.Array:
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    flat = column.flatten()
    ids = pc.fill_null(flat, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    wrong = (ids < 0) | (ids >= len(own.size))
    wrong |= own.size[np.where(wrong, 0, ids)] == 0
    raw, end = own.decode(np.where(wrong, 0, ids))
    null = np.asarray(pc.is_null(column))
    if wrong.any():
        null = null | (np.diff(np.concatenate([[0], np.cumsum(wrong)])[at]) > 0)
    edges = np.concatenate([[0], end])[at]
    out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(raw)])
    return pc.if_else(pa.array(null), pa.scalar(None, pa.large_binary()), out).cast(pa.binary())


def decode(tokens: DataFrame, ranks: str, pattern: str, ids: str = "ids", result: str = "bytes", rows: int = 256) -> DataFrame:
    """The rows with the bytes of their ids in column ``result``; ``rows`` are decoded at a time."""
    ship(tokens.sparkSession)
    tokens = tokens.drop(result) if result in tokens.columns and result != ids else tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in batches:
            for i in range(0, len(batch), rows):
                part = batch.slice(i, rows)
                yield pa.record_batch([*part.columns, _bytes_of(own, part.column(ids).cast(pa.list_(pa.int64())))], names=[*part.schema.names, result])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields)
    return tokens.mapInArrow(run, f"{kept}, `{result}` binary")
