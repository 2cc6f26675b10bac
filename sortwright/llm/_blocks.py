"""Word boundaries and word-window hashes of many texts at once, in numpy.

Texts are handled in blocks of about a megabyte, read straight from Arrow
buffers, so memory follows the block (or the longest single text), not the batch.

A word has 128 bits, in two lanes. Words of at most 15 bytes are numbered one to one: their bytes and
length go through a permutation of the 128-bit integers, so no two of them agree in both lanes.
Longer ones have 128 bits of blake2b, which nobody can make to agree. Windows mix the lanes of
their words separately.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BLOCK_BYTES = 1 << 20

#: ASCII white space: 0x20 and 0x09-0x0D. Everything else is part of a word.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: A-Z to a-z; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Longest word whose bytes fit the two lanes beside its length.
SHORT = 15
_ROUNDS = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0x27D4EB2F165667C5))
_STEP = ((U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB)), (U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3)))


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers with good avalanche; works in place."""
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def word_lanes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both lanes of the words at the given places of a byte array."""
    size = ends - starts
    at = np.arange(16)
    bytes_ = np.concatenate([data, np.zeros(16, np.uint8)])[starts[:, None] + at]
    bytes_ *= at < np.minimum(size, SHORT)[:, None]
    bytes_[:, SHORT] = np.minimum(size, SHORT + 1)
    halves = bytes_.view("<u8")
    left, right = halves[:, 0].astype(U), halves[:, 1].astype(U)
    long = np.flatnonzero(size > SHORT)
    if len(long):
        raw = data.tobytes()
        digests = b"".join([hashlib.blake2b(raw[s:e], digest_size=16).digest() for s, e in zip(starts[long].tolist(), ends[long].tolist())])
        both = np.frombuffer(digests, "<u8").reshape(-1, 2)
        left[long], right[long] = both[:, 0], both[:, 1]
    for key in _ROUNDS:
        left, right = right, left ^ mix(right ^ key)
    return left, right


@dataclass
class Block:
    """Consecutive rows of a batch: ``first[d]:first[d + 1]`` are the words of its d-th text."""

    row: int
    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    lanes: tuple[np.ndarray, np.ndarray] | None = field(default=None)

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def text(self, d: int) -> bytes:
        return self.data[self.bounds[d] : self.bounds[d + 1]].tobytes()

    def words(self, lane: int) -> np.ndarray:
        if self.lanes is None:
            self.lanes = word_lanes(self.data, self.starts, self.ends)
        return self.lanes[lane]

    def folded(self) -> np.ndarray:
        """One 64-bit hash of each word, from both lanes."""
        return mix(self.words(0) + mix(self.words(1).copy()))

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.first))


def windows(h: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """The hash of each n consecutive words, across texts too: see ``inside``."""
    if len(h) < n:
        return np.empty(0, U)
    a, b = _STEP[lane]
    step = 1
    while 2 * step <= n:
        h = mix(h[:-step] * a + (h[step:] ^ b))
        step *= 2
    return mix(h[: len(h) - (n - step)] * b + (h[n - step :] ^ a)) if step < n else h


def inside(owner: np.ndarray, n: int) -> np.ndarray:
    """Which windows of n words lie within one text."""
    return owner[: max(0, len(owner) - n + 1)] == owner[n - 1 :]


def sliding_min(g: np.ndarray, n: int) -> np.ndarray:
    step = 1
    while 2 * step <= n:
        g = np.minimum(g[:-step], g[step:])
        step *= 2
    return np.minimum(g[: len(g) - (n - step)], g[n - step :]) if step < n else g


def blocks(texts: pa.Array, keep: np.ndarray = NOT_SPACE, lower: bool = False, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks over a string column; a null text is an empty one."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    _, offsets, values = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    values = np.frombuffer(values, np.uint8) if values is not None and values.size else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        data = values[offsets[row] : offsets[end]]
        if lower:
            data = LOWER[data]
        bounds = offsets[row : end + 1] - offsets[row]
        within = keep[data]
        edge = within.copy()
        edge[1:] &= ~within[:-1]
        at = bounds[:-1][bounds[:-1] < len(data)]
        edge[at] = within[at]
        starts = np.flatnonzero(edge)
        edge = within.copy()
        edge[:-1] &= ~within[1:]
        at = bounds[1:][bounds[1:] > 0] - 1
        edge[at] = within[at]
        ends = np.flatnonzero(edge) + 1
        yield Block(row, data, bounds, starts, ends, np.searchsorted(starts, bounds))
        row = end


def lists(parts: list[np.ndarray], kind: pa.DataType = pa.int64()) -> pa.Array:
    """A list column from one array per row."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64) if flat.dtype == U else flat).cast(kind))


def of_list(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and 64-bit values of a list column without null entries; a null list is empty."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    offsets = np.zeros(len(column) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    return offsets, np.asarray(column.flatten()).astype(np.int64, copy=False).view(U)
