"""Texts cut into short stretches that a tokenizer encodes independently, and a memo of their ids.

A cut lies where no token of the vocabulary can reach across, for example before white space that follows a word. So a
text's ids are those of its stretches one after another, each distinct stretch of a block is encoded once, and most
are in the memo already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._blocks import NOT_SPACE

SLICE_BYTES = 2 << 20
MEMO_BYTES = 48 << 20

#: The second and third bytes of white space beyond ASCII, after the first (Unicode White_Space, in UTF-8).
WIDE_SPACES = {0xC2: (b"\x85", b"\xa0"), 0xE1: (b"\x9a\x80",), 0xE2: (*(b"\x80" + bytes([x]) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), b"\x81\x9f"), 0xE3: (b"\x80\x80",)}
_WIDE = tuple(bytes([first]) + rest for first, more in WIDE_SPACES.items() for rest in more)


def byte_set(characters: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(characters)] = True
    return found


#: All ASCII white space.
CUTS = ~NOT_SPACE


def ends_in_space(raw: bytes) -> bool:
    return not NOT_SPACE[raw[-1]] or raw.endswith(_WIDE)


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of a batch with about ``size`` bytes in one column, or one longer text."""
    end = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < len(batch):
        stop = max(row + 1, int(np.searchsorted(end, (end[row - 1] if row else 0) + size, "right")))
        yield batch.slice(row, stop - row)
        row = stop


def after_word(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Those of the places before a white-space byte at which the character before is no white space."""
    at = at[NOT_SPACE[data[at - 1]]]
    wide = at[np.isin(data[at - 1], [w[-1] for w in _WIDE])]
    odd = [i for i in wide.tolist() if data[max(0, i - 3) : i].tobytes().endswith(_WIDE)]
    return np.setdiff1d(at, np.array(odd, at.dtype), assume_unique=True) if odd else at


#: 1 for ASCII letters, 2 for ASCII digits, 3 for other ASCII, 0 for the rest.
_KIND = np.array([0 if b > 127 else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256)], np.uint8)


def _turns(data: np.ndarray) -> np.ndarray:
    """Whether an ASCII letter or digit stands before a place and another kind of ASCII behind."""
    kind = _KIND[data]
    return (kind[1:] != kind[:-1]) & (kind[1:] > 0) & ((kind[:-1] == 1) | (kind[:-1] == 2))


def piece_edges(data: np.ndarray) -> np.ndarray:
    """Places that no piece of the pattern below crosses."""
    turn = _turns(data)
    space = CUTS[data[1:]] & ~turn
    return np.concatenate([np.flatnonzero(turn) + 1, after_word(data, np.flatnonzero(space) + 1)])


def token_edges(data: np.ndarray, cuts: np.ndarray, meet: np.ndarray) -> np.ndarray:
    """Places before the white space of ``cuts``, and where kinds change between two bytes that meet in no token."""
    turn = _turns(data) & ~meet[data[:-1], data[1:]]
    space = cuts[data[1:]] & ~turn
    return np.concatenate([np.flatnonzero(turn) + 1, after_word(data, np.flatnonzero(space) + 1)])


#: Fixed value: the published splitting pattern that ``piece_edges`` is for. With other patterns texts stay whole.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def segments(texts: pa.Array, edges_of: Callable[[np.ndarray], np.ndarray] | None) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """All stretches one after another, and where those of each text begin. A null or empty text has none."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    values = texts.buffers()[2]
    data = np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]] if values is not None and values.size else np.empty(0, np.uint8)
    bounds = offsets - offsets[0]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    if edges_of is not None:
        edge[edges_of(data)] = True
    edges = np.flatnonzero(edge)
    if len(edges) < 2:
        return pa.array([], pa.large_binary()), np.zeros(len(texts) + 1, np.int64)
    flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)])
    return flat, np.searchsorted(edges, bounds)


class Memo:
    """The ids of stretches seen before, in about ``room`` bytes; ``learn`` gives those of new ones as little-endian ids.

    There are two halves: a full one becomes the old one and what is asked for again moves from there, so frequent stretches stay.
    """

    def __init__(self, learn: Callable[[list[bytes]], list[bytes]], width: str, room: int = MEMO_BYTES) -> None:
        self.learn, self.width, self.room, self.used = learn, width, room, 0
        self.held: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _take(self, new: list[bytes], found: list[bytes]) -> None:
        self.held.update(zip(new, found))
        # An entry takes some 200 bytes beside its text and ids.
        self.used += sum(map(len, new)) + sum(map(len, found)) + 200 * len(new)

    def encode(self, flat: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the stretches one after another, and how many each stretch has."""
        distinct = flat.dictionary.to_pylist()
        if 2 * self.used > self.room:
            self.old, self.held, self.used = self.held, {}, 0
        new = set(distinct).difference(self.held)
        known = list(new.intersection(self.old))
        if known:
            self._take(known, list(map(self.old.__getitem__, known)))
            new.difference_update(known)
        if new:
            fresh = list(new)
            self._take(fresh, self.learn(fresh))
        parts = list(map(self.held.__getitem__, distinct))
        size = np.fromiter(map(len, parts), np.int32, len(parts)) // int(self.width[-1])
        ids, begin = np.frombuffer(b"".join(parts), self.width), np.cumsum(size, dtype=np.int64) - size
        which = flat.indices.to_numpy()
        size = size[which]
        end = np.cumsum(size, dtype=np.int64)
        total = int(end[-1]) if len(end) else 0
        at = np.repeat(begin[which] - (end - size), size)
        at += np.arange(total)
        return ids[at], size


def of_texts(size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where each text begins among the ids, from the sizes of stretches and the first stretch of each text."""
    return np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[first]
