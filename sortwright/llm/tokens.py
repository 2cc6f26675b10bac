"""Encoding with a public word-level BPE vocabulary, word by word.

The vocabulary drops white space and marks word ends, so a text's ids are those of its pieces one
after another. Pieces of plain characters are cut here by the vocabulary's own pattern and looked up in
a memo bounded in bytes; those not in it are encoded by the tokenizers library, many at a time, and cut
apart again at the word-end ids. Any word with other characters (combining marks, rare
letters, special tokens) goes through the library whole. One tokenizer is held; it works on
slices of about a megabyte of text, so memory follows the slice or the longest text.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from ._worker import held

_TOP = 0x250
_plain = [chr(c) for c in range(0x21, _TOP) if not 0x7F <= c <= 0xA0 and c not in (0xAD, 0x130)]
_pick = lambda kind: "".join(re.escape(c) for c in _plain if unicodedata.category(c)[0] == kind)
_L, _N = _pick("L"), _pick("N")
#: The vocabulary's splitting pattern over the plain characters.
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^ \t-\r{_L}{_N}]+")
_PIECE_OR_END = re.compile(_PIECE.pattern + "|\n")
_ODD = re.compile("[^\t-\r " + "".join(re.escape(c) for c in _plain) + "]|<\\|")
#: Stands for the end of a word among its ids.
_MARK = np.array(0xFFFFFFFF, "<u4")
#: What the memo of a worker may hold.
MEMO_BYTES = 48 << 20


class Encoder:
    """One per Python worker; see ``encoder``. The memo of pieces holds ``memo`` bytes in two halves: a full one becomes the old
    one, and what is asked for again moves from there, so frequent pieces stay."""

    def __init__(self, path: str, memo: int = MEMO_BYTES) -> None:
        self.own = Tokenizer.from_file(path)
        suffix, size = self.own.model.end_of_word_suffix, self.own.get_vocab_size()
        self.top = size - 1
        self.last = np.fromiter(((self.own.id_to_token(i) or "").endswith(suffix) for i in range(size)), bool, size)
        # Pieces are normalised and cut already: for them the same tokenizer splits at spaces alone.
        self.plain = (normalizers.Sequence([]), pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]))
        self.usual = (self.own.normalizer, self.own.pre_tokenizer)
        self.pieces: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.room, self.used = memo, 0

    def _whole(self, text: str) -> bytes:
        return np.array(self.own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        self.own.normalizer, self.own.pre_tokenizer = self.plain
        parts = [new[i : i + 512] for i in range(0, len(new), 512)]
        found = [np.array(self.own.encode_batch_fast([" ".join(p)], add_special_tokens=False)[0].ids, "<u4") for p in parts]
        self.own.normalizer, self.own.pre_tokenizer = self.usual
        size = 0
        for part, ids in zip(parts, found):
            cut = (np.flatnonzero(self.last[ids]) + 1) * 4
            if len(cut) != len(part):
                whole = list(map(self._whole, part))
                self.pieces.update(zip(part, whole))
                size += sum(map(len, whole))
                continue
            raw, begin = ids.tobytes(), 0
            size += len(raw)
            for p, end in zip(part, cut.tolist()):
                self.pieces[p] = raw[begin:end]
                begin = end
        self._count(new, size)

    def _count(self, pieces: list[str], size: int) -> None:
        # An entry of the memo takes some 200 bytes beside its text and ids.
        self.used += 200 * len(pieces) + 2 * len("".join(pieces)) + size

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words one after another, and where those of each begin."""
        if 2 * self.used > self.room:
            self.old, self.pieces, self.used = self.pieces, {}, 0
        text = "\n".join(words)
        odd = {i: self._whole(w) for i, w in enumerate(words) if _ODD.search(w)} if _ODD.search(text) else {}
        if odd:
            text = "\n".join(["" if i in odd else w for i, w in enumerate(words)])
        flat = _PIECE_OR_END.findall(text.lower())
        new = set(flat).difference(self.pieces)
        new.discard("\n")
        # An intersection with a dictionary would walk all of it.
        known = list(filter(self.old.__contains__, new))
        if known:
            again = list(map(self.old.__getitem__, known))
            self.pieces.update(zip(known, again))
            self._count(known, len(b"".join(again)))
            new.difference_update(known)
        if new:
            self._learn(list(new))
        self.pieces["\n"] = _MARK.tobytes()
        ids = np.frombuffer(b"".join(map(self.pieces.__getitem__, flat)), "<u4")
        mark = np.flatnonzero(ids == _MARK)
        at = np.concatenate([[0], mark - np.arange(len(mark)), [len(ids) - len(mark)]])[: len(words) + 1]
        ids = np.delete(ids, mark)
        if odd:
            parts = [odd[i] if i in odd else ids[at[i] : at[i + 1]].tobytes() for i in range(len(words))]
            at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in parts])])
            ids = np.frombuffer(b"".join(parts), "<u4")
        return ids, at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where those of each text begin; a null text has none."""
        # ASCII white space alone parts words here: no rule of the vocabulary reaches across it.
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        flat = split.flatten().dictionary_encode()
        if not len(flat):
            return np.empty(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        ids, begin = self._words(flat.dictionary.to_numpy(zero_copy_only=False).tolist())
        word = flat.indices.to_numpy()
        begin = begin.astype(np.int32)
        size = np.diff(begin)[word]
        end = np.cumsum(size, dtype=np.int32)
        at = np.concatenate([[0], end])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        place = np.repeat(begin[word] - (end - size), size)
        place += np.arange(end[-1], dtype=np.int32)
        return ids.take(place), at.astype(np.int64)


def encoder(path: str, memo: int = MEMO_BYTES) -> Encoder:
    return held("encoder", (path, memo), lambda: Encoder(path, memo))
