"""Benchmark decontamination with one Aho-Corasick automaton over the items' windows.

Texts and items are normalised byte for byte (A-Z to a-z, other ASCII that is neither letter nor
digit to a space), so offsets in the normalised text are offsets in the original; words are then
joined by single spaces and scanned once. The automaton holds every window of ``width`` words of
every item, between spaces, so a match begins and ends at word boundaries.

The items are a stated query set. Up to ``max_item_bytes`` they are broadcast once as texts; each Python worker builds
the automaton from them once. As every word begins a window, it has up to some 13 nodes for a byte
of the items, of about 32 bytes each: 850 MB at the bound. Larger sets go in parts of that size, one automaton and one scan
of the documents each; the documents are written down once with a key, a scan keeps only the hits, and the hits of all parts are
united by document before words are counted. The result is the same as of one automaton.

Defined cases: a null or wordless text has no words and is clean; an item without words has no window;
an item with a null id still marks words but is not counted; items with the same id count once;
rows are independent, so repeated ids and other columns do not matter; empty tables on
either side are fine.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from . import _blocks as B
from ._stage import Workspace
from ._worker import held

WIDTH = 13
MAX_ITEM_BYTES = 2 << 20

#: What each byte becomes: lower case, digits and non-ASCII stay, all else separates words.
FOLD = np.full(256, 0x20, np.uint8)
FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
FOLD[0x80:] = np.arange(0x80, 0x100)
_TABLE = FOLD.tobytes()


def item_windows(items: list[tuple[int | None, str | None]], width: int = WIDTH) -> dict[bytes, set]:
    """Which items hold each window; an item of fewer words, but not none, is one window."""
    found: dict[bytes, set] = {}
    for item, text in items:
        words = (text or "").encode().translate(_TABLE).split()
        for i in range(max(1, len(words) - width + 1) if words else 0):
            ids = found.setdefault(b" ".join(words[i : i + width]), set())
            if item is not None:
                ids.add(item)
    return found


def automaton(items: list[tuple[int | None, str | None]], width: int) -> ahocorasick.Automaton | None:
    """None without windows."""
    windows = item_windows(items, width)
    if not windows:
        return None
    made = ahocorasick.Automaton()
    for window, ids in windows.items():
        made.add_word(" " + window.decode("latin-1") + " ", (window.count(b" ") + 1, tuple(ids)))
    made.make_automaton()
    return made


def _united(words: int, hits: list[tuple[int, int]]) -> np.ndarray:
    """Which words are inside some hit; a hit is its first word and the one behind its last."""
    edge = np.zeros(words + 1, np.int64)
    for first, last in hits:
        edge[first] += 1
        edge[last] -= 1
    return np.cumsum(edge)[:-1] > 0


def _found(search: ahocorasick.Automaton | None, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
    """Hits of the windows among normalised words, and the items they belong to."""
    if not search or not words:
        return [], set()
    flat = b" " + b" ".join(words) + b" "
    hits, ids = [], set()
    space = None
    for end, (n, which) in search.iter(flat.decode("latin-1")):
        if space is None:
            space = np.flatnonzero(np.frombuffer(flat, np.uint8) == 0x20)
        last = int(np.searchsorted(space, end))
        hits.append((last - n, last))
        ids.update(which)
    return hits, ids


def _part_hits(items: Broadcast, width: int):
    """key, hits (first word and the one behind the last, one after another) and items of the documents that have any."""
    key = uuid.uuid4().hex
    schema = pa.schema([("key", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = held("automaton", key, lambda: automaton(items.value, width))
        for batch in batches:
            rows: list[tuple[int, list[int], list[int]]] = []
            for b in B.blocks(batch.column("text"), keep=FOLD != 0x20):
                for d in range(len(b)):
                    hits, ids = _found(search, b.text(d).translate(_TABLE).split())
                    if hits:
                        rows.append((batch.column("key")[b.row + d].as_py(), [x for h in hits for x in h], sorted(ids)))
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The result from a text and its hits of all parts."""
    for batch in batches:
        out: dict[str, list] = {c: [] for c in _RESULT.names[1:]}
        for b in B.blocks(batch.column("text"), keep=FOLD != 0x20):
            for d in range(len(b)):
                flat = batch.column("hits")[b.row + d].as_py() or []
                n = int(b.first[d + 1] - b.first[d])
                marked = _united(n, list(zip(flat[::2], flat[1::2])))
                out["n_words"].append(n)
                out["n_hit"].append(int(marked.sum()))
                out["items"].append(sorted(set(batch.column("items")[b.row + d].as_py() or [])))
                out["spans"].append(_spans(b, d, marked) if flat else [])
        yield pa.record_batch([batch.column("doc_id"), *(pa.array(v, _RESULT.field(c).type) for c, v in out.items())], schema=_RESULT)


def _spans(b: B.Block, d: int, marked: np.ndarray) -> list[dict[str, int]]:
    """Runs of marked words as code points of the text."""
    turn = np.flatnonzero(np.diff(np.concatenate([[0], marked.view(np.int8), [0]]))).reshape(-1, 2)
    s, e = b.starts[b.first[d] : b.first[d + 1]] - b.bounds[d], b.ends[b.first[d] : b.first[d + 1]] - b.bounds[d]
    points = np.concatenate([[0], np.cumsum((np.frombuffer(b.text(d), np.uint8) & 0xC0) != 0x80)])
    return [{"start": int(points[s[i]]), "end": int(points[e[j - 1]])} for i, j in turn]


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_COLUMNS = "doc_id long, n_words long, n_hit long, items array<long>, spans array<struct<start:long,end:long>>"


def _scan(items: Broadcast, width: int):
    # Workers outlive a job and keep what they built, and nothing of a broadcast at their end names it lastingly.
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = held("automaton", key, lambda: automaton(items.value, width))
        for batch in batches:
            n_words, n_hit, which, where = [], [], [], []
            for b in B.blocks(batch.column("text"), keep=FOLD != 0x20):
                for d in range(len(b)):
                    words = b.text(d).translate(_TABLE).split()
                    hits, ids = _found(search, words)
                    marked = _united(len(words), hits) if hits else None
                    n_words.append(len(words))
                    n_hit.append(int(marked.sum()) if hits else 0)
                    which.append(sorted(ids))
                    where.append(_spans(b, d, marked) if hits else [])
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(v, f.type) for v, f in zip((n_words, n_hit, which, where), list(_RESULT)[1:]))], schema=_RESULT)

    return run


def item_parts(items: DataFrame, item_id: str, item_text: str, width: int, most: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items in parts of at most about ``most`` bytes, a part at a time on the driver.

    A longer item goes in pieces that overlap by all but one word of a window, so they have the same windows.
    """
    held_, room = [], 0
    rows = items.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    for r in rows.toLocalIterator():
        pieces = [r["text"]]
        if len(r["text"].encode()) > most:
            words = r["text"].encode().translate(_TABLE).split()
            step = max(1, most // (1 + max(map(len, words), default=1)))
            pieces = [b" ".join(words[i : i + step + width - 1]).decode() for i in range(0, max(1, len(words) - width + 1), step)]
        for text in pieces:
            size = len(text.encode()) + 16
            if held_ and room + size > most:
                yield held_
                held_, room = [], 0
            held_.append((r["item"], text))
            room += size
    yield held_


def _size(items: DataFrame, item_text: str) -> int:
    return items.agg(F.sum(F.coalesce(F.octet_length(F.col(item_text).cast("string")), F.lit(0)) + 16)).first()[0] or 0


def held_items(items: DataFrame, item_id: str = "item_id", item_text: str = "text") -> Broadcast:
    """The items, sent out once."""
    ship(items.sparkSession)
    rows = items.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).cast("string").alias("text"))
    return items.sparkSession.sparkContext.broadcast([tuple(r) for r in rows.collect()])


def _in_parts(docs: DataFrame, items: DataFrame, item_id: str, item_text: str, width: int, most: int) -> DataFrame:
    """The columns of ``_RESULT`` for docs of doc_id and text, one scan for each part of the items."""
    spark = docs.sparkSession
    ship(spark)
    work = Workspace(spark, "decontam")
    keyed = work.save(docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"), "docs")
    every = None
    for n, part in enumerate(item_parts(items, item_id, item_text, width, most)):
        sent = spark.sparkContext.broadcast(part)
        hits = work.save(keyed.select("key", "text").mapInArrow(_part_hits(sent, width), "key long, hits array<int>, items array<long>"), f"hits-{n}")
        sent.destroy()
        every = hits if every is None else every.unionByName(hits)
    united = every.groupBy("key").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items"))
    return keyed.join(united, "key", "left").select("doc_id", "text", "hits", "items").mapInArrow(_sum_up, _COLUMNS)


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, percent: int = 5, max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside any occurrence of a window), items (ids of
    the items that occur), spans (code points of the original text, end exclusive), contaminated
    (some word is hit, and at least ``percent`` of all)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    if _size(items, item_text) > max_item_bytes:
        marked = _in_parts(rows, items, item_id, item_text, width, max_item_bytes)
    else:
        marked = rows.mapInArrow(_scan(held_items(items, item_id, item_text), width), _COLUMNS)
    return marked.withColumn("contaminated", F.expr(f"n_hit > 0 and 100 * n_hit >= {int(percent)} * n_words"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, percent: int = 5, max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    if _size(items, item_text) > max_item_bytes:
        keyed = Workspace(docs.sparkSession, "decontam").save(docs.withColumn("_clean_key", F.monotonically_increasing_id()), "keyed")
        marked = contamination(keyed, items, "_clean_key", text, item_id, item_text, width, percent, max_item_bytes)
        dirty = marked.where("contaminated").select(F.col("doc_id").alias("_clean_key"))
        return keyed.join(dirty, "_clean_key", "left_anti").drop("_clean_key")
    scan = _scan(held_items(items, item_id, item_text), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pa.RecordBatch.from_arrays([pa.array(range(len(batch)), pa.int64()), batch.column(text)], names=["doc_id", "text"])
            for marked in scan(iter([column])):
                hit, words = marked.column("n_hit").to_numpy(), marked.column("n_words").to_numpy()
                yield batch.filter(pa.array((hit == 0) | (100 * hit < percent * words)))

    return docs.mapInArrow(run, docs.schema)
