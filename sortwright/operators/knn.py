"""The k most similar examples of each document, for any number of examples.

Documents and examples are packed into blocks: rows of keys and a matrix of unit vectors. Blocks are paired by a
product without a shuffle: each task reads one part of either side where it lies, so nothing is written once for each
pair, and what lies on disk grows with the rows. In a task all blocks of its examples (at most ``BYTES`` in all, about) pass by a block of
documents, which keeps its k best so far; a block without a better one costs no more than a product. Only where the examples
have several parts are the k best of each merged by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import doubles
from ..runtime import ship, staged

#: What the examples of a task take, a block of either side, and the scores of some documents against one.
BYTES = 64 << 20
BLOCK = 1 << 20
SCORES = 16 << 20
PLACES = 9


def _units(column: pa.Array, width: int) -> np.ndarray:
    """Rows of length one, as wide as the longest vector; null, empty and zero vectors are zero."""
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        if v.is_valid and len(v):
            x = np.nan_to_num(v.values.to_numpy(zero_copy_only=False).astype(float))
            out[i, : len(x)] = x
    return out / np.where((n := np.linalg.norm(out, axis=1, keepdims=True)) > 0, n, 1)


def _packed(width: int, rows: int):
    """Blocks of some rows: their keys, ascending, and their units."""

    def block(keys: np.ndarray, units: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(keys, kind="stable")
        return pa.record_batch([pa.array([x[order].tobytes()], pa.binary()) for x in (keys, units)], names=["keys", "units"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, units = np.empty(0, np.int64), np.empty((0, width))
        for batch in batches:
            keys, units = np.concatenate([keys, batch.column("key").to_numpy()]), np.concatenate([units, _units(batch.column("vec"), width)])
            while len(keys) >= rows:
                yield block(keys[:rows], units[:rows])
                keys, units = keys[rows:], units[rows:]
        if len(keys):
            yield block(keys, units)

    return run


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row; equal scores in their order."""
    if score.shape[1] <= k:
        return np.argsort(-score, axis=1, kind="stable")
    out = np.argpartition(-score, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(score, out, 1).min(axis=1, keepdims=True)
    for i in np.flatnonzero((score >= least).sum(axis=1) > k):
        some = np.flatnonzero(score[i] >= least[i])
        out[i] = some[np.argsort(-score[i, some], kind="stable")][:k]
    out.sort(axis=1)
    return np.take_along_axis(out, np.argsort(-np.take_along_axis(score, out, 1), axis=1, kind="stable"), 1)


class _Near:
    """A block of documents and the k best of each among the examples that have passed."""

    KIND = pa.list_(pa.struct([("minus", pa.float64()), ("seq", pa.int64()), ("score", pa.float64())]))

    def __init__(self, keys: np.ndarray, units: np.ndarray, k: int) -> None:
        self.keys, self.units, self.k = keys, units, k
        shape = (len(keys), k)
        self.minus, self.seq, self.score = np.full(shape, np.inf), np.zeros(shape, np.int64), np.zeros(shape)

    def meet(self, seq: np.ndarray, side: np.ndarray) -> None:
        step = max(1, SCORES // (8 * len(seq)))
        for i in range(0, len(self.keys), step):
            score = self.units[i : i + step] @ side.T
            # With room for rounding, so that an earlier example of the same rounded score is not passed over.
            rows = np.flatnonzero(score.max(axis=1) >= -self.minus[i : i + step, -1] - 2 * 10.0**-PLACES)
            if not len(rows):
                continue
            score = score[rows]
            at = _best(score.round(PLACES) + 0.0, self.k)
            rows += i
            new = np.take_along_axis(score, at, 1)
            minus, all_seq, all_score = (np.concatenate(x, axis=1) for x in ((self.minus[rows], -new.round(PLACES) + 0.0), (self.seq[rows], seq[at]), (self.score[rows], new)))
            first = np.lexsort((all_seq, minus), axis=1)[:, : self.k]
            self.minus[rows], self.seq[rows], self.score[rows] = (np.take_along_axis(x, first, 1) for x in (minus, all_seq, all_score))

    def batch(self) -> pa.RecordBatch:
        there = self.minus < np.inf
        ends = np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(x[there]) for x in (self.minus, self.seq, self.score)], fields=list(self.KIND.value_type))
        return pa.record_batch([pa.array(self.keys), pa.ListArray.from_arrays(pa.array(ends), values)], names=["key", "near"])


def _pairs(k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            keys, units, seqs, sides = batch.columns
            for i in range(len(batch)):
                own = np.frombuffer(keys[i].as_buffer(), np.int64)
                # Pairs of one block of documents come one after another; another has another first key.
                if now is None or own[0] != now.keys[0]:
                    if now is not None:
                        yield now.batch()
                    now = _Near(own.copy(), np.frombuffer(units[i].as_buffer()).reshape(-1, width).copy(), k)
                now.meet(np.frombuffer(seqs[i].as_buffer(), np.int64), np.frombuffer(sides[i].as_buffer()).reshape(-1, width))
        if now is not None:
            yield now.batch()

    return run


def nearest_by_blocks(docs: DataFrame, examples: DataFrame, k: int, vec: str = "vec", size: int = BYTES) -> DataFrame:
    """Adds ``nearest``: array<struct<seq, category, (name, snippet,) score>> of the k most similar examples, earlier first
    on ties to nine places. A block of examples takes at most ``size``, and at most ``BLOCK``.

    Defined cases: null, empty and zero vectors have similarity 0 to all; a shorter vector's tail counts as zero; equal rows are
    rows of their own; examples with a null or repeated seq are refused; without examples the array is empty.
    """
    spark = docs.sparkSession
    ship(spark)
    more = [c for c in ("name", "snippet") if c in examples.columns]
    shown = ["seq", "category", *more]
    side = staged(examples.select(F.col("seq").cast("long").alias("seq"), "category", *more, doubles(F.col("vec")).alias("vec")), "examples")
    n, different, width = side.agg(F.count(F.lit(1)), F.count_distinct("seq"), F.max(F.size("vec"))).first()
    if different != n:
        raise ValueError("the examples' seq are not distinct")
    if not n:
        kind = dict(examples.dtypes)
        return docs.withColumn("nearest", F.array().cast(f"array<struct<{', '.join(f'{c}:{kind[c]}' for c in shown)},score:double>>"))
    own = staged(docs.drop("nearest").withColumn("_doc", F.monotonically_increasing_id()), "docs")
    n_docs, own_width = own.agg(F.count(F.lit(1)), F.max(F.size(vec))).first()
    width = max(width, 1, own_width or 0)
    held = max(1, BLOCK // (8 * max(width, 3 * k)))
    parts = -(-n * 8 * width // BYTES)
    slices = max(1, min(-(-n_docs // held), -(-4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // parts)))
    blocks = "keys binary, units binary"
    left = own.select(F.col("_doc").alias("key"), doubles(F.col(vec)).alias("vec")).mapInArrow(_packed(width, held), blocks).repartition(slices)
    right = side.select(F.col("seq").alias("key"), "vec").mapInArrow(_packed(width, max(1, min(size, BLOCK) // (8 * width))), blocks).repartition(parts)
    pairs = left.crossJoin(right.select(F.col("keys").alias("seqs"), F.col("units").alias("sides")).hint("shuffle_replicate_nl"))
    best = found = pairs.mapInArrow(_pairs(k, width), "key long, near array<struct<minus:double,seq:long,score:double>>")
    if parts > 1:
        best = found.groupBy("key").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    places = best.select("key", F.posexplode("near").alias("place", "e")).select("key", "place", "e.seq", "e.score").join(side.drop("vec"), "seq")
    kept = F.array_sort(F.collect_list(F.struct("place", *shown, "score")))
    lists = places.groupBy(F.col("key").alias("_doc")).agg(F.transform(kept, lambda s: F.struct(*[s[c].alias(c) for c in (*shown, "score")])).alias("nearest"))
    return own.join(lists, "_doc", "left").drop("_doc")
