"""Token ids in canonical, length-limited Huffman code.

File format: a folder with two tables. ``code`` has one row for each id that occurs: id, n (its count)
and bits (its code length); codes are canonical, that is, given by lengths and ids alone.
``blocks`` has rows (shard, block, doc_ids, sizes, payload, marks): some documents in a row, their
lengths, the bit stream of all their ids and the bit offset of every ``MARK``-th id. Blocks
decode independently; within one, all stretches between marks are decoded side by side by
table look-up. Shards are in ascending order of doc_id, blocks in order within their shard, so
(shard, block, place) is the order of the documents.

Lengths are limited to ``limit`` bits by package-merge, so one look-up decodes any code.

Defined cases: a null text is an empty one and holds the end id alone; a null doc_id comes first;
rows with the same id stand next to each other, in order of their ids' bytes; other columns are
ignored; an empty table gives a file without blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import ship
from ._stage import Workspace
from .tokens import MEMO_BYTES, encoder

LIMIT = 16
MARK = 64
BLOCK_IDS = 1 << 19
END_ID = 1

_CODE = "id int, n long, bits int"
_BLOCKS = "shard int, block int, doc_ids array<long>, sizes array<int>, payload binary, marks array<int>"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code with no length above limit, by package-merge."""
    n = len(counts)
    if n > 1 << limit:
        raise ValueError(f"{n} ids do not fit codes of {limit} bits")
    if n <= 1:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    levels, packages = [], np.empty(0, np.int64)
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < n)
        both = both[rank]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    lengths, take = np.zeros(n, np.int64), 2 * (n - 1)
    for is_leaf in reversed(levels):
        used = int(is_leaf[:take].sum())
        lengths[:used] += 1
        take = 2 * (take - used)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical codes for ids with given lengths, and the look-up table that undoes them."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray, limit: int = LIMIT) -> None:
        order = np.lexsort((ids, bits))
        self.limit, ids, bits = limit, ids[order], bits[order].astype(np.int64)
        span = np.int64(1) << (limit - bits)
        begin = np.concatenate([[0], np.cumsum(span)[:-1]]) if len(span) else span
        top = int(ids.max()) + 1 if len(ids) else 0
        self.word, self.bits = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        self.word[ids], self.bits[ids] = (begin >> (limit - bits)).astype(np.uint64), bits
        used = int(span.sum())
        self.id_at = np.zeros(1 << limit, np.uint32)
        self.bits_at = np.ones(1 << limit, np.int64)
        self.id_at[:used], self.bits_at[:used] = np.repeat(ids, span), np.repeat(bits, span)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit stream and the bit offset of every MARK-th id."""
        size = self.bits[ids]
        end = np.cumsum(size)
        begin = end - size
        cell = begin >> 5
        # Codes do not overlap, so the sum of all that begin in a 32-bit cell is their union.
        value = self.word[ids] << (64 - (begin & 31) - size).astype(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        out = np.zeros((int(end[-1]) + 31 >> 5) + 2, np.uint64)
        sums = np.add.reduceat(value, first)
        out[cell[first]] += sums >> np.uint64(32)
        out[cell[first] + 1] += sums & np.uint64(0xFFFFFFFF)
        return out.astype(">u4").tobytes()[: int(end[-1]) + 7 >> 3], begin[::MARK].astype(np.int32)

    def decode(self, payload: bytes, marks: np.ndarray, n: int) -> np.ndarray:
        data = np.frombuffer(payload + b"\0\0\0\0", np.uint8).astype(np.uint32)
        wide = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
        out = np.empty((MARK, len(marks)), np.uint32)
        at = marks.astype(np.int64)
        mask, shift = np.uint32((1 << self.limit) - 1), 32 - self.limit
        for i in range(MARK):
            np.minimum(at, 8 * len(wide) - 1, out=at)  # the last stretch may run out
            peek = wide[at >> 3] >> (shift - (at & 7)).astype(np.uint32) & mask
            out[i] = self.id_at[peek]
            at += self.bits_at[peek]
        return out.T.reshape(-1)[:n]


def _width(path: str, end_id: int) -> str:
    """Two bytes for an id on the way if the vocabulary allows it."""
    return "<u2" if max(encoder(path).top, end_id) < 1 << 16 else "<u4"


#: Bytes of text, or of ids, that a Python step works on at once; a longer text goes alone.
SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Stretches of a batch of about ``size`` bytes in one column."""
    end = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    row = 0
    while row < len(batch):
        stop = max(row + 1, int(np.searchsorted(end, (end[row - 1] if row else 0) + size, "right")))
        yield batch.slice(row, stop - row)
        row = stop


def _tokens(path: str, end_id: int, width: str, text_bytes: int, memo_bytes: int):

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, memo_bytes)
        for batch in batches:
            for part in slices(batch, "text", text_bytes):
                ids, at = own.encode(part.column("text"))
                raw = np.insert(ids, at[1:], end_id).astype(width).tobytes()
                at = (at + np.arange(len(at))) * int(width[-1])
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)])
                yield pa.record_batch([part.column("doc_id"), column.cast(pa.binary())], names=["doc_id", "ids"])

    return run


def _count(width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch, "ids"):
                found = np.bincount(np.frombuffer(b"".join(part.column("ids").to_pylist()), width))
                if len(found) > len(total):
                    total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)])
                total[: len(found)] += found
        ids = np.flatnonzero(total)
        yield pa.record_batch([pa.array(ids, pa.int32()), pa.array(total[ids])], names=["id", "n"])

    return run


def _write(code: Code, block_ids: int, width: str):
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("payload", pa.binary()), ("marks", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, n, held, room, each = TaskContext.get().partitionId(), 0, [], 0, int(width[-1])

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x for _, x in held), width)
            payload, marks = code.encode(ids)
            return pa.record_batch(
                [[shard], [n], [[d for d, _ in held]], [[len(x) // each for _, x in held]], [payload], pa.array([marks], pa.list_(pa.int32()))], schema=schema
            )

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id"), batch.column("ids")):
                held.append((doc.as_py(), ids.as_py()))
                room += len(held[-1][1]) // each
                if room >= block_ids:
                    yield flush()
                    n, held, room = n + 1, [], 0
        if held:
            yield flush()

    return run


def _read(code: Code):
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("place", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                shard, block, docs, sizes, payload, marks = (batch.column(c)[row] for c in schema.names[:2] + ["doc_ids", "sizes", "payload", "marks"])
                end = np.cumsum(np.asarray(sizes.values, np.int64))
                raw = code.decode(payload.as_py(), np.asarray(marks.values), int(end[-1])).astype("<u4").tobytes()
                n = len(end)
                ids = pa.array([raw[4 * a : 4 * b] for a, b in zip(np.concatenate([[0], end[:-1]]).tolist(), end.tolist())], pa.binary())
                same = lambda x: pa.array(np.full(n, x.as_py()), pa.int32())
                yield pa.record_batch([same(shard), same(block), pa.array(np.arange(n), pa.int32()), docs.values, ids], schema=schema)

    return run


def _digest(code: Code):
    """As ``_read``, with sums in place of the ids: for where the ids themselves need not travel."""
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _read(code)(batches):
            size = pc.binary_length(batch.column("ids")).to_numpy() // 4
            crc = [zlib.crc32(x.as_buffer()) for x in batch.column("ids")]
            n = pa.array(size, pa.int64())
            yield pa.record_batch([batch.column("shard"), batch.column("block"), batch.column("doc_id"), pa.array(np.cumsum(size) - size, pa.int64()), n, pa.array(crc, pa.int64())], schema=schema)

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, limit: int = LIMIT, block_ids: int = BLOCK_IDS, text_bytes: int = SLICE_BYTES, memo_bytes: int = MEMO_BYTES) -> None:
    """Encodes every text with the vocabulary file, appends end_id and writes the file format to path.

    text_bytes are encoded at once in each Python worker, whose memo holds memo_bytes: more take less time and more memory.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "tokens")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    width = _width(vocabulary, end_id)
    tokens = work.save(docs.mapInArrow(_tokens(vocabulary, end_id, width, text_bytes, memo_bytes), "doc_id long, ids binary"), "ids")
    # At most one row for each id of the vocabulary comes to the driver.
    counts = tokens.select("ids").mapInArrow(_count(width), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas().sort_values("id")
    ids, n = counts["id"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)
    bits = code_lengths(n, limit)
    spark.createDataFrame([(int(i), int(c), int(b)) for i, c, b in zip(ids, n, bits)], _CODE).coalesce(1).write.mode("overwrite").parquet(f"{path}/code")
    order = ["doc_id", "tie"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = tokens.withColumn("tie", F.xxhash64("ids")).repartitionByRange(parts, *order).sortWithinPartitions(*order, "ids")
    dealt.select("doc_id", "ids").mapInArrow(_write(Code(ids, bits, limit), block_ids, width), _BLOCKS).write.mode("overwrite").parquet(f"{path}/blocks")
    work.drop("ids")


def _open(spark: SparkSession, path: str, limit: int) -> tuple[Code, DataFrame]:
    rows = spark.read.schema(_CODE).parquet(f"{path}/code").toPandas()
    return Code(rows["id"].to_numpy(np.int64), rows["bits"].to_numpy(np.int64), limit), spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, limit: int = LIMIT) -> DataFrame:
    """The documents of the file: shard, block, place (their order), doc_id and ids (little-endian unsigned 32-bit)."""
    ship(spark)
    code, stored = _open(spark, path, limit)
    return stored.mapInArrow(_read(code), "shard int, block int, place int, doc_id long, ids binary")


def read_digests(spark: SparkSession, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from the decoded file.

    The running totals cover blocks, not documents: one small row for about BLOCK_IDS ids, summed
    within shards and then over shards.
    """
    ship(spark)
    code, stored = _open(spark, path, limit)
    sized = stored.select("shard", "block", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    shards = sorted((r["shard"], r["n"]) for r in sized.groupBy("shard").agg(F.sum("n").alias("n")).collect())  # one row for each shard
    begin, total = [], 0
    for shard, n in shards:
        begin.append((shard, total))
        total += n
    of_shard = spark.createDataFrame(begin, "shard int, shard_start long")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    of_block = sized.select("shard", "block", F.coalesce(before, F.lit(0)).alias("block_start")).join(F.broadcast(of_shard), "shard").select("shard", "block", (F.col("block_start") + F.col("shard_start")).alias("block_start"))
    docs = stored.mapInArrow(_digest(code), "shard int, block int, doc_id long, before long, n_tokens long, ids_crc32 long")
    return docs.join(of_block, ["shard", "block"]).select("doc_id", (F.col("block_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
