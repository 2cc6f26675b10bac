"""Substring deduplication over a log-structured fingerprint index.

A window is ``width`` consecutive words. Every window carries the smallest hash
of the ``ANCHOR`` -word pieces inside it, its fingerprint; equal windows have equal
fingerprints, and neighbours mostly share theirs, so an index of fingerprints is
some fifteen times smaller than one of windows and still misses none.

``FingerprintIndex`` lives in a folder and outlasts its session. Its runs are immutable, bucketed and sorted by
their key: texts (digest) and fingerprints (how often, and whose if of one text). ``add`` merge-joins a new
batch with all runs, bucket by bucket, without moving them; a fingerprint that now stands twice makes
candidates of the batch's texts that hold it and of its one earlier owner; only candidates are read
again, and the hashes of their windows written down. Once there are ``fan_in`` runs of a kind they are
compacted into one by summing counts. ``report`` cuts the windows that stand twice from the texts that hold them.

Windows are told apart by 128 bits; words of at most 15 bytes are one to one in them (see ``_blocks``).

Defined cases: a null text has no words; texts shorter than a window lose nothing; rows with
the same text, however many and under whatever id (null too), get the same answer; other
columns are ignored, whatever their names; an empty table gives an empty result. Texts are handled whole,
one that exceeds a block alone in its block. Adding the same rows twice counts them as copies.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from . import _blocks as B
from ._skew import join_counted
from ._stage import Workspace, read_file, write_file

WIDTH = 35
ANCHOR = 8


def _keys(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def _digests(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n_words", pa.int64()), ("kept_sha256", pa.string()), ("anchors", pa.list_(pa.int64())), ("own", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, sha, n_words, anchors, own = [], [], [], [], []
            for b in B.blocks(batch.column("text")):
                h = b.words(0)
                prints = B.sliding_min(B.windows(h, ANCHOR), width - ANCHOR + 1) if len(h) >= width else h[:0]
                whole = B.windows(h, width)
                for d in range(len(b)):
                    raw = b.text(d)
                    digest.append(hashlib.md5(raw).digest())
                    sha.append(hashlib.sha256(b" ".join(raw.split())).hexdigest())
                    s, e = b.first[d], b.first[d + 1]
                    n_words.append(int(e - s))
                    e = max(s, e - width + 1)
                    anchors.append(np.unique(prints[s:e]))
                    ordered = np.sort(whole[s:e])
                    twice = ordered[1:][ordered[1:] == ordered[:-1]]
                    own.append(np.unique(prints[s:e][np.isin(whole[s:e], twice)]) if len(twice) else twice)
            if not digest:
                continue
            yield pa.record_batch([batch.column("doc_id"), pa.array(digest, pa.binary()), pa.array(n_words, pa.int64()), pa.array(sha, pa.string()), B.lists(anchors), B.lists(own)], schema=schema)

    return run


_DIGESTS = "doc_id long, digest binary, n_words long, kept_sha256 string, anchors array<long>, own array<long>"


class FingerprintIndex:
    """Sorted immutable runs of texts and fingerprints, and the windows of candidates."""

    SCHEMA = {"texts": "digest binary, doc_id long, n long", "prints": "print long, n long, owner binary", "windows": "digest binary, a long, b long, n long"}
    KEYS = {"texts": ["digest"], "prints": ["print"]}

    def __init__(self, spark: SparkSession, path: str, width: int = WIDTH, fan_in: int = 4) -> None:
        """A new index; ``open`` continues one."""
        if width <= ANCHOR:
            raise ValueError(f"a window needs more than {ANCHOR} words")
        ship(spark)
        self.spark, self.path, self.width, self.fan_in, self.made = spark, path.rstrip("/"), width, fan_in, 0
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: dict[str, list[str]] = {"texts": [], "prints": [], "windows": []}
        self.work = Workspace(spark, "substring-index")
        self.names: dict[str, str] = {}

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        held = json.loads(read_file(spark, f"{path.rstrip('/')}/manifest.json"))
        index = cls(spark, path, held["width"], held["fan_in"])
        index.made, index.buckets, index.runs = held["made"], held["buckets"], held["runs"]
        return index

    def _commit(self) -> None:
        """A run counts once the manifest names it; what an interrupted ``add`` wrote is never read."""
        held = {"width": self.width, "fan_in": self.fan_in, "made": self.made, "buckets": self.buckets, "runs": self.runs}
        write_file(self.spark, f"{self.path}/manifest.json", json.dumps(held))

    def _run(self, kind: str, df: DataFrame) -> str:
        self.made += 1
        name = f"{kind}-{self.made:05d}-{uuid.uuid4().hex[:8]}"
        path = f"{self.path}/{name}"
        if kind == "windows":
            df.write.parquet(path)
        else:
            keys = self.KEYS[kind]
            table = f"run_{uuid.uuid4().hex}"
            # One task writes each bucket, so a bucket is one sorted file.
            df.repartition(self.buckets, *keys).sortWithinPartitions(*keys).write.bucketBy(self.buckets, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(table)
            self.names[name] = table
        return name

    def _plain(self, kind: str, name: str) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA[kind]).parquet(f"{self.path}/{name}")

    def _sorted(self, kind: str, name: str) -> DataFrame:
        """The run as a bucketed table, which joins by its key where it lies."""
        if name not in self.names:
            table, keys = f"run_{uuid.uuid4().hex}", ", ".join(self.KEYS[kind])
            self.spark.sql(f"CREATE TABLE {table} ({self.SCHEMA[kind]}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
            self.names[name] = table
        return self.spark.table(self.names[name])

    def _all(self, kind: str) -> DataFrame | None:
        out = None
        for name in self.runs[kind]:
            out = self._plain(kind, name) if out is None else out.unionByName(self._plain(kind, name))
        return out

    def _merged(self, kind: str) -> DataFrame:
        """All runs of a kind as one: counts are summed, of owners and ids the smallest stays."""
        more = {"texts": [F.min("doc_id").alias("doc_id"), F.sum("n").alias("n")], "prints": [F.sum("n").alias("n"), F.min("owner").alias("owner")]}[kind]
        found = self._all(kind)
        if found is None:
            return self.spark.createDataFrame([], self.SCHEMA[kind])
        return found.groupBy(*self.KEYS[kind]).agg(*more) if len(self.runs[kind]) > 1 else found

    def _probe(self, kind: str, rows: DataFrame) -> DataFrame | None:
        """The rows of all runs whose key is among those of ``rows``, by one merge join a run."""
        out = None
        for name in self.runs[kind]:
            hit = self.work.save(self._sorted(kind, name).join(rows.select(*self.KEYS[kind]), self.KEYS[kind], "left_semi"), f"hits-{name}")
            out = hit if out is None else out.unionByName(hit)
        return out

    def add(self, batch: DataFrame, corpus: DataFrame) -> DataFrame:
        """Adds a batch of digests (see ``digests``). corpus: doc_id and text of the batch and of all added before.

        Returns the candidates that were read: digest, doc_id and prints.
        """
        self.work = Workspace(self.spark, "substring-batch")
        texts = batch.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"), F.first("anchors").alias("anchors"), F.first("own").alias("own"))
        texts = self.work.save(texts, "texts")
        known = self._probe("texts", texts)
        new = texts if known is None else texts.join(known.select("digest"), "digest", "left_anti")
        held = new.select("digest", "doc_id", F.explode("anchors").alias("print"), "own").select("digest", "doc_id", "print", F.array_contains("own", F.col("print")).cast("long").alias("again"))
        run = self._run("prints", held.groupBy("print").agg(F.sum(1 + F.col("again")).alias("n"), F.min("digest").alias("owner")))
        mine = self._sorted("prints", run)

        before = self._probe("prints", mine)
        if before is None:
            recurring = mine.select("print", "n", F.lit(None).cast("binary").alias("owner")).where("n > 1")
        else:
            before = before.groupBy("print").agg(F.sum("n").alias("old"), F.min("owner").alias("whose"))
            recurring = mine.join(before, "print", "left").where("n + coalesce(old, 0) > 1").select("print", "n", F.expr("CASE WHEN old = 1 THEN whose END").alias("owner"))
        recurring = self.work.save(recurring, "recurring")
        places = held.select("digest", "doc_id", "print")
        hit = join_counted(places, recurring.select("print", "n"), ["print"], "n", batch.count()).select("digest", "doc_id", "print")
        # The batch's own texts are no run yet, so owners are looked up in the earlier ones alone.
        owners = recurring.where("owner is not null").select(F.col("owner").alias("digest"), "print")
        for name in self.runs["texts"]:
            hit = hit.unionByName(self._sorted("texts", name).select("digest", "doc_id").join(owners, "digest").select("digest", "doc_id", "print"))
        candidates = hit.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.collect_set("print").alias("prints"))
        candidates = self.work.save(candidates, "candidates")

        windows = self._run("windows", texts_of(corpus, candidates).mapInArrow(_windows(self.width), self.SCHEMA["windows"]))
        self.runs["windows"].append(windows)
        self.runs["prints"].append(run)
        self.runs["texts"].append(self._run("texts", texts.select("digest", "doc_id", "n")))
        self._commit()
        for name in ("texts", "recurring"):
            self.work.drop(name)
        for kind in self.KEYS:
            if len(self.runs[kind]) >= self.fan_in:
                self.compact(kind)
        return candidates

    def compact(self, kind: str) -> None:
        """Merges the runs of a kind into one; the old ones go when the manifest no longer names them."""
        old = self.runs[kind]
        if len(old) > 1:
            self.runs[kind] = [self._run(kind, self._merged(kind))]
            self._commit()
            for name in old:
                Workspace.remove(self.spark, f"{self.path}/{name}")

    def close(self) -> None:
        """Takes this session's table names out of the catalogue; the runs stay."""
        for table in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.names.clear()

    def report(self, corpus: DataFrame) -> DataFrame:
        """digest, copies, n_cut, cut_sha256 and cuts of each known text; the last three are null where nothing is cut.

        A text that stands more than once is cut whole by whoever reads this, so it is not read here.
        """
        work = Workspace(self.spark, "substring-report")
        texts = self._merged("texts")
        # A text is a candidate for a fingerprint once, so each of its windows is written down once.
        places = self._all("windows")
        if places is None:
            places = self.spark.createDataFrame([], self.SCHEMA["windows"])
        repeated = work.save(places.groupBy("a", "b").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m")).where("n > 1").select("a", "b", "m"), "repeated")
        hits = join_counted(places.select("digest", "a", "b"), repeated, ["a", "b"], "m", places.count()).groupBy("digest").agg(F.collect_list(F.struct("a", "b")).alias("w"))
        hits = hits.join(texts.where("n = 1").select("digest", "doc_id"), "digest").select("digest", "doc_id", F.col("w.a").alias("one"), F.col("w.b").alias("two"))
        hits = work.save(hits, "hits")
        cut = texts_of(corpus, hits).mapInArrow(_cut(self.width), "digest binary, n_cut long, cut_sha256 string, cuts array<struct<start:int,end:int>>")
        return texts.select("digest", F.col("n").alias("copies")).join(cut, "digest", "left")


def texts_of(corpus: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (digest, doc_id and more) with the text of one row of each; copies of a text move by their own ids."""
    at = F.coalesce("doc_id", F.lit(-1)).alias("at")
    rows = corpus.select(at, F.unhex(F.md5("text")).alias("digest"), "text")
    found = rows.join(wanted.withColumn("at", at).drop("doc_id"), ["at", "digest"])
    return found.dropDuplicates(["at", "digest"]).drop("at")


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs and how often each stands."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.empty(0, np.int64)
    return a[first], b[first], np.diff(np.append(first, len(a)))


def among(a: np.ndarray, b: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which pairs (a, b) are among the pairs (one, two); both lanes count."""
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    low, high = np.searchsorted(one, a, "left"), np.searchsorted(one, a, "right")
    out = np.zeros(len(a), bool)
    for k in range(int((high - low).max(initial=0))):
        some = np.flatnonzero(low + k < high)
        out[some] |= two[low[some] + k] == b[some]
    return out


def _windows(width: int):
    """Rows for the distinct windows whose fingerprint is listed, with how often each starts in its text."""
    schema = pa.schema([("digest", pa.binary()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, listed = B.of_list(batch.column("prints"))
            for b in B.blocks(batch.column("text")):
                h = b.words(0)
                if len(h) < width:
                    continue
                prints = B.sliding_min(B.windows(h, ANCHOR), width - ANCHOR + 1)
                first, second = B.windows(h, width), B.windows(b.words(1), width, 1)
                rows, parts = [], []
                for d in range(len(b)):
                    r = b.row + d
                    s, e = b.first[d], max(b.first[d], b.first[d + 1] - width + 1)
                    hit = s + np.flatnonzero(np.isin(prints[s:e], listed[at[r] : at[r + 1]]))
                    parts.append(_pairs(first[hit], second[hit]))
                    rows.append(np.full(len(parts[-1][0]), r))
                one, two, times = (np.concatenate(x) for x in zip(*parts))
                digest = batch.column("digest").take(pa.array(np.concatenate(rows)))
                yield pa.record_batch([digest, pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(times.astype(np.int64))], schema=schema)

    return run


def _cut(width: int):
    schema = pa.schema([("digest", pa.binary()), ("n_cut", pa.int64()), ("cut_sha256", pa.string()), ("cuts", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, one = B.of_list(batch.column("one"))
            _, two = B.of_list(batch.column("two"))
            n_cut, sha, cuts = [], [], []
            for b in B.blocks(batch.column("text")):
                first, second = B.windows(b.words(0), width), B.windows(b.words(1), width, 1)
                for d in range(len(b)):
                    r = b.row + d
                    s, e = b.first[d], b.first[d + 1]
                    stop, own = max(s, e - width + 1), slice(at[r], at[r + 1])
                    hit = among(first[s:stop], second[s:stop], one[own], two[own])
                    edge = np.zeros(e - s + 1, np.int64)
                    edge[: len(hit)] += hit
                    edge[width : width + len(hit)] -= hit
                    gone = np.cumsum(edge)[:-1] > 0
                    words = b.text(d).split()
                    n_cut.append(int(gone.sum()))
                    sha.append(hashlib.sha256(b" ".join([words[i] for i in np.flatnonzero(~gone)])).hexdigest())
                    turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    cuts.append([{"start": int(x), "end": int(y)} for x, y in turn.reshape(-1, 2)])
            yield pa.record_batch([batch.column("digest"), pa.array(n_cut, pa.int64()), pa.array(sha, pa.string()), pa.array(cuts, schema.field("cuts").type)], schema=schema)

    return run


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, digest, n_words, kept_sha256, anchors (the fingerprints) and own (those of windows that stand twice in the text)."""
    ship(docs.sparkSession)
    return _keys(docs, doc_id, text).mapInArrow(_digests(width), _DIGESTS)


def repeated_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, batch_of: Column | None = None, n_batches: int = 1) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and ``cuts``, the removed
    ranges of word positions. A word goes if a window over it also starts anywhere else.

    batch_of: the number of the arriving batch of each row, 0 to n_batches - 1.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "substring")
    index = FingerprintIndex(spark, f"{work.path}/index", width)
    seen = work.save(digests(docs, doc_id, text, width), "digests")
    docs = _keys(docs, doc_id, text)
    for i in range(n_batches):
        part = seen if n_batches == 1 else seen.where((batch_of if batch_of is not None else F.pmod(F.xxhash64("digest", "doc_id"), F.lit(n_batches))) == i)
        index.add(part, docs)
    side = work.save(index.report(docs), "report")
    index.close()
    Workspace.remove(spark, f"{work.path}/index")

    all_gone = (F.col("copies") > 1) & (F.col("n_words") >= width)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    rows = seen.select("doc_id", "digest", "n_words", "kept_sha256")
    return join_counted(rows, side, ["digest"], "copies", rows.count()).select(
        "doc_id",
        "n_words",
        F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("n_cut", F.lit(0))).alias("n_removed"),
        F.when(all_gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha256", "kept_sha256")).alias("kept_sha256"),
        F.when(all_gone, whole).otherwise(F.coalesce("cuts", none)).alias("cuts"),
    )
