"""Near-duplicate groups by circulant MinHash.

Two permutations of the 64-bit integers suffice for a signature: the first spreads the
shingles, the second is applied after shifting them around the ring by 0, 1, 2, ... and the
minimum under each shift is one coordinate. Bands of ``rows`` coordinates are bucket keys.

Documents with equal shingle sets form a class with one representative, so copies cost nothing
further. Buckets of more than one class are verified on full sets, in tasks that emit no pairs but a
spanning forest of the true links they hold. A bucket of at most ``block`` classes is one task. In a larger one
every class is first compared with one pivot, in sub-blocks: those linked to it need no further comparison
among themselves, and as 1 - Jaccard is a metric, only classes within twice the distance can be linked to
them. What is left, usually few, is dealt out as pairs of sub-blocks; no link is lost, and a bucket of near
copies costs a number of comparisons in proportion to its size. Components are then contracted in rounds.

With ``bands`` = 16 and ``rows`` = 4, a link at similarity 0.85 is missed with probability 8e-6 if coordinates
were independent; the pipeline's stage takes links at 0.8 with 24 bands, which miss 3e-6. ``test_banding_recall``
measures it. Shingles are told apart by 64 bits, classes by 128 and their size.

Defined cases: a null text, or one without words, has no shingles and stands alone; fewer words than
a shingle make one shingle; rows with the same id are one document to its links; a row with a null id
is compared as any other, and its component is null if no member has an id; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _blocks as B
from ._skew import join_counted
from ._stage import Workspace

SHINGLE = 5
#: Internal numbers of classes whose rows all lack an id start here.
NAMELESS = 1 << 62


def _sets(b: B.Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted within each text of the block, and where each text's begin."""
    h = b.folded()
    g = B.windows(h, size)
    out = []
    for d in range(len(b)):
        s, e = b.first[d], b.first[d + 1]
        if e - s >= size:
            out.append(np.unique(g[s : e - size + 1]))
        else:
            out.append(B.mix((h[s:e] * (np.arange(s, e, dtype=B.U) - B.U(s) + B.U(1) << B.U(1) | B.U(1))).sum(keepdims=True, dtype=B.U) + B.U(e - s)) if e > s else h[:0])
    at = np.zeros(len(out) + 1, np.int64)
    np.cumsum([len(x) for x in out], out=at[1:])
    return np.concatenate(out) if out else h[:0], at


def signatures(shingles: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """n coordinates for each set; sets must not be empty."""
    spread = B.mix(shingles ^ B.U(0x5851F42D4C957F2D))
    out = np.empty((len(at) - 1, n), B.U)
    step = 1 << 15
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + step, "right")) - 1)
        part, begin = spread[at[lo] : at[hi]], at[lo:hi] - at[lo]
        for k in range(n):
            out[lo:hi, k] = np.minimum.reduceat(B.mix(part - B.U(k)), begin)
        lo = hi
    return out


def _bands(size: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, keys = [], [], [], []
            for b in B.blocks(batch.column("text"), lower=True):
                shingles, at = _sets(b, size)
                count = np.diff(at)
                n.append(count)
                full = np.flatnonzero(count)
                sums = np.zeros((2, len(count)), B.U)
                key = np.zeros((len(count), bands), B.U)
                if len(full):
                    begin = np.append(at[full], at[-1])
                    sums[0, full] = np.add.reduceat(B.mix(shingles ^ B.U(0x2545F4914F6CDD1D)), at[full])
                    sums[1, full] = np.add.reduceat(B.mix(shingles + B.U(0x9FB21C651E98DF25)), at[full])
                    sig = signatures(shingles, begin, bands * rows).reshape(len(full), bands, rows)
                    folded = sig[:, :, 0].copy()
                    for r in range(1, rows):
                        folded = B.mix(folded * B.U(0x9E3779B97F4A7C15) + sig[:, :, r])
                    key[full] = B.mix(folded ^ (np.arange(bands, dtype=B.U) * B.U(0xC2B2AE3D27D4EB4F)))
                one.append(sums[0])
                two.append(sums[1])
                keys += list(key)
            if n:
                flat = lambda x: pa.array(np.concatenate(x).view(np.int64))
                yield pa.record_batch([batch.column("doc_id"), pa.array(np.concatenate(n)), flat(one), flat(two), B.lists(keys)], schema=schema)

    return run


def _members(size: int):
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for b in B.blocks(batch.column("text"), lower=True):
                shingles, at = _sets(b, size)
                parts += [shingles[at[d] : at[d + 1]] for d in range(len(b))]
            yield pa.record_batch([batch.column("node"), B.lists(parts)], schema=schema)

    return run


def forest(nodes: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between members; pairs within side 1 or within side 2 are another
    task's. Side 0 is a whole sub-block, all of whose pairs count."""
    n = len(nodes)
    size = np.array([len(s) for s in sets])
    parent = np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    group = np.cumsum(np.concatenate([[0], flat[1:] != flat[:-1]]))
    shared = np.bincount(group)[group] > 1
    owner, group = owner[shared], np.unique(group[shared], return_inverse=True)[1]
    common = np.zeros((n, n), np.float32)
    groups = int(group[-1]) + 1 if len(group) else 0
    wide = max(1, min(groups, (1 << 22) // n))
    for lo in range(0, groups, wide):
        s, e = np.searchsorted(group, [lo, lo + wide])
        has = np.zeros((n, wide), np.float32)
        has[owner[s:e], group[s:e] - lo] = 1
        common += has @ has.T
    common = common.astype(np.int64)
    linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
    linked &= (side[:, None] != side[None, :]) | (side[:, None] == 0)
    for i, j in zip(*np.nonzero(np.triu(linked, 1))):
        a, b = root(i), root(j)
        if a != b:
            parent[b] = a
            out.append((int(nodes[i]), int(nodes[j])))
    return out


def _links(percent: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[tuple[int, int], list] = ((0, 0), [])
        edges: list[tuple[int, int]] = []

        def close() -> None:
            if len(held[1]) > 1:
                nodes, side, sets = zip(*held[1])
                edges.extend(forest(np.array(nodes), np.array(side), list(sets), percent))

        for batch in batches:
            at, flat = B.of_list(batch.column("shingles"))
            columns = [np.asarray(batch.column(c)) for c in ("bucket", "task", "node", "side")]
            for r, (bucket, task, node, side) in enumerate(zip(*columns)):
                if (bucket, task) != held[0]:
                    close()
                    held = ((bucket, task), [])
                held[1].append((node, side, flat[at[r] : at[r + 1]]))
            held = (held[0], [(n, s, x.copy()) for n, s, x in held[1]])
            if edges:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*edges)], schema=schema)
                edges.clear()
        close()
        if edges:
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*edges)], schema=schema)

    return run


def _pivoted(percent: int):
    """Compares the members of a sub-block with the pivot of their bucket: kind 0 is linked to it, 1 may be linked
    to one that is, 2 can't be."""
    schema = pa.schema([("bucket", pa.int64()), ("node", pa.int64()), ("kind", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pivot = None, np.empty(0, B.U)
        for batch in batches:
            at, flat = B.of_list(batch.column("shingles"))
            columns = [np.asarray(batch.column(c)) for c in ("bucket", "part", "node", "lead")]
            out: list[tuple[int, int, int]] = []
            for r, (bucket, part, node, lead) in enumerate(zip(*columns)):
                own = flat[at[r] : at[r + 1]]
                if lead:
                    # The pivot comes first in each sub-block.
                    key, pivot = (bucket, part), own.copy()
                    continue
                assert key == (bucket, part)
                common = int(np.isin(own, pivot, assume_unique=True).sum())
                union = len(own) + len(pivot) - common
                kind = 0 if 100 * common >= percent * union else 1 if 100 * common >= (2 * percent - 100) * union else 2
                out.append((bucket, node, kind))
            if out:
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    return run


def _dealt(slots: DataFrame, sets: DataFrame, percent: int, block: int, work: Workspace) -> tuple[DataFrame, DataFrame | None]:
    """Tasks (bucket, task, node, side) whose pairs are still open, and the links to pivots if there are large buckets."""
    small = slots.where(F.col("m") <= block).select("bucket", "node", F.lit(0).cast("long").alias("task"), F.lit(0).alias("side"))
    large = slots.where(F.col("m") > block)
    if large.isEmpty():
        return small, None
    n = int(slots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = F.ceil(F.col("m") / block)
    members = large.where("node <> pivot").select("bucket", "node", F.pmod(F.xxhash64("node", F.lit(5)), parts).alias("part"), F.lit(False).alias("lead"))
    leads = large.where("node = pivot").select("bucket", "node", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(True).alias("lead"))
    rows = members.unionByName(leads).join(sets, "node").repartition(n, "bucket", "part").sortWithinPartitions("bucket", "part", F.desc("lead"))
    kinds = work.save(rows.select("bucket", "part", "node", "lead", "shingles").mapInArrow(_pivoted(percent), "bucket long, node long, kind int"), "pivoted")
    stars = kinds.where("kind = 0").select(F.col("bucket"), F.col("node").alias("v")).join(large.where("node = pivot").select("bucket", F.col("node").alias("u")), "bucket").select("u", "v")
    sums = kinds.groupBy("bucket").agg(F.count_if(F.col("kind") == 0).alias("s"), F.count_if(F.col("kind") == 1).alias("g"), F.count_if(F.col("kind") > 0).alias("r")).where("r > 0")
    open_ = kinds.join(sums, "bucket")

    def share(count: str, salt: int) -> tuple:
        number = F.greatest(F.ceil(F.col(count) / block), F.lit(1))
        return number, F.pmod(F.xxhash64("node", F.lit(salt)), number)

    number, part = share("r", 7)
    rest = open_.where("kind > 0").select("bucket", "node", part.alias("part"), F.explode(F.sequence(F.lit(0), number - 1)).alias("other"))
    lo, hi = F.least("part", "other"), F.greatest("part", "other")
    rest = rest.select("bucket", "node", F.xxhash64("bucket", lo, hi).alias("task"), F.when(lo == hi, 0).when(F.col("part") == lo, 1).otherwise(2).alias("side"))
    # The linked ones (s) against those that may be linked to them (g).
    (ns, ps), (ng, pg) = share("s", 11), share("g", 13)
    near = open_.where("kind = 1 and s > 0").select("bucket", "node", pg.alias("i"), F.explode(F.sequence(F.lit(0), ns - 1)).alias("j"), F.lit(1).alias("side"))
    star = open_.where("kind = 0 and g > 0").select("bucket", "node", ps.alias("j"), F.explode(F.sequence(F.lit(0), ng - 1)).alias("i"), F.lit(2).alias("side"))
    across = near.unionByName(star).select("bucket", "node", F.xxhash64("bucket", F.lit("across"), "i", "j").alias("task"), "side")
    return small.unionByName(rest).unionByName(across), stars


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """node and the smallest node of its component, for nodes with an edge.

    Each round hooks every node to its smallest neighbour, shortens the hooks once and contracts the
    edges by them; the images of a connected graph stay connected, and the smallest node never moves.
    """
    edges = work.save(edges.where("u <> v").distinct(), "edges-0")
    labels, i = None, 0
    while not edges.isEmpty():
        i += 1
        both = edges.union(edges.select("v", "u"))
        hook = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        up = hook.select(F.col("u").alias("p"), F.col("p").alias("q"))
        hook = work.save(hook.join(up, "p").select(F.col("u").alias("node"), F.col("q").alias("to")), f"hook-{i}")
        if labels is None:
            labels = hook
        else:
            moved = hook.select(F.col("node").alias("to"), F.col("to").alias("next"))
            labels = labels.join(moved, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
        labels = work.save(labels, f"labels-{i}")
        a = hook.select(F.col("node").alias("u"), F.col("to").alias("a"))
        b = hook.select(F.col("node").alias("v"), F.col("to").alias("b"))
        edges = work.save(edges.join(a, "u").join(b, "v").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), f"edges-{i}")
    return labels if labels is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("to"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85, shingle: int = SHINGLE, bands: int = 16, rows: int = 4, block: int = 192) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (the smallest id of its component)."""
    work = Workspace(docs.sparkSession, "minhash")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    seen = work.save(docs.mapInArrow(_bands(shingle, bands, rows), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"), "bands")
    same = ["n_shingles", "set_a", "set_b"]
    nameless = F.lit(NAMELESS) + F.xxhash64(*same).bitwiseAND(F.lit(NAMELESS - 1))
    classes = work.save(
        seen.where("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")).select(*same, "copies", F.coalesce("doc_id", nameless).alias("node"), "bands"),
        "classes",
    )
    slots = classes.select("node", F.explode("bands").alias("bucket"))
    # Buckets with the same members hold the same pairs; one of them is enough.
    lots = (
        slots.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.min("node").alias("pivot")).where("m > 1")
        .groupBy("m", "x", "y").agg(F.min("bucket").alias("bucket"), F.min("pivot").alias("pivot"))
    )
    slots = work.save(slots.join(lots.select("bucket", "m", "pivot"), "bucket"), "slots")

    # The sets of the classes in those buckets, from the text of the row whose id they bear.
    wanted = slots.select("node").distinct().join(classes.select("node", *same), "node")
    heads = wanted.where(F.col("node") < NAMELESS).select(F.col("node").alias("at"), "node")
    sets = work.save(
        docs.select(F.coalesce("doc_id", F.lit(NAMELESS)).alias("at"), "text").join(heads, "at").select("node", "text").mapInArrow(_members(shingle), "node long, shingles array<long>"),
        "sets",
    )
    if not seen.where("doc_id is null and n_shingles > 0").isEmpty():
        sets = sets.union(_nameless_sets(docs, wanted, shingle, work))

    tasks, stars = _dealt(slots, sets, percent, block, work)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = tasks.join(sets, "node").repartition(n, "bucket", "task").sortWithinPartitions("bucket", "task").select("bucket", "task", "node", F.col("side").cast("long").alias("side"), "shingles").mapInArrow(_links(percent), "u long, v long")

    found = components(edges if stars is None else edges.unionByName(stars), work)
    known = work.save(classes.select(*same, "copies", "node").join(found, "node", "left").select(*same, "copies", F.coalesce("to", "node").alias("root")), "known")
    own = F.col("doc_id")
    root = F.when(F.col("n_shingles") == 0, own).when(F.col("root") < NAMELESS, F.col("root"))
    rows = seen.select("doc_id", *same)
    full = join_counted(rows.where("n_shingles > 0"), known, same, "copies", rows.count()).select("doc_id", "n_shingles", "root")
    every = full.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("root")))
    return every.select("doc_id", "n_shingles", root.alias("component_id"), F.coalesce(own == root, F.lit(False)).alias("kept"))


def _nameless_sets(docs: DataFrame, wanted: DataFrame, shingle: int, work: Workspace) -> DataFrame:
    """Sets of the classes whose rows all lack an id, matched by content."""
    schema = pa.schema([("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, parts = [], [], [], []
            for b in B.blocks(batch.column("text"), lower=True):
                shingles, at = _sets(b, shingle)
                for d in range(len(b)):
                    s = shingles[at[d] : at[d + 1]]
                    n.append(len(s))
                    one.append(int(B.mix(s ^ B.U(0x2545F4914F6CDD1D)).sum(dtype=B.U).view(np.int64)))
                    two.append(int(B.mix(s + B.U(0x9FB21C651E98DF25)).sum(dtype=B.U).view(np.int64)))
                    parts.append(s)
            yield pa.record_batch([pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), B.lists(parts)], schema=schema)

    same = ["n_shingles", "set_a", "set_b"]
    rows = docs.where("doc_id is null").select("text").mapInArrow(run, "n_shingles long, set_a long, set_b long, shingles array<long>")
    return work.save(rows.join(wanted.where(F.col("node") >= NAMELESS), same).dropDuplicates(["node"]).select("node", "shingles"), "nameless")
