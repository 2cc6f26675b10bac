"""Clustering a gathered sample: k-medoids steps, objective, centres, and merging named groups.

Sums of cosines against a whole group are dot products with the group's summed unit vectors, so a
medoid step and the objective need one vector per group and never a matrix of pairs.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, doubles, let, mean_vectors, unit
from ..runtime import ship, staged
from .rules import numbered

#: Rows that one clustering run holds; the gather step samples down to 300.
MAX_ROWS = 2_000


def group_count(n: Column, per_group: int = 3, least: int = 3, most: int = 30) -> Column:
    """How many groups to split n rows into: one below four rows, else about one in three, within bounds, at most half."""
    k = F.greatest(F.lit(least), F.least(F.lit(most), F.bround(n / per_group, 0).cast("long"), F.floor(n / 2)))
    return F.when(n < 4, F.lit(1)).otherwise(k).cast("long")


def assign(rows: DataFrame, medoids: DataFrame, vec: str = "vec") -> DataFrame:
    """Adds ``cluster``: the medoid (cluster, vec) with the highest cosine, the lowest number on ties."""
    from .rank import as_side

    side = as_side(medoids.select("cluster", unit(doubles(F.col("vec"))).alias("vec")), "vec", order="cluster", name="_medoids")
    best = let(unit(doubles(F.col(vec))), lambda v: F.array_min(F.transform("_medoids", lambda m: F.struct((-dot(v, m["vec"])).alias("minus"), m["cluster"].alias("cluster")))))
    return rows.crossJoin(F.broadcast(side)).withColumn("_best", best).select(*rows.columns, F.col("_best.cluster").alias("cluster"), (-F.col("_best.minus")).alias("score"))


def row_sums(rows: DataFrame, cluster: str = "cluster", vec: str = "vec") -> DataFrame:
    """Adds ``total``: each row's summed cosine to all rows of its cluster, itself counted as 1."""
    sums = rows.select(cluster, F.posexplode(unit(doubles(F.col(vec)))).alias("_pos", "_x")).groupBy(cluster, "_pos").agg(F.sum("_x").alias("_x"))
    whole = sums.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_x"))), lambda s: s["_x"]).alias("_sum"))
    return rows.join(whole, cluster).withColumn("total", dot(unit(doubles(F.col(vec))), F.col("_sum"))).drop("_sum")


def medoids(rows: DataFrame, key: str, cluster: str = "cluster", vec: str = "vec") -> DataFrame:
    """cluster, key and total of the member closest to all others, the smallest key on ties."""
    best = F.min(F.struct((-F.round("total", 9)).alias("minus"), F.col(key).alias("key"), F.col("total")))
    return row_sums(rows, cluster, vec).groupBy(cluster).agg(best.alias("b")).select(cluster, F.col("b.key").alias(key), F.col("b.total").alias("total"))


def objective(rows: DataFrame, key: str, cluster: str = "cluster", vec: str = "vec") -> DataFrame:
    return medoids(rows, key, cluster, vec).agg(F.sum("total").alias("objective"))


def central(rows: DataFrame, key: str, n: int, cluster: str = "cluster", vec: str = "vec") -> DataFrame:
    """cluster, key, rank and centrality (cosine to the centre) of each group's n most central members."""
    centre = mean_vectors(rows, [cluster], vec, normalised=True)
    scored = rows.join(centre, cluster).select(cluster, key, dot(unit(doubles(F.col(vec))), F.col("centre")).alias("centrality"))
    w = Window.partitionBy(cluster).orderBy(F.desc(F.round("centrality", 9)), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def sizes(rows: DataFrame, cluster: str = "cluster", least: int = 2) -> DataFrame:
    """cluster, n, and whether it is a group: fewer members than ``least`` stay ungrouped."""
    return rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("n")).withColumn("grouped", F.col("n") >= least)


def merge_named(groups: DataFrame) -> DataFrame:
    """Groups (cluster, path, members) of one path become one, largest first; invalid paths keep their members as ungrouped."""
    from ..functions.names import valid_path

    path = F.when(valid_path(F.col("path")), F.col("path"))
    ordered = groups.withColumn("path", path).groupBy("path").agg(F.array_sort(F.collect_list(F.struct((-F.size("members")).alias("minus"), "cluster", "members"))).alias("g"))
    members = F.flatten(F.transform("g", lambda x: x["members"]))
    return ordered.select("path", F.size("g").alias("n_groups"), members.alias("members"), F.size(members).alias("n_members"))


def lloyd(vectors: np.ndarray, k: int, seed: int, steps: int = 20) -> list[int]:
    """k-medoids over unit vectors: spread seeding by Python's generator, then assign and re-centre until nothing moves."""
    n, rng = len(vectors), random.Random(seed)
    sim = vectors @ vectors.T
    np.fill_diagonal(sim, 1.0)
    chosen = [rng.randrange(n)]
    while len(chosen) < k:
        gap = (1 - sim[:, chosen]).min(axis=1) ** 2
        aim = rng.random() * (float(gap.sum()) or 1.0)
        reach = np.cumsum(gap) >= aim
        reach[chosen] = False
        free = np.flatnonzero(reach)
        chosen.append(int(free[0]) if len(free) else next(i for i in range(n) if i not in chosen))
    for _ in range(steps):
        labels = sim[:, chosen].argmax(axis=1)
        moved = list(chosen)
        for j in range(k):
            inside = np.flatnonzero(labels == j)
            if len(inside):
                moved[j] = int(inside[sim[np.ix_(inside, inside)].sum(axis=1).argmax()])
        if moved == chosen:
            break
        chosen = moved
    return labels.tolist()


def _sides(vectors: dict[int, list[float]]) -> DataFrame:
    spark = SparkSession.active()
    return spark.createDataFrame(sorted(vectors.items()), "cluster int, vec array<double>")


def _spread(rows: DataFrame, n: int, k: int, seed: int, span: int) -> list[int]:
    """Positions of the seeds that ``lloyd`` takes: the first anywhere, each next one with a chance by its squared distance to the nearest."""
    rng = random.Random(seed)
    vec_at = lambda p: list(rows.where(F.col("_pos") == p).first()["_unit"])
    chosen = [rng.randrange(n)]
    held = {0: vec_at(chosen[0])}
    while len(chosen) < k:
        score = assign(rows.select("_pos", F.col("_unit").alias("vec")), _sides(held)).select("_pos", "score")
        taken = F.col("_pos").isin(chosen)
        gaps = score.select("_pos", F.when(taken, F.lit(0.0)).otherwise(F.pow(1 - F.col("score"), F.lit(2))).alias("gap"))
        totals = gaps.groupBy(F.floor(F.col("_pos") / span).alias("s")).agg(F.sum("gap").alias("gap")).orderBy("s").collect()  # one row for each span
        aim, below, reached = rng.random() * (sum(r["gap"] for r in totals) or 1.0), 0.0, None
        for r in totals:
            if below + r["gap"] >= aim:
                inside = gaps.where(F.floor(F.col("_pos") / span) == r["s"])
                run = F.lit(below) + F.sum("gap").over(Window.partitionBy(F.floor(F.col("_pos") / span)).orderBy("_pos"))
                reached = inside.withColumn("run", run).where((F.col("run") >= aim) & ~taken).agg(F.min("_pos")).first()[0]
                if reached is not None:
                    break
            below += r["gap"]
        free = reached if reached is not None else rows.where(~taken).agg(F.min("_pos")).first()[0]
        held[len(chosen)] = vec_at(free)
        chosen.append(free)
    return chosen


def k_medoids(rows: DataFrame, key: str, k: int, vec: str = "vec", seed: int = 0, start: list | None = None, steps: int = 20, span: int = 1 << 16) -> DataFrame:
    """key and cluster (0 to k - 1) of all rows: seeds spread as ``lloyd`` does, or the keys of ``start``; then rounds of assigning
    and moving each medoid to the member closest to all of its cluster, until none moves or after ``steps`` rounds.

    Each round is two passes over the rows, which are written down once with unit vectors; a round's labels are written too, so lineage
    stays short. k vectors and, while seeding, a sum for each span of positions come to the driver; no matrix of pairs, no sample.

    Defined cases: keys are distinct; fewer rows than k give as many clusters as rows; a zero vector is at distance one from all;
    an empty table gives an empty result.
    """
    plain = rows.select(F.col(key).alias("_key"), unit(doubles(F.col(vec))).alias("_unit"))
    own = staged(numbered(plain, "_key", "_pos"), "units")
    n = own.count()
    k = min(k, n)
    if not n:
        return rows.select(key, F.lit(0).alias("cluster")).limit(0)
    if start is None:
        at = _spread(own, n, k, seed, span)
    else:
        places = {r["_key"]: r["_pos"] for r in own.where(F.col("_key").isin(start)).select("_key", "_pos").collect()}
        at = [places[s] for s in start]
    labelled = None
    for _ in range(max(1, steps)):
        held = {r["_pos"]: list(r["_unit"]) for r in own.where(F.col("_pos").isin(at)).select("_pos", "_unit").collect()}
        labelled = staged(assign(own.withColumnRenamed("_unit", "vec"), _sides({j: held[p] for j, p in enumerate(at)})).drop("score"), "labels")
        moved = list(at)
        for r in medoids(labelled, "_pos").collect():  # one row for each cluster
            moved[r["cluster"]] = r["_pos"]
        if moved == at:
            break
        at = moved
    return labelled.select(F.col("_key").alias(key), "cluster")


def quality(labels: list[int], vectors: np.ndarray) -> float:
    total = 0.0
    for j in set(labels):
        inside = vectors[np.array(labels) == j]
        total += float((inside @ inside.sum(axis=0)).max())
    return total


def over_split(rows: DataFrame, key: str, vec: str = "vec", k: int | None = None) -> DataFrame:
    """key and cluster: the best of three seeded runs over a gathered sample, which one task holds (at most MAX_ROWS)."""
    n = rows.limit(MAX_ROWS + 1).count()
    if n > MAX_ROWS:
        raise ValueError(f"over_split clusters samples of at most {MAX_ROWS} rows: gather first")
    groups = k or (1 if n < 4 else max(3, min(30, round(n / 3), n // 2)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if not held:
            return
        frame = pd.concat(held).sort_values("key")
        v = np.array(frame["vec"].tolist(), float)
        v = v / np.where((size := np.linalg.norm(v, axis=1, keepdims=True)) > 0, size, 1)
        runs = [lloyd(v, groups, seed) for seed in (0, 1, 2)] if len(v) >= 4 else [[0] * len(v)]
        yield pd.DataFrame({"key": frame["key"], "cluster": max(runs, key=lambda labels: round(quality(labels, v), 9))})

    ship(rows.sparkSession)
    kind = dict(rows.dtypes)[key]
    one = rows.select(F.col(key).alias("key"), doubles(F.col(vec)).alias("vec")).repartition(1)
    return one.mapInPandas(run, f"key {kind}, cluster int").withColumnRenamed("key", key)
