"""Ranking documents against categories, nudged by examples.

Categories and examples are user-made and small; they travel as one row of arrays, whose size is
checked, so a ranking is a projection over the documents: no shuffle, no explosion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import cosine, dot, doubles, let, unit
from ..runtime import ship
from .knn import nearest_by_blocks

#: Rows of categories or examples that may be held in one array.
MAX_SIDE = 20_000
#: Above these cosines two documents are very likely of one kind.
SIMILAR = {"embeddinggemma": 0.65, "nomic-embed-text": 0.70}
SIMILAR_ELSE = 0.62
WEIGHT = 0.5
#: Scores that agree to so many places tie, whatever the order of summation.
PLACES = 9
RANKED = T.StructField("ranked", T.ArrayType(T.StructType([T.StructField("category", T.StringType()), T.StructField("score", T.DoubleType())])))


def similar_threshold(model: str) -> float:
    return next((v for k, v in SIMILAR.items() if k in model.lower()), SIMILAR_ELSE)


def as_side(rows: DataFrame, *columns: str, order: str, name: str) -> DataFrame:
    """One row holding all rows in order; refuses sides too large to travel."""
    n = rows.limit(MAX_SIDE + 1).count()
    if n > MAX_SIDE:
        raise ValueError(f"{name}: more than {MAX_SIDE} rows")
    return rows.agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in columns if c != order]))).alias(name))


def ranked(docs: DataFrame, categories: DataFrame, vec: str = "vec", examples: DataFrame | None = None, tau: float = SIMILAR_ELSE, weight: float = WEIGHT) -> DataFrame:
    """Adds ``ranked``: array<struct<category, score>>, best first, ties in taxonomy order.

    categories: ord, category, vec. examples: seq, category, vec; a category gains weight times what its most
    similar example exceeds tau by.
    """
    unit_of = lambda df: df.withColumn("vec", unit(doubles(F.col("vec"))))
    out = docs.crossJoin(F.broadcast(as_side(unit_of(categories), "category", "vec", order="ord", name="_cats")))
    if examples is not None:
        out = out.crossJoin(F.broadcast(as_side(unit_of(examples), "category", "vec", order="seq", name="_examples")))

    def score(v: Column) -> Column:
        if examples is None:
            return F.transform("_cats", lambda c: let(-dot(v, c["vec"]), lambda m: F.struct(F.round(m, PLACES).alias("order"), c["ord"].alias("ord"), c["category"].alias("category"), m.alias("minus"))))
        near = F.transform("_examples", lambda e: F.struct(e["category"].alias("category"), (dot(v, e["vec"]) - tau).alias("over")))
        return let(near, lambda n: F.transform("_cats", lambda c: let(
            -(dot(v, c["vec"]) + weight * F.greatest(F.lit(0.0), F.coalesce(F.array_max(F.transform(F.filter(n, lambda e: e["category"] == c["category"]), lambda e: e["over"])), F.lit(0.0)))),
            lambda m: F.struct(F.round(m, PLACES).alias("order"), c["ord"].alias("ord"), c["category"].alias("category"), m.alias("minus")))))

    best = F.transform(F.array_sort(let(unit(doubles(F.col(vec))), score)), lambda s: F.struct(s["category"].alias("category"), (-s["minus"]).alias("score")))
    return out.withColumn("ranked", best).drop("_cats", "_examples")


def ranked_by_blocks(docs: DataFrame, categories: DataFrame, vec: str = "vec") -> DataFrame:
    """The same without examples, by matrix products over Arrow batches."""
    rows = sorted(categories.limit(MAX_SIDE + 1).select("ord", "category", "vec").collect())
    if len(rows) > MAX_SIDE:
        raise ValueError(f"categories: more than {MAX_SIDE} rows")
    names, side = [r["category"] for r in rows], np.array([r["vec"] for r in rows], float)
    side = side / np.where((n := np.linalg.norm(side, axis=1, keepdims=True)) > 0, n, 1)
    kind = pa.list_(pa.struct([("category", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.asarray(batch.column(vec).flatten(), float).reshape(len(batch), -1)
            score = flat / np.where((n := np.linalg.norm(flat, axis=1, keepdims=True)) > 0, n, 1) @ side.T
            order = np.argsort(-score.round(PLACES), axis=1, kind="stable")
            values = pa.StructArray.from_arrays([pa.array(names).take(pa.array(order.ravel())), pa.array(np.take_along_axis(score, order, 1).ravel())], fields=list(kind.value_type))
            column = pa.ListArray.from_arrays(pa.array(np.arange(0, order.size + 1, len(names), dtype=np.int32)), values)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "ranked"])

    ship(docs.sparkSession)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, RANKED]))


def margin(best: Column) -> Column:
    """The lead of the first over the second; with one category, its own score."""
    first, second = F.get(best, F.lit(0))["score"], F.get(best, F.lit(1))["score"]
    return F.coalesce(first - second, first)


def alternatives(best: Column, first: int = 2, last: int = 4) -> Column:
    """The names on ranks first to last."""
    return F.transform(F.slice(best, first, last - first + 1), lambda s: s["category"])


def shortlist(best: Column, k: int) -> Column:
    """The first k names, all if k is 0."""
    if k == 1 or k < 0:
        raise ValueError("a shortlist is 0 (all) or at least 2")
    names = F.transform(best, lambda s: s["category"])
    return F.slice(names, 1, k) if k else names


def nearest(docs: DataFrame, examples: DataFrame, k: int, vec: str = "vec", most: int = MAX_SIDE) -> DataFrame:
    """Adds ``nearest``: array<struct<seq, category, (name, snippet,) score>> of the k most similar examples, earlier first on ties.

    Up to ``most`` examples travel as one row, and nothing shuffles; more are dealt in blocks (``knn``).
    """
    if examples.limit(most + 1).count() > most:
        return nearest_by_blocks(docs, examples, k, vec)
    more = [c for c in ("name", "snippet") if c in examples.columns]
    side = examples.select("seq", "category", unit(doubles(F.col("vec"))).alias("vec"), *more)
    out = docs.crossJoin(F.broadcast(as_side(side, "category", "vec", *more, order="seq", name="_examples")))
    shown = ["seq", "category", *more]
    near = let(unit(doubles(F.col(vec))), lambda v: F.array_sort(F.transform("_examples", lambda e: F.struct((-dot(v, e["vec"])).alias("minus"), *[e[c].alias(c) for c in shown]))))
    return out.withColumn("nearest", F.transform(F.slice(near, 1, k), lambda s: F.struct(*[s[c].alias(c) for c in shown], (-s["minus"]).alias("score")))).drop("_examples")


def taught(near: Column, tau: float) -> Column:
    """The category of the nearest example if it is near enough."""
    best = F.get(near, F.lit(0))
    return F.when(best["score"] >= tau, best["category"])


def pairs(docs: DataFrame, key: str = "key", vec: str = "vec", limit: int = 300) -> DataFrame:
    """Similarity of all pairs i < j of a gathered sample; refuses more rows than a sample has."""
    side = as_side(docs.select(F.col(key).alias("i"), unit(doubles(F.col(vec))).alias("vec")), "vec", order="i", name="_all")
    if docs.limit(limit + 1).count() > limit:
        raise ValueError(f"pairs are for samples of at most {limit} rows")
    a = docs.select(F.col(key).alias("i"), unit(doubles(F.col(vec))).alias("v")).crossJoin(F.broadcast(side))
    found = F.transform(F.filter("_all", lambda o: o["i"] > F.col("i")), lambda o: F.struct(o["i"].alias("j"), dot(F.col("v"), o["vec"]).alias("sim")))
    return a.select("i", F.explode(found).alias("p")).select("i", "p.j", "p.sim")


__all__ = ["alternatives", "as_side", "cosine", "margin", "nearest", "nearest_by_blocks", "pairs", "ranked", "ranked_by_blocks", "shortlist", "similar_threshold", "taught"]
