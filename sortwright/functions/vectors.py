"""Vector arithmetic as column expressions, in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """The longer vector's tail counts as zero."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector has no length."""
    return let(norm(a) * norm(b), lambda n: F.when(n > 0, dot(a, b) / n).otherwise(0.0))


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    return let(norm(a), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a))


def mean_vectors(df: DataFrame, by: list[str], vec: str, out: str = "centre", normalised: bool = False) -> DataFrame:
    """The mean vector of each group: partial sums by position move, not vectors."""
    source = unit(doubles(F.col(vec))) if normalised else doubles(F.col(vec))
    places = df.select(*by, F.posexplode(source).alias("_pos", "_x")).groupBy(*by, "_pos").agg(F.avg("_x").alias("_x"))
    centre = F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_x"))), lambda s: s["_x"])
    found = places.groupBy(*by).agg(centre.alias(out))
    return found.withColumn(out, unit(F.col(out))) if normalised else found


def key_of(model: str, text: Column) -> Column:
    """The 24-digit content key of a text under a model."""
    return F.substring(F.sha2(F.concat(F.lit(model), F.lit("\0"), text), 256), 1, 24)
