"""Name rules, ignore lists, owned folders, and the first filters of a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import matches
from ..runtime import staged
from .ruleindex import first_rule_join


def first_rule(name: Column, rules: list) -> Column:
    """struct<ord, category, action, patterns> of the first rule whose globs fit; null if none does."""
    kind = "struct<ord:int,category:string,action:string,patterns:array<string>>"
    out = F.lit(None).cast(kind)
    for i, rule in reversed(list(enumerate(rules))):
        found = F.struct(F.lit(i).alias("ord"), F.lit(rule.category).cast("string").alias("category"), F.lit(rule.action).alias("action"), F.array(*[F.lit(p) for p in rule.patterns]).alias("patterns"))
        out = F.when(matches(name, rule.patterns), found).otherwise(out)
    return out


def not_ignored(name: Column, ignore: list[str]) -> Column:
    return ~matches(name, ignore) if ignore else F.lit(True)


def without_owned(entries: DataFrame, owned: DataFrame, name: str = "name") -> DataFrame:
    """Drops the top-level names that the plan's own folders have."""
    return entries.join(owned.select(F.col(owned.columns[0]).alias(name)), name, "left_anti")


def visible_within(rel: Column, depth: int = 4) -> Column:
    """Not hidden in any part, and at most depth parts."""
    return (F.size(F.split(rel, "/")) <= depth) & ~rel.rlike(r"(^|/)\.")


def even_sample(df: DataFrame, order: str, limit: int) -> DataFrame:
    """limit rows at even steps of the order: the i-th is row floor(i * n / limit); all rows if they are no more.

    Positions come from counts per range partition and a number within it, so no task sees all rows.
    """
    n = df.count()
    if n <= limit:
        return df
    wanted = df.sparkSession.range(limit).select(F.floor(F.col("id") * F.lit(n) / F.lit(limit)).alias("_at"))
    return numbered(df, order, "_at").join(F.broadcast(wanted), "_at").drop("_at")


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """Adds the row number (from 0) in the order of a column, nulls first, without a global window.

    Rows are dealt by ranges of the order and written down with their range, so ranges are counted and numbered from the same rows.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    put = staged(df.repartitionByRange(parts, order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = put.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # one row for each range
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return put.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1).drop("_range", "_before")


def review(category: Column, confidence: Column, least: float = 0.55) -> Column:
    """Unsure: no category, or confidence (not yet rounded) below the least."""
    return category.isNull() | (confidence < least)


__all__ = ["even_sample", "first_rule", "first_rule_join", "not_ignored", "numbered", "review", "visible_within", "without_owned"]
