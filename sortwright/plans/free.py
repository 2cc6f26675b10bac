"""Names that overwrite nothing: ``a.txt``, then ``a (2).txt``, ``a (3).txt``, ... as if items came one by one.

An item keeps its name if neither a taken name nor an earlier item has it; otherwise it is numbered with the first free integer. Numbered
names may themselves be names of items or taken, so the two compete: who comes first has the name.

Names are handled by level, the number of `` (n)`` groups in them: numbering a name of one level gives one of the
next, so each level only depends on the one before. Within a level, for each family (folder, stem, extension):

1. the surplus are the rows behind the first of a name, and firsts that lost their name to a numbered one;
2. a number that some name of the next level has is blocked, if that name is there before the family's numbering gets to it.
   With x blocked numbers below k and c surplus rows earlier than that name, it is iff x < k - 1 - c: a scan over the numbers in order with x as its only state;
3. the j-th of the surplus has the j-th free number: j + 1 and the blocked ones whose gap search ends before it.

Ranks come from counts by spans of positions and windows within a span, so a name that a third of all rows bear is
not one task's work. The scan streams distinct numbered names of a family in order and holds none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import suffix
from ..operators.rules import numbered
from ..runtime import ship, staged

#: Positions in one window.
SPAN = 1 << 16
_GROUP = r" \(\d+\)"
_FAMILY = ["_dir", "_stem", "_ext"]


def extension(name: Column) -> Column:
    """The extension as it is written."""
    return F.substring(name, F.length(name) - F.length(suffix(name)) + 1, F.length(suffix(name)))


def _before(rows: DataFrame, at: str, span: int) -> DataFrame:
    """Adds ``before``: the sum of ``counted`` over a family's rows in front, by ``at`` and then counted ones first."""
    rows = rows.withColumn("_span", F.floor(F.col(at) / span))
    spans = Window.partitionBy(*_FAMILY).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*_FAMILY, "_span").agg(F.sum("counted").alias("_sum"))
    totals = totals.select(*_FAMILY, "_span", F.coalesce(F.sum("_sum").over(spans), F.lit(0)).alias("_above"))
    within = Window.partitionBy(*_FAMILY, "_span").orderBy(at, F.desc("counted")).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("_within", F.coalesce(F.sum("counted").over(within), F.lit(0)))
    return inside.join(totals, [*_FAMILY, "_span"]).withColumn("before", F.col("_above") + F.col("_within")).drop("_span", "_above", "_within")


def _parsed(names: DataFrame) -> DataFrame:
    """The families that could have given a name its number: with its extension, and without one."""
    number = r"^(.+) \(([1-9]\d{0,17})\)$"
    ext = extension(F.col("_name"))
    with_ext = names.withColumn("_ext", ext).where("_ext <> ''").withColumn("_plain", F.substring("_name", F.lit(1), F.length("_name") - F.length("_ext")))
    without = names.withColumn("_ext", F.lit("")).withColumn("_plain", F.col("_name"))
    both = with_ext.unionByName(without).withColumn("_stem", F.regexp_extract("_plain", number, 1)).where("_stem <> ''").withColumn("k", F.regexp_extract("_plain", number, 2).cast("long"))
    return both.where((F.col("k") >= 2) & ((F.col("_ext") == "") | (extension(F.concat("_stem", "_ext")) == F.col("_ext")))).drop("_plain")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which numbers are blocked, and how many below each; rows come by family and number."""
    family, x = None, 0
    for batch in batches:
        blocked, below = [], []
        for *own, k, c in zip(*(batch.column(n).to_pylist() for n in (*_FAMILY, "k", "before"))):
            if own != family:
                family, x = own, 0
            below.append(x)
            blocked.append(x < k - 1 - c)
            x += blocked[-1]
        yield pa.record_batch([*(batch.column(n) for n in ("_dir", "_name", "_stem", "_ext", "k")), pa.array(blocked, pa.bool_()), pa.array(below, pa.int64())], names=["_dir", "_name", "_stem", "_ext", "k", "blocked", "below"])


def _one_by_one(rows: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
    used, reached, out = set(there["_name"]), {}, []
    for row in rows.sort_values("_pos").itertuples(index=False):
        name, n = row[1], 1
        if name in used:
            stem, ext = row[2], row[3]
            n = reached.get((stem, ext), 2)
            while f"{stem} ({n}){ext}" in used:
                n += 1
            reached[stem, ext] = n + 1
            name = f"{stem} ({n}){ext}"
        used.add(name)
        out.append((row[0], n))
    return pd.DataFrame(out, columns=["_pos", "n"])


def free_names(items: DataFrame, folder: str, name: str, order: str, taken: DataFrame | None = None, kind: str | None = None, span: int = SPAN) -> DataFrame:
    """Adds ``free_name``, unique within a folder among the items and the taken names.

    order: a column in which no two rows are equal. taken: rows of folder and name already there, in any number. kind: a column
    that is ``folder`` for items whose name has no extension.

    Defined cases: a null name stays null, rows with a null folder share one; equal rows are rows of their own;
    other columns are kept; an empty table gives an empty result. Where a name of a
    folder ends in an extension that holds `` (n)`` itself, names could be numbered in two ways into the same one: those that
    share its letters are handled one by one in one group.
    """
    spark = items.sparkSession
    ship(spark)
    whole = F.col(name)
    ext = extension(whole) if kind is None else F.when(F.col(kind) == "folder", "").otherwise(extension(whole))
    place = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    # The item travels as one column, so its own columns may have any names.
    rows = items.select(F.struct(*[F.col(f"`{c}`") for c in items.columns if c != "free_name"]).alias("_item"), F.col(order).alias("_order"), place(F.col(folder)).alias("_dir"), whole.alias("_name"), ext.alias("_ext"))
    rows = numbered(rows, "_order", "_pos")
    rows = rows.withColumns({"_stem": F.substring("_name", F.lit(1), F.length("_name") - F.length("_ext")), "_level": F.regexp_count("_name", F.lit(_GROUP)), "_letters": F.regexp_replace("_name", _GROUP, "")})
    rows = staged(rows, "names")
    there = rows.select("_dir", "_name", "_pos")
    if taken is not None:
        there = there.unionByName(taken.select(place(F.col(folder)).alias("_dir"), F.col(name).alias("_name"), F.lit(-1).cast("long").alias("_pos")))
    held = staged(there.where("_name is not null").groupBy("_dir", "_name").agg(F.min("_pos").alias("_first")).withColumn("_level", F.regexp_count("_name", F.lit(_GROUP))), "held")
    odd = rows.where(F.col("_ext").rlike(_GROUP)).select("_dir", "_letters").distinct()
    usual, solved = rows, []
    if not odd.isEmpty():
        odd = staged(odd, "odd")
        usual = rows.join(odd, ["_dir", "_letters"], "left_anti")
        own = rows.join(odd, ["_dir", "_letters"], "left_semi").select("_pos", "_name", "_stem", "_ext", "_dir", "_letters")
        before = held.where("_first = -1").select("_name", "_dir", F.regexp_replace("_name", _GROUP, "").alias("_letters"))
        solved.append(own.groupBy("_dir", "_letters").cogroup(before.groupBy("_dir", "_letters")).applyInPandas(lambda a, b: _one_by_one(a, b), "_pos long, n long"))
    lost, last = None, None
    for level in sorted(r["_level"] for r in usual.where("_name is not null").select("_level").distinct().collect()):
        keeps = held.where(F.col("_level") == level)
        if lost is not None and last == level - 1:
            keeps = keeps.join(lost, ["_dir", "_name"], "left_anti")
        surplus = usual.where(F.col("_level") == level).join(keeps.select("_dir", "_name", "_first"), ["_dir", "_name"], "left").where("_first is null or _pos <> _first").select(*_FAMILY, "_pos")
        surplus = staged(surplus, "surplus")
        numbers = _parsed(held.where(F.col("_level") == level + 1)).join(surplus.select(*_FAMILY).distinct(), _FAMILY, "left_semi")
        both = surplus.select(*_FAMILY, "_pos", F.lit(None).cast("string").alias("_name"), F.lit(None).cast("long").alias("k"), F.lit(1).alias("counted")).unionByName(
            numbers.select(*_FAMILY, F.col("_first").alias("_pos"), "_name", "k", F.lit(0).alias("counted"))
        )
        ranked = staged(_before(both, "_pos", span), "ranked")
        scanned = ranked.where("k is not null").select(*_FAMILY, "_name", "k", "before").repartition(*_FAMILY).sortWithinPartitions(*_FAMILY, "k")
        scanned = staged(scanned.mapInArrow(_scan, "_dir string, _name string, _stem string, _ext string, k long, blocked boolean, below long"), "numbers")
        lost, last = scanned.where("not blocked").select("_dir", "_name").distinct(), level
        gaps = ranked.where("k is null").select(*_FAMILY, "_pos", (F.col("before") + 1).alias("j"), F.lit(0).alias("counted")).unionByName(
            scanned.where("blocked").select(*_FAMILY, F.lit(None).cast("long").alias("_pos"), (F.col("k") - 1 - F.col("below")).alias("j"), F.lit(1).alias("counted"))
        )
        solved.append(_before(gaps, "j", span).where("counted = 0").select("_pos", (F.col("j") + 1 + F.col("before")).cast("long").alias("n")))
    every = reduce(DataFrame.unionByName, solved, rows.select("_pos", F.lit(1).cast("long").alias("n")).limit(0))
    out = rows.join(every, "_pos", "left")
    shown = F.when(F.coalesce("n", F.lit(1)) == 1, F.col("_name")).otherwise(F.concat("_stem", F.lit(" ("), F.col("n").cast("string"), F.lit(")"), "_ext"))
    return out.select("_item.*", shown.alias("free_name"))
