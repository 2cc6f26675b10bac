"""Name rules by the thousands: an index of the letters that a glob needs, instead of trying each rule on each name.

A glob can only fit names that hold all its literal parts, so each glob is posted under one of their three-letter grams (shorter ones if
it has no longer part): the one that fewest names hold. Names are cut into grams and joined with the posted globs; only these few are
tried, and the first rule that fits wins. A glob with a gram that no name holds is not tried at all.

Globs without letters (``*``, ``??``, ``[0-9]*``) are tried on every name, in blocks; nothing behind a rule that fits everything counts.
Names are handled once each, however often they stand, and joined back to their rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import glob_regex
from ..runtime import ship, staged

GRAM = 3
#: Globs without letters that are tried in one pass over the names.
BLOCK = 200
_WILD = re.compile(r"\*|\?|\[!?\]?[^\]]*\]")


def grams(glob: str) -> list[str]:
    """The distinct grams of a lower-cased glob's literal parts, all of the longest length there is up to ``GRAM``."""
    parts = [p for p in _WILD.split(glob) if p]
    n = min(GRAM, max(map(len, parts), default=0))
    return sorted({p[i : i + n] for p in parts for i in range(len(p) - n + 1)}) if n else []


def _compile(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        globs = [p.lower() for p in f["glob"]]
        yield pd.DataFrame({"glob": f["glob"], "regex": [glob_regex([g]) for g in globs], "grams": [grams(g) for g in globs], "every": [bool(g) and not g.strip("*") for g in globs]})


def _grams_of(name: Column) -> Column:
    def cut(n: int) -> Column:
        pieces = F.transform(F.sequence(F.lit(1), F.length(name) - (n - 1)), lambda i: F.substring(name, i, F.lit(n)))
        return F.when(F.length(name) >= n, pieces).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[cut(n) for n in range(1, GRAM + 1)]))


def first_fits(names: DataFrame, globs: DataFrame) -> DataFrame:
    """key and ord of the first glob that fits each name; names without one are left out.

    names: key, distinct and lower-cased. globs: ord and glob, in any number, repeated or not.
    """
    spark = names.sparkSession
    ship(spark)
    distinct = globs.where("glob is not null and ord is not null").groupBy("glob").agg(F.min("ord").alias("ord"))
    held = staged(distinct.select("glob").mapInPandas(_compile, "glob string, regex string, grams array<string>, every boolean").join(distinct, "glob"), "globs")
    last = held.where("every").agg(F.min("ord")).first()[0]
    if last is not None:
        held = held.where(F.col("ord") <= last)
    cut = staged(names.select("key", F.explode(_grams_of(F.col("key"))).alias("gram")), "grams")
    number = cut.join(F.broadcast(held.select(F.explode("grams").alias("gram")).distinct()), "gram", "left_semi") if _small(held) else cut
    number = number.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    wanted = held.where(F.size("grams") > 0).select("glob", "ord", "regex", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    posted = wanted.join(number, "gram").groupBy("glob", "ord", "regex", "size").agg(F.count(F.lit(1)).alias("found"), F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    posted = posted.where("found = size").select("gram", "ord", "regex")
    fits = cut.join(posted, "gram").where(F.rlike("key", F.col("regex"))).select("key", "ord")
    plain = held.where(F.size("grams") == 0).orderBy("ord").select("regex", "ord").toLocalIterator()
    found = fits
    while block := [(r["regex"], r["ord"]) for r in islice(plain, BLOCK)]:
        first = F.coalesce(*[F.when(F.col("key").rlike(regex), F.lit(order)) for regex, order in block], F.lit(None))
        found = found.unionByName(names.select("key", first.cast(dict(fits.dtypes)["ord"]).alias("ord")).where("ord is not null"))
    return found.groupBy("key").agg(F.min("ord").alias("ord"))


def _small(globs: DataFrame) -> bool:
    """Whether their grams can travel to every task: a million at most."""
    return (globs.agg(F.sum(F.size("grams"))).first()[0] or 0) <= 1_000_000


def first_rule_join(entries: DataFrame, rules: DataFrame, name: str = "name") -> DataFrame:
    """Adds ``rule``: struct<ord, category, action> of the first rule that fits the name without regard to case, null if none does.

    rules: ord, category, action and ``pattern``, a glob; a rule of several globs has several rows. Rules given by ``regex``, for
    lower-cased names, have no index and are tried on every name.

    Defined cases: a null name has no rule; repeated rows are kept; rules without an ord or pattern are dropped, and of rows with
    one ord the least category and action count; without rules all are null; other columns are kept, one named ``rule`` is replaced.
    """
    entries = entries.drop("rule")
    shown = F.struct("ord", "category", "action")
    known = rules.where("ord is not null").groupBy("ord").agg(F.min(F.struct("category", "action")).alias("r")).select("ord", "r.*")
    key = F.lower(F.col(name))
    names = staged(entries.select(key.alias("key")).where("key is not null").distinct(), "names")
    if "pattern" in rules.columns:
        best = first_fits(names, rules.select("ord", F.col("pattern").alias("glob")))
    else:
        tried = rules.where("ord is not null and regex is not null").orderBy("ord").select("regex", "ord").toLocalIterator()
        kind = dict(rules.dtypes)["ord"]
        best = names.select("key", F.lit(None).cast(kind).alias("ord"))
        while block := [(r["regex"], r["ord"]) for r in islice(tried, BLOCK)]:
            best = staged(best.withColumn("ord", F.coalesce("ord", *[F.when(F.col("key").rlike(regex), F.lit(order)) for regex, order in block]).cast(kind)), "tried")
        best = best.where("ord is not null")
    best = best.join(known, "ord").select(F.col("key").alias("_rule_key"), shown.alias("rule"))
    return entries.join(best, key == F.col("_rule_key"), "left").drop("_rule_key")
