"""Folders as aggregates over listed files: what they hold, and whether they change.

A folder is looked at up to a number of files, in the order of their relative paths, as a walk would that stops there. Small
limits work within each task before anything moves (a limit on rows of a window); for larger ones a folder's files are cut down in
``PARTS`` parts by a hash of the path first. So a folder with most of all files sends no more than a few times the limit on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import extension_key

#: Files of a preview and of a signature; names, extensions and files with an excerpt that are shown, and its length.
LOOKED_AT, SIGNED = 500, 2000
NAMES, KINDS, TRIED, EXCERPT = 15, 8, 20, 400


#: Parts of a folder that are cut down before they meet, and the limit up to which Spark does so by itself.
PARTS, SPARK_LIMIT = 64, 1000


def _first(files: DataFrame, n: int, order: list[str]) -> DataFrame:
    if n > SPARK_LIMIT:
        files = files.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(PARTS)))
        inner = F.row_number().over(Window.partitionBy("folder", "_part").orderBy(*order))
        files = files.withColumn("_inner", inner).where(F.col("_inner") <= n).drop("_inner", "_part")
    place = F.row_number().over(Window.partitionBy("folder").orderBy(*order))
    return files.withColumn("_place", place).where(F.col("_place") <= n)


def signatures(files: DataFrame, order: list[str], many: int = SIGNED) -> DataFrame:
    """folder, n, total and newest of its first ``many`` files and one more, by which a folder that is being written to is known.

    files: folder, size, mtime and the columns of the order.
    """
    return _first(files, many + 1, order).groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.max("mtime").alias("newest"))


def histogram(files: DataFrame, most: int = KINDS) -> DataFrame:
    """folder, ext, n and rank of its most frequent extensions, first seen (by ``_place``) first on ties. Only counts are ranked."""
    kinds = files.groupBy("folder", extension_key(F.col("name")).alias("ext")).agg(F.count(F.lit(1)).alias("n"), F.min("_place").alias("first"))
    return kinds.withColumn("rank", F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("n"), "first"))).where(F.col("rank") <= most).drop("first")


def mixtures(files: DataFrame, most: int = KINDS) -> DataFrame:
    """folder and mixture: its most frequent extensions with their numbers. files: folder, name, _place."""
    shown = F.array_sort(F.collect_list(F.struct("rank", F.concat("ext", F.lit("×"), F.col("n").cast("string")).alias("said"))))
    return histogram(files, most).groupBy("folder").agg(F.array_join(F.transform(shown, lambda x: x["said"]), ", ").alias("mixture"))


def folder_texts(files: DataFrame, order: str = "rel", text: str = "text", readable: Column | None = None, many: int = LOOKED_AT) -> DataFrame:
    """folder and text: how many files of which kinds, their first names, and an excerpt of the first of the leading files that can be read.

    files: folder, name, the relative path to order by, and text (null where there is none to read).

    Defined cases: a null text, one of white space and files that are not readable give no excerpt; rows with equal paths are
    files of their own; a null folder is one; folders without files are not there.
    """
    looked = _first(files, many + 1, [order, "name"])
    said = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))
    usable = (F.col("_place") <= TRIED) & (said != "") & (readable if readable is not None else F.lit(True))
    line = F.concat(F.lit("From "), "name", F.lit(": "), F.substring(said, 1, EXCERPT))
    named = F.transform(F.array_sort(F.collect_list(F.when(F.col("_place") <= NAMES, F.struct("_place", "name")))), lambda x: x["name"])
    whole = looked.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.array_join(named, ", ").alias("names"), F.min_by(F.when(usable, line), F.when(usable, F.col("_place"))).alias("excerpt"))
    both = whole.alias("w").join(mixtures(looked).alias("m"), F.expr("w.folder <=> m.folder")).select("w.*", "m.mixture")
    number = F.when(F.col("n") > many, F.format_string("over %d", F.lit(many))).otherwise(F.col("n").cast("string"))
    return both.select("folder", F.concat_ws("\n", F.concat(number, F.lit(" files: "), "mixture"), F.concat(F.lit("Names: "), "names"), "excerpt").alias("text"))
