"""Naming groups of similar files with a model, a row a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import clean_path
from ..functions.text import trim
from ..models import Backend, generate_column, naming_schema

#: Members that are shown, and characters of each.
SHOWN, EXCERPT = 8, 220
FALLBACK = "Unsorted/Group"


def prompts(members: DataFrame, taxonomy: DataFrame, least: int = 2) -> DataFrame:
    """cluster, n, members (paths, most central first), system and user of each group of at least ``least`` members.

    members: cluster, rank, path, name, text. taxonomy: category and description, in order of ``ord``; without
    rows there is nothing to fit into.
    """
    line = F.concat(F.lit("- "), F.coalesce("name", F.lit("")), F.lit(": "), F.substring(trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), 1, EXCERPT))
    groups = members.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("rank", "path"))).alias("_m"), F.array_sort(F.collect_list(F.when(F.col("rank") <= SHOWN, F.struct("rank", line.alias("line"))))).alias("_l"))
    known = taxonomy.agg(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.lit("- "), "category", F.lit(": "), "description").alias("line")))).alias("_known"))
    shown = lambda c: F.array_join(F.transform(c, lambda x: x["line"]), "\n")
    table = F.when(F.size("_known") > 0, shown("_known")).otherwise("(none yet)")
    n = F.size("_m")
    return groups.where(n >= least).crossJoin(F.broadcast(known)).select(
        "cluster", n.alias("n"), F.transform("_m", lambda m: m["path"]).alias("members"),
        F.concat(F.lit("Name one folder for a group of similar files, an existing one if it fits.\nExisting:\n"), table).alias("system"),
        F.concat(n.cast("string"), F.lit(" files. Typical ones:\n"), shown("_l")).alias("user"),
    )


def named(members: DataFrame, taxonomy: DataFrame, backend: Backend, least: int = 2) -> DataFrame:
    """cluster, n, members, path, description, existing and failed: the category that fits, or a new path that is cleaned; groups whose
    model failed have no path but the reason. The description of an existing category is its own."""
    known = [r["category"] for r in taxonomy.orderBy("ord").select("category").collect()]  # goes into the answer's schema
    asked = prompts(members, taxonomy, least)
    parts = max(1, min(asked.sparkSession.sparkContext.defaultParallelism, 64))
    said = generate_column(asked.repartition(parts, "cluster"), backend, naming_schema(known))
    said = said.withColumn("_a", F.from_json("answer", "fits_existing string, path string, description string"))
    fits = F.when(F.array_contains(F.array(*[F.lit(c) for c in known]).cast("array<string>"), F.col("_a.fits_existing")), F.col("_a.fits_existing"))
    new = F.coalesce(F.nullif(clean_path(F.col("_a.path")), F.lit("")), F.lit(FALLBACK))
    own = said.withColumns({"existing": fits.isNotNull(), "path": F.when(F.col("failed").isNull(), F.coalesce(fits, new))})
    told = taxonomy.select(F.col("category").alias("path"), F.col("description").alias("_told"))
    like = F.concat(F.lit("Files like "), F.regexp_replace(F.get("members", F.lit(0)), "^.*/", ""))
    about = F.coalesce("_told", F.nullif(F.col("_a.description"), F.lit("")), like)
    return own.join(told, "path", "left").select("cluster", "n", "members", "path", about.alias("description"), "existing", "failed")
