"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets share all words by weight, are capped at ``most`` times the source, and share out again
what lies above a cap: target = min(cap, level * weight), where the level is the highest of those reached
when the sources with the lowest caps per weight are set aside one by one.

A source is taken whole as many times as its target holds it, and then in part: documents in
ascending order of an exponential key scaled by their quality weight, up to the rest of the
target. The one document that straddles it is taken if at least half of it fits.

No window covers a source: keys are cut into buckets of about ``ROWS`` documents by a monotone
function, sums run over bucket totals and within buckets. One row per source (not per document)
meets in one task to rank sources and find the level.

Defined cases: a null text has size 0 and takes nothing; a null source is a source, last in order;
rows with the same id draw the same number, those without one draw by their text, and equal keys are ordered by id, size and text hash,
so reruns agree; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._native import WORD, count
from ._stage import Workspace

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix"
ROWS = 4096


def quality_weight(text: Column) -> Column:
    """Between 0.1 and 1: the fewer symbols and exclamation marks, the higher."""
    return F.greatest(F.lit(0.1), 1 - 4.0 * count(text, "[#*$%&|<>!]") / F.greatest(F.length(F.coalesce(text, F.lit(""))), F.lit(1)))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size and target, from one row of source and source_size per source."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * float(most))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    whole = Window.partitionBy()
    level = ranked.withColumn("level", (F.sum("source_size").over(whole) - before) / rest).withColumn("level", F.max("level").over(whole))
    return level.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED, quality: Column | None = None) -> DataFrame:
    """One row per document: doc_id, size (words), source, source_size, target, times, taken (words, repeats counted) and tie (a hash of the text)."""
    spark = docs.sparkSession
    work = Workspace(spark, "mixing")
    content = F.col(text).cast("string")
    drawn = F.coalesce(F.col(doc_id).cast("string"), F.md5(F.coalesce(content, F.lit(""))))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), drawn)), 1, 13), 16, 10).cast("double")
    rows = work.save(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), count(content, WORD).alias("size"),
            (-F.log((draw + 1) / 2.0**52) / (quality if quality is not None else quality_weight(content))).alias("key"), F.xxhash64(content).alias("tie"),
        ),
        "rows",
    )
    stats = work.save(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"), F.avg("key").alias("scale")), "sources")
    goal = targets(stats.select("source", "source_size"), weights, most).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goal = goal.alias("g").join(stats.select("source", "n", "scale").alias("s"), F.expr("g.source <=> s.source")).select("g.*", "n", "scale")
    goal = work.save(goal, "targets")
    rows, goal = rows.alias("r"), goal.alias("g")
    joined = rows.join(goal, F.expr("r.source <=> g.source")).select(
        "r.*", "source_size", "target", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"),
        # Roughly the share of smaller keys: monotone, so buckets are stretches of the order.
        F.floor((1 - F.exp(-F.col("key") / F.greatest("scale", F.lit(1e-300)))) * F.ceil(F.col("n") / ROWS)).alias("bucket"),
    )
    total = joined.groupBy("source", "bucket").agg(F.sum("size").alias("total"))
    before = total.select("source", "bucket", F.coalesce(F.sum("total").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    joined, before = joined.alias("j"), before.alias("b")
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = joined.join(before, F.expr("j.source <=> b.source and j.bucket = b.bucket")).select("j.*", "before").withColumn("upto", F.col("before") + F.sum("size").over(within))
    partly = F.when(2 * F.col("upto") - F.col("size") <= 2 * F.col("rest"), 1).otherwise(0)
    times = F.col("epochs") + F.when(F.col("epochs") < most, partly).otherwise(0)
    return run.withColumn("times", times.cast("long")).select("doc_id", "size", "source", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"), "tie")


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken.

    Rows are told apart by id, source and text. Equal ones are taken equally often, but for those at the end of a source's target (one
    group a source at most), of which the first few in any order are taken once more.
    """
    plan = mix(docs, doc_id=doc_id, text=text, source=source, **options).groupBy("doc_id", "source", "tie").agg(F.min("times").alias("least"), F.sum("times").alias("times"), F.count(F.lit(1)).alias("n"))
    plan = plan.where("times > 0").select(F.col("doc_id").alias("_mix_id"), F.col("source").alias("_mix_source"), F.col("tie").alias("_mix_tie"), F.col("least").alias("_mix_least"), (F.col("times") - F.col("least") * F.col("n")).alias("_mix_more"))
    same = docs[doc_id].cast("long").eqNullSafe(F.col("_mix_id")) & docs[source].cast("string").eqNullSafe(F.col("_mix_source")) & F.xxhash64(docs[text].cast("string")).eqNullSafe(F.col("_mix_tie"))
    joined = docs.join(plan, same)
    rank = F.row_number().over(Window.partitionBy("_mix_id", "_mix_source", "_mix_tie").orderBy("_mix_more"))
    ends = joined.where("_mix_more > 0").withColumn("_mix_times", F.col("_mix_least") + (rank <= F.col("_mix_more")).cast("long"))
    every = joined.where("_mix_more = 0").withColumn("_mix_times", F.col("_mix_least")).unionByName(ends)
    return every.where("_mix_times > 0").withColumn("_mix_time", F.explode(F.sequence(F.lit(1), F.col("_mix_times").cast("int")))).select(*docs.columns)
