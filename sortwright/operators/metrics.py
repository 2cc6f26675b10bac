"""Accuracy, margin sweeps and leave-one-out selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accuracy(rows: DataFrame, truth: str = "truth", pick: str = "category") -> DataFrame:
    """n, correct, invalid (no pick) and accuracy."""
    good = F.count_if(F.col(truth) == F.col(pick))
    return rows.agg(F.count(F.lit(1)).alias("n"), good.alias("correct"), F.count_if(F.col(pick).isNull()).alias("invalid"), (good / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("accuracy"))


def margin_sweep(rows: DataFrame, margins: list[float]) -> DataFrame:
    """For each margin: rows decided alone and how well, rows escalated and whether the truth is among their first 2 or 3.

    rows: margin, at (the rank of the truth). One pass: a column of sums for each margin.
    """
    sums = []
    for i, m in enumerate(margins):
        alone = F.col("margin") >= m
        sums.append(F.struct(
            F.lit(m).alias("threshold"), F.count_if(alone).alias("decided"), F.count_if(alone & (F.col("at") == 1)).alias("right"), F.count_if(~alone).alias("escalated"),
            F.count_if(~alone & (F.col("at") <= 2)).alias("in2"), F.count_if(~alone & (F.col("at") <= 3)).alias("in3"),
        ))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return rows.agg(F.array(*sums).alias("s")).select(F.explode("s").alias("s")).select("s.*").select(
        "threshold", "decided", share("right", "decided").alias("accuracy_when_decided"), "escalated", share("in2", "escalated").alias("recall_top2"), share("in3", "escalated").alias("recall_top3")
    )


def leave_one_out(rows: DataFrame, key: str, label: str, k: int) -> DataFrame:
    """key and example: for each row, the first k others of its label.

    The first k + 1 of a label hold the answer for all its rows, so only they are joined.
    """
    first = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(label).orderBy(key))).where(F.col("_rank") <= k + 1).groupBy(label).agg(F.array_sort(F.collect_list(key)).alias("_first"))
    others = F.slice(F.filter("_first", lambda x: x != F.col(key)), 1, k)
    return rows.join(first, label).select(key, F.explode(others).alias("example"))


def latency(embed_seconds: Column, escalated: Column, n: Column, model_seconds: Column) -> Column:
    """Seconds a file when only the escalated share pays for the model."""
    return embed_seconds + escalated / n * model_seconds


def worst_of_one_taught(rows: DataFrame) -> DataFrame:
    """worst_accuracy: the lowest accuracy over all categories when the examples of one category alone are taught.

    rows: truth, ranked (without examples) and boosted (with all). A category's examples change its own score alone, so its run takes
    the boosted score there and the plain ones elsewhere: all runs come from one pass, and only a count for each category moves.
    Ties go to the lower number of a category.
    """
    def first(t: Column) -> Column:
        scored = F.transform("ranked", lambda r: F.struct((-F.when(r["category"] == t["category"], t["score"]).otherwise(r["score"])).alias("minus"), r["category"].cast("int").alias("category")))
        return F.array_min(scored)["category"]

    runs = rows.select("truth", F.explode(F.transform("boosted", lambda t: F.struct(t["category"].alias("taught"), first(t).alias("category")))).alias("r"))
    accuracy = runs.groupBy("r.taught").agg((F.count_if(F.col("truth") == F.col("r.category")) / F.count(F.lit(1))).alias("a"))
    return accuracy.agg(F.min("a").alias("worst_accuracy"))
