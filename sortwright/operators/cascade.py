"""The cascade: rules, cache, ranking, then the model for what is left.

Stages are split by filters and put together again by union, since a model call inside a
conditional would run for every row. What a model returned is written down before it is
read twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import let
from .rank import alternatives, margin, shortlist, taught
from .rules import review

VERDICT = ("category", "confidence", "via", "alternatives", "reason")


@dataclass(frozen=True)
class Settings:
    mode: str = "hybrid"
    margin: float = 0.04
    shortlist: int = 0
    tau: float = 0.62
    min_confidence: float = 0.55

    def __post_init__(self) -> None:
        if self.mode not in ("hybrid", "llm", "embed"):
            raise ValueError(f"mode is hybrid, llm or embed, not {self.mode!r}")
        if self.shortlist == 1 or self.shortlist < 0:
            raise ValueError("a shortlist is 0 (all) or at least 2")


def is_clear(lead: Column, readable: Column, has_image: Column, least: float = 0.04) -> Column:
    """The ranking decides alone: a lead, readable text, and no picture that only a model can see."""
    return (lead >= least) & readable & ~has_image


def by_rule(entries: DataFrame) -> DataFrame:
    """Verdicts of files with a rule (column ``rule``); folders have none."""
    r = F.col("rule")
    skip = r["action"] == "skip"
    return entries.where("rule is not null and kind = 'file'").select(
        "*", F.when(~skip, r["category"]).alias("category"), F.lit(1.0).alias("confidence"), F.when(skip, "skip").otherwise("rule").alias("via"),
        F.array().cast("array<string>").alias("alternatives"), F.concat(F.lit("rule: "), F.array_join(F.slice(r["patterns"], 1, 3), ", ")).alias("reason"),
    )


def by_cache(entries: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits with their first verdict, via the cache; and the rows without one."""
    held = cache.select("key", *[F.col(c) for c in VERDICT if c != "via"])
    return entries.join(held, "key").withColumn("via", F.lit("cache")), entries.join(cache.select("key"), "key", "left_anti")


def by_rank(rows: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """What the ranking decides, and the residual for the model."""
    lead = margin(F.col("ranked"))
    clear = is_clear(lead, F.col("readable"), F.col("image").isNotNull(), s.margin)
    rows = rows.withColumn("_clear", clear)
    decided = rows if s.mode == "embed" else rows.where("_clear")
    unread = ~F.col("readable") & F.col("image").isNull()
    verdicts = decided.select(
        "*", F.get("ranked", F.lit(0))["category"].alias("category"),
        F.when(unread, 0.2).when(F.col("_clear"), 0.9).otherwise(0.5).alias("confidence"), F.lit("embed").alias("via"),
        alternatives(F.col("ranked")).alias("alternatives"), F.format_string("closest match (margin %.3f)", lead).alias("reason"),
    ).drop("_clear")
    rest = rows.where("false") if s.mode == "embed" else rows.where("not coalesce(_clear, false)")
    return verdicts, rest.drop("_clear")


def with_choices(rows: DataFrame, taxonomy: list[str], s: Settings) -> DataFrame:
    """Adds ``choices`` in rank order, or in taxonomy order without a ranking; pictures skip the shortlist."""
    if s.mode == "llm":
        every = F.array(*[F.lit(c) for c in taxonomy])
        return rows.withColumn("choices", F.when(F.col("image").isNull() & F.lit(s.shortlist > 0), F.slice(every, 1, max(s.shortlist, 1))).otherwise(every))
    return rows.withColumn("choices", F.when(F.col("image").isNull(), shortlist(F.col("ranked"), s.shortlist)).otherwise(shortlist(F.col("ranked"), 0)))


def parse_choice(answer: Column, choices: Column) -> Column:
    """struct<category, reason> of a model's reply: JSON, or the first object in it; the name exact, else without
    case and signs (the last such choice); null if it is none of them."""
    plain = lambda c: F.lower(F.regexp_replace(c, r"(?U)\W", ""))
    inner = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    said = F.struct(*[F.coalesce(F.get_json_object(answer, f"$.{k}"), F.get_json_object(inner, f"$.{k}")).alias(k) for k in ("category", "reason")])

    def picked(s: Column) -> Column:
        loose = let(plain(s["category"]), lambda name: F.try_element_at(F.filter(choices, lambda c: plain(c) == name), F.lit(-1)))
        return F.struct(F.when(F.array_contains(choices, s["category"]), s["category"]).otherwise(loose).alias("category"), F.substring(F.coalesce(s["reason"], F.lit("")), 1, 300).alias("reason"))

    return let(said, picked)


def by_model(rows: DataFrame, s: Settings, stats: str = "picked") -> DataFrame:
    """Verdicts of rows with ``picked`` (struct<category, reason>), ``choices`` and, if examples exist, ``nearest``."""
    pick, picture = F.col(f"{stats}.category"), F.col("image").isNotNull()
    unread = ~F.col("readable") & ~picture
    like = taught(F.col("nearest"), s.tau) if "nearest" in rows.columns and s.mode != "llm" else F.lit(None).cast("string")
    agreed = F.coalesce(like == pick, F.lit(False))
    confidence = F.when(pick.isNull(), 0.0).when(unread & agreed, 0.8).when(unread, 0.25).when(picture, 0.7)
    if s.mode == "llm":
        confidence = confidence.otherwise(0.7)
    else:
        confidence = confidence.when(pick == F.get("ranked", F.lit(0))["category"], 0.8).otherwise(0.6)
    others = F.slice(F.filter("choices", lambda c: pick.isNull() | (c != pick)), 1, 3)
    return rows.select(
        "*", pick.alias("category"), confidence.alias("confidence"), F.when(picture, "vision").otherwise("llm").alias("via"), others.alias("alternatives"),
        F.when(pick.isNull(), "model gave no valid category").otherwise(F.col(f"{stats}.reason")).alias("reason"),
    )


def finish(verdicts: DataFrame, fallback: str, least: float = 0.55) -> DataFrame:
    """Adds ``review``; rows that a model left open get their first alternative; confidence is rounded last."""
    skipped = F.col("via") == "skip"
    unsure = review(F.col("category"), F.col("confidence"), least) & ~skipped
    filled = F.when(skipped, F.lit(None).cast("string")).otherwise(F.coalesce("category", F.get("alternatives", F.lit(0)), F.lit(fallback)))
    return verdicts.withColumn("review", unsure | (F.col("via") == "error")).withColumn("category", filled).withColumn("confidence", F.bround("confidence", 2))


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def decide(rows: DataFrame, taxonomy: list[str], s: Settings, choose: Callable[[DataFrame], DataFrame], save: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Verdicts of previewed rows: readable, image, and ``ranked`` unless the mode is llm.

    choose: adds ``picked`` to rows with ``choices``. save: writes a stage down and reads it again.
    """
    decided, rest = (None, rows) if s.mode == "llm" else by_rank(rows, s)
    if s.mode == "embed":
        return decided
    answered = by_model(save(choose(with_choices(rest, taxonomy, s)), "answers"), s)
    return union([p for p in (decided, answered) if p is not None])
