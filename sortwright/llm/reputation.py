"""URL filtering by empirical-Bayes host reputation.

Labelled page outcomes are counted by host; a host's rate of good pages is shrunk towards its registered
domain's, that towards its suffix's, and that towards the overall rate. The strength of each
prior is the beta-binomial moment estimate from the spread of rates at that level. A host's rate then has a
beta posterior; the host is blocked when at least ``sure`` of it lies below ``floor``, that is, when its upper
``sure`` quantile does. So a host without outcomes is judged by what its domain and suffix say, as long as its
suffix has outcomes at all. Stated rules come first.

The share below the floor is an integral over log odds by Simpson's rule (see ``below``), not a normal
approximation, so it also holds for few outcomes. Ports are no part of a domain. Public suffixes are the last
label, or the last two where a country's second level registers names (``SECOND_LEVEL``).

Counts are summed per host before they move, and only host rows meet at domains and suffixes; each level is
written down. Hosts with a large share of all pages are joined by broadcast (see ``_skew``).

Defined cases: a null url, or one without ``://``, has the empty host and path, fits no rule and is judged
like any host; pages without an outcome only take verdicts; null outcomes are left out; repeated
pages each get a row and their outcome counts each time; other columns are ignored;
without any outcome every host is allowed; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._native import let
from ._skew import join_counted
from ._stage import Workspace

#: (action, host, path); a rule's text is host and path together.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Second-level names under which two-letter suffixes register domains.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
FLOOR = 0.5
SURE = 0.95
#: Steps of the integral on each side of the floor, and how far it reaches in standard deviations.
STEPS = 64
REACH = 12.0

_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def bare(host: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(host, "^[^@]*@|:[0-9]*$", "")


def suffix_of(host: Column) -> Column:
    host = bare(host)
    part = F.split(host, r"\.")
    long = (F.size(part) > 2) & (F.length(F.element_at(part, -1)) == 2) & F.element_at(part, F.when(F.size(part) > 1, -2).otherwise(-1)).isin(*SECOND_LEVEL)
    return F.when(long, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one name before it."""
    host = bare(host)
    short = F.length(suffix_of(host)) == F.length(F.substring_index(host, ".", -1))
    return F.when(short, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -3))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text and action; null if none fits."""
    text = action = F.lit(None).cast("string")
    for what, where, begin in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == where) | host.endswith("." + where)) & path.startswith(begin)
        text, action = F.when(fits, F.lit(where + begin)).otherwise(text), F.when(fits, F.lit(what)).otherwise(action)
    return text, action


def _strength(level: DataFrame) -> Column:
    """The prior's weight in pages, between 1 and 1000, from n, s and the parent's mean."""
    off = F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("parent"), 2) / (F.col("parent") * (1 - F.col("parent")))
    rho = (F.sum(F.when(F.col("n") > 0, off)) - F.count(F.when(F.col("n") > 0, 1))) / F.nullif(F.sum(F.when(F.col("n") > 0, F.col("n") - 1)), F.lit(0))
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(0.0)), F.lit(1 / 1001)), F.lit(0.5))
    return (1 / rho - 1).alias("k")


def _shrink(level: DataFrame, work: Workspace, name: str) -> DataFrame:
    """Adds k and the posterior mean of each row, and writes the level down; one row of k is joined back."""
    held = work.save(level, f"{name}-counts")
    strength = F.broadcast(held.agg(_strength(held)))
    return work.save(held.crossJoin(strength).withColumn("mean", (F.col("s") + F.col("k") * F.col("parent")) / (F.col("n") + F.col("k"))), name)


def below(a: Column, b: Column, floor: float = FLOOR, steps: int = STEPS) -> Column:
    """The share of a beta distribution that lies below floor.

    Over log odds x its density is exp(a x - (a + b) log(1 + exp(x))), concave in the exponent. Both sides of the floor are
    summed by Simpson's rule as far as ``REACH`` deviations from the mode, and beyond 30 in x by the exponential tails.
    """
    cut = math.log(floor / (1 - floor))
    mode, wide = F.log(a / b), REACH * F.sqrt(1 / a + 1 / b)
    log1p = lambda x: F.when(x > 0, x + F.log1p(F.exp(-x))).otherwise(F.log1p(F.exp(x)))
    at = lambda x, p: F.exp(p["a"] * (x - p["mode"]) - (p["a"] + p["b"]) * (log1p(x) - log1p(p["mode"])))

    def side(p: Column, low: Column, high: Column) -> Column:
        h = (high - low) / steps
        total = F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda t, i: t + at(low + h * i, p) * F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0))
        return F.when(high > low, total * h / 3).otherwise(0.0)

    def share(p: Column) -> Column:
        left = F.least(F.lit(cut), F.greatest(p["mode"] - p["wide"], F.lit(-30.0)))
        right = F.greatest(F.lit(cut), F.least(p["mode"] + p["wide"], F.lit(30.0)))
        under = side(p, left, F.greatest(left, F.least(F.lit(cut), p["mode"] + p["wide"]))) + F.when(left == -30.0, at(left, p) / p["a"]).otherwise(0.0)
        over = side(p, F.least(right, F.greatest(F.lit(cut), p["mode"] - p["wide"])), right) + F.when(right == 30.0, at(right, p) / p["b"]).otherwise(0.0)
        return F.when(under + over > 0, under / (under + over)).otherwise(F.when(p["mode"] < cut, 1.0).otherwise(0.0))

    return let(F.struct(a.alias("a"), b.alias("b"), mode.alias("mode"), wide.alias("wide")), share)


def hosts(counts: DataFrame, work: Workspace, floor: float = FLOOR, sure: float = SURE) -> DataFrame:
    """host, n, pages, mean, below and verdict from rows of host, pages, n (outcomes) and s (good ones)."""
    counts = work.save(counts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))), "counts")
    domains = work.save(counts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "domain-sums")
    suffixes = work.save(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "suffix-sums")
    overall = suffixes.agg(((F.coalesce(F.sum("s"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("parent"))
    suffixes = _shrink(suffixes.crossJoin(F.broadcast(overall)), work, "suffixes")
    domains = _shrink(domains.join(suffixes.select("suffix", F.col("mean").alias("parent"), F.col("n").alias("near")), "suffix"), work, "domains")
    found = _shrink(counts.join(domains.select("domain", "suffix", F.col("mean").alias("parent"), "near"), ["domain", "suffix"]), work, "hosts")
    share = below(F.col("s") + F.col("k") * F.col("parent"), F.col("n") - F.col("s") + F.col("k") * (1 - F.col("parent")), floor)
    judged = found.select("host", "pages", "n", "mean", "near", share.alias("below"))
    return judged.select("host", "pages", "n", "mean", "below", F.when((F.col("near") > 0) & (F.col("below") >= sure), "block").otherwise("allow").alias("verdict"))


def judge(pages: DataFrame, outcomes: DataFrame, page_id: str = "page_id", url: str = "url", outcome_id: str = "page_id", good: str = "good", rules: tuple = RULES, floor: float = FLOOR, sure: float = SURE) -> DataFrame:
    """One row per page: page_id, host, path, rule (null if none fits), verdict, and the host's mean and share below the floor.

    outcomes: rows of a page's id and whether it is good (boolean).
    """
    work = Workspace(pages.sparkSession, "reputation")
    parsed = pages.select(F.col(page_id).cast("long").alias("page_id"), host_of(F.col(url).cast("string")).alias("host"), path_of(F.col(url).cast("string")).alias("path"))
    known = outcomes.where(F.col(good).isNotNull()).groupBy(F.col(outcome_id).cast("long").alias("page_id")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(good).cast("long")).alias("s"))
    counts = parsed.join(known, "page_id", "left").groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("s"), F.lit(0)).alias("s"))
    table = work.save(hosts(counts, work, floor, sure), "verdicts")
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    return join_counted(parsed, table, ["host"], "pages", pages.count()).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, F.col("verdict")).alias("verdict"), "mean", "below")
