"""Quality rules: base counts of a text, and a hashed n-gram log-likelihood ratio.

Words and pairs of neighbouring words are hashed into ``BUCKETS`` buckets. The corpus multinomial counts
all documents, the target multinomial those that are trusted; a document's score is the mean, over its
n-grams, of the log ratio of the two probabilities. Every document is kept or not by the same
threshold on its own score, so reruns and other documents' order do not matter. Where judged documents
are given, the threshold is the one with the fewest of them on the wrong side (see ``threshold_of``).

The target is counted on all trusted documents, the corpus on all there are, and the threshold is found on all that are judged: what
was measured of each document is written down, joined with the judgements by id, and counted by score.
Up to ``MAX_SENT`` trusted ids are sent to the texts; more of them meet the texts by a shuffle.
The bucket weights are sent to all tasks: ``BUCKETS`` numbers, whatever the input. Of a million
different n-grams about 15 share a bucket; frequent ones outweigh the rest of theirs.

Defined cases: a null text has no words; a text without words scores 0; null labels are left out and a
trusted id may stand several times; rows with the same id are each scored and all counted; other
columns are ignored; without trusted text every score is 0; an id judged both ways counts on both sides;
unless there are judged documents of both kinds, the fixed threshold holds; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._native import SPACE, count, let
from ._stage import Workspace

BUCKETS = 1 << 16
THRESHOLD = -0.15
#: Ids that are broadcast: some tens of MB.
MAX_SENT = 1_000_000
#: Scores are told apart by this much when the threshold is sought.
STEP = 1e-3


def hashes(word_list: Column) -> Column:
    """Each word hashed once; pairs and triples are hashed from these."""
    return F.transform(word_list, lambda w: F.xxhash64(w))


def _bucket(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def pairs(h: Column) -> Column:
    n = F.greatest(F.size(h) - 1, F.lit(0))
    return F.zip_with(F.slice(h, 1, n), F.slice(h, 2, n), lambda a, b: F.xxhash64(a, b))


def words(text: Column) -> Column:
    """The words of a text; none for null. Without white space at its ends a split leaves no empty ones to be filtered."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def repeated_triples(hashed: Column, paired: Column) -> Column:
    """How many words lie in 3-word windows found twice or more in the list, from the hashes of words and of pairs.

    Windows are hashed and sorted with their places; equal neighbours give the places of repeated
    windows, and a window adds as many words as it is ahead of the one before, 3 at most.
    """

    def places(o: Column) -> Column:
        n = F.size(o)
        before = F.concat(F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(0).alias("i"))), F.slice(o, 1, n - 1))
        after = F.concat(F.slice(o, 2, n - 1), F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(0).alias("i"))))
        same = F.zip_with(F.arrays_zip(before.alias("b"), o.alias("o")), after, lambda x, a: F.when((x["b"]["h"] == x["o"]["h"]) | (a["h"] == x["o"]["h"]), x["o"]["i"]))
        return F.sort_array(F.filter(same, lambda i: i.isNotNull()))

    def covered(at: Column) -> Column:
        n = F.size(at)
        steps = F.zip_with(F.slice(at, 2, n - 1), F.slice(at, 1, n - 1), lambda a, b: F.least(a - b, F.lit(3)))
        return F.when(n == 0, 0).otherwise(F.aggregate(steps, F.lit(3), lambda x, y: x + y)).cast("long")

    def of(h: Column) -> Column:
        n = F.size(h) - 2
        triples = F.zip_with(F.slice(paired, 1, n), F.slice(h, 3, n), lambda p, c: F.xxhash64(p, c))
        return F.when(n < 2, F.lit(0).cast("long")).otherwise(
            let(triples, lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0).cast("long")).otherwise(let(ordered(t), lambda o: let(places(o), covered))))
        )

    def ordered(t: Column) -> Column:
        return F.sort_array(F.transform(t, lambda v, i: F.struct(v.alias("h"), i.alias("i"))))

    return of(hashed)


def weights(docs: DataFrame, trusted: DataFrame, doc_id: str, text: str, trusted_id: str, buckets: int = BUCKETS) -> list[float]:
    """The log ratio of each bucket: trusted against all documents, both with one added to each count."""
    good = Workspace(docs.sparkSession, "trusted").save(trusted.select(F.col(trusted_id).cast("long").alias("_id")).where("_id is not null").distinct(), "ids").withColumn("_good", F.lit(1))
    good = F.broadcast(good) if good.count() <= MAX_SENT else good.hint("merge")
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text")).join(good, "_id", "left")
    rows = rows.select("_good", let(hashes(words(F.col("_text"))), lambda h: F.concat(h, pairs(h))).alias("g"))
    # Each document's n-grams are counted where it is read; what moves is a row per bucket and task.
    found = rows.select("_good", F.explode("g").alias("x")).groupBy(_bucket(F.col("x"), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count("_good").alias("t")).collect()
    n, t = [1] * buckets, [1] * buckets
    for r in found:
        n[r["bucket"]] += r["n"]
        t[r["bucket"]] += r["t"]
    if sum(t) == buckets:
        return [0.0] * buckets
    base = math.log(sum(n) / sum(t))
    return [math.log(a / b) + base for a, b in zip(t, n)]


def score(h: Column, paired: Column, weight: list[float]) -> Column:
    """The mean weight of a list's words and pairs, from their hashes."""
    held = F.split(F.lit(",".join(f"{w:.6f}" for w in weight)), ",").cast("array<double>")

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0.0), lambda a, x: a + F.get(held, _bucket(x, len(weight))))

    n = 2 * F.size(h) - 1
    return F.when(n > 0, (total(h) + total(paired)) / n).otherwise(0.0)


def _measured(content: Column, weight: list[float]) -> Column:
    return let(hashes(words(content)), lambda h: let(pairs(h), lambda p: F.struct(F.size(h).cast("long").alias("n_words"), repeated_triples(h, p).alias("n_repeat_words"), score(h, p, weight).alias("score"))))


def _failed() -> Column:
    return F.expr("m.n_words < 50 or 100 * m.n_repeat_words > 50 * m.n_words")


def best_cut(bins: dict[int, tuple[int, int]]) -> int | None:
    """The cut with the fewest bad at or above it and good below it, from (good, bad) counts of integer bins.

    Of neighbouring cuts that are equally good, the longest stretch counts, the lowest of several, and in it the
    middle one; none without a good and a bad.
    """
    if not (sum(g for g, _ in bins.values()) and (wrong := sum(b for _, b in bins.values()))):
        return None
    # Cuts after one bin up to the next have the same errors; below all bins and above them there is nothing to choose.
    at = sorted(bins)
    stretches = [(wrong, 0, at[0], at[0])]
    for here, after in zip(at, [*at[1:], at[-1] + 1]):
        wrong += bins[here][0] - bins[here][1]
        stretches.append((wrong, here + 1 - after, here + 1, after))
    _, _, low, high = min(stretches)
    return (low + high) // 2


def threshold_of(measured: DataFrame, judged: DataFrame, judged_id: str, good: str) -> float | None:
    """The threshold with the fewest judged documents on the wrong side, among those that pass the base rules."""
    opinions = judged.select(F.col(judged_id).cast("long").alias("doc_id"), F.col(good).cast("boolean").alias("_good")).where("doc_id is not null and _good is not null").distinct()
    scored = measured.where("not base_failed").select("doc_id", F.floor(F.col("score") / STEP).alias("bin")).join(opinions, "doc_id")
    found = scored.groupBy("bin").agg(F.count_if("_good").alias("g"), F.count_if(~F.col("_good")).alias("b")).collect()
    cut = best_cut({r["bin"]: (r["g"], r["b"]) for r in found})
    return None if cut is None else cut * STEP


def quality(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", trusted_id: str = "doc_id", threshold: float = THRESHOLD, buckets: int = BUCKETS, judged: DataFrame | None = None, judged_id: str = "doc_id", good: str = "good") -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept.

    trusted: the ids of the trusted documents. judged: ids and whether the document is good (boolean); they set the
    threshold where there are some of both kinds.
    """
    weight = weights(docs, trusted, doc_id, text, trusted_id, buckets)
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(content, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), _measured(content, weight).alias("m"),
        F.length(F.regexp_replace(content, SPACE, "")).cast("long").alias("word_chars"),
        count(content, "[#*$%&|<>]").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )
    out = out.select("doc_id", "m.n_words", "word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words", _failed().alias("base_failed"), "m.score")
    if judged is not None:
        out = Workspace(docs.sparkSession, "quality").save(out, "measured")
        found = threshold_of(out, judged, judged_id, good)
        if found is None:
            warnings.warn(f"no documents judged both ways: the fixed threshold {threshold} holds", stacklevel=2)
        else:
            threshold = found
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
