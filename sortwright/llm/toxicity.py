"""Toxicity severity by cumulative-link ordinal regression.

P(grade >= k) = sigmoid(x.w - cut_k): one weight vector shared by all ordered cuts. Features are the
presence of single words, selected by how strongly they go with the grades from ``reject`` on. The severity is
the expected grade, and a document is rejected when P(grade >= reject) reaches ``threshold``.

The model is fitted on at most ``MAX_LABELLED`` labelled documents, chosen by a hash of the id, and at
most ``MAX_FEATURES`` words; only their selected features come to the driver. Every document
is scored on its whole text.

Defined cases: a null or empty text has no features and gets the severity of the cuts alone; labels
with a null grade, or whose document is absent, are left out; documents of the same words and grade
count once; without labels of two grades every document gets severity 0 and stays; rows are scored
one by one, so repeated ids and other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from ._stage import Workspace
from .decontam import FOLD
from .huffman import slices

MAX_LABELLED = 20_000
MAX_FEATURES = 2_000
MIN_DOCS = 5
MIN_Z = 5.0
_TABLE = FOLD.tobytes()


def tokens(text: bytes | None) -> set[bytes]:
    return set(text.translate(_TABLE).split()) if text else set()


@dataclass
class OrdinalModel:
    weights: dict[bytes, float] = field(default_factory=dict)
    cuts: list[float] = field(default_factory=list)
    #: The place, among the grades, of the first that is rejected.
    reject: int = 1

    def at_least(self, texts: list[bytes | None]) -> np.ndarray:
        """P(grade >= k) of each text, a row each, a column for k = 1, 2, ..."""
        weight = self.weights
        x = [sum(sorted([weight[w] for w in weight.keys() & set(t.translate(_TABLE).split())])) if t else 0.0 for t in texts]
        return 1 / (1 + np.exp(np.array(self.cuts)[None, :] - np.array(x, float)[:, None]))


def fit_ordinal(rows: list[list[int]], grades: np.ndarray, n_features: int, l2: float = 0.3, steps: int = 600, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending cuts by full-batch Adam on the mean log-likelihood; cuts are kept in order by
    their first value and the logarithms of their gaps."""
    top = int(grades.max())
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.fromiter((c for r in rows for c in r), np.int64, len(at))
    w = np.zeros(n_features)
    share = np.clip([np.mean(grades >= k) for k in range(1, top + 1)], 1e-6, 1 - 1e-6)
    cut = np.maximum.accumulate(np.log((1 - share) / share)) + 1e-3 * np.arange(top)
    p = np.concatenate([w, cut[:1], np.log(np.diff(cut))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    every = np.arange(len(grades))
    for t in range(1, steps + 1):
        w, gaps = p[:n_features], np.exp(p[n_features + 1 :])
        cut = np.cumsum(np.concatenate([p[n_features : n_features + 1], gaps]))
        x = np.bincount(at, w[column], len(grades))
        up = np.concatenate([np.ones((len(grades), 1)), sig(x[:, None] - cut), np.zeros((len(grades), 1))], axis=1)
        slope = up * (1 - up)
        here, above = up[every, grades], up[every, grades + 1]
        prob = np.maximum(here - above, 1e-12)
        dx = (slope[every, grades] - slope[every, grades + 1]) / prob
        dcut = np.zeros((len(grades), top + 2))
        dcut[every, grades] -= slope[every, grades] / prob
        dcut[every, grades + 1] += slope[every, grades + 1] / prob
        dcut = dcut[:, 1:-1].sum(0)
        tail = np.cumsum(dcut[::-1])[::-1]
        g = np.concatenate([np.bincount(column, dx[at], n_features) - l2 * w, tail[:1], tail[1:] * gaps]) / len(grades)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    gaps = np.exp(p[n_features + 1 :])
    return p[:n_features], np.cumsum(np.concatenate([p[n_features : n_features + 1], gaps]))


def fit(docs: DataFrame, labels: DataFrame, grade: str = "toxic", doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES, reject: int = 1) -> OrdinalModel:
    """Fits grades 0, 1, ... of ``labels``: 0 is harmless, the higher the worse, and those from ``reject`` on are to go."""
    # At most max_labelled rows, so the join may broadcast them.
    some = labels.where(F.col(grade).isNotNull()).select(F.col(label_id).cast("long").alias("doc_id"), F.col(grade).cast("int").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(max_labelled)
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(some), "doc_id").select("grade", "text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(tokens(t)) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.record_batch([batch.column("grade"), pa.array(found, pa.list_(pa.binary()))], names=["grade", "words"])

    seen = Workspace(docs.sparkSession, "toxicity").save(picked.mapInArrow(words, "grade int, words array<binary>").distinct(), "labelled")
    total = {r["grade"]: r["n"] for r in seen.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, n_up = sum(total.values()), sum(v for k, v in total.items() if k >= reject)
    if not 0 < n_up < n:
        return OrdinalModel()
    # The signed root of the likelihood ratio of the word's 2 x 2 table.
    a, b = F.col("up"), F.col("df") - F.col("up")
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    ratio = 2 * (part(a, F.col("df") * n_up / n) + part(b, F.col("df") * (n - n_up) / n) + part(n_up - a, (n - F.col("df")) * n_up / n) + part(n - n_up - b, (n - F.col("df")) * (n - n_up) / n))
    z = F.signum(a * n - F.col("df") * n_up) * F.sqrt(F.greatest(ratio, F.lit(0.0)))
    chosen = (
        seen.select((F.col("grade") >= reject).cast("long").alias("up"), F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.sum("up").alias("up"))
        .where(F.col("df") >= MIN_DOCS).select("word", z.alias("z")).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "word").limit(max_features).collect()
    )
    vocabulary = {bytes(r["word"]): i for i, r in enumerate(chosen)}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[vocabulary[w] for w in ws if w in vocabulary] for ws in batch.column("words").to_pylist()]
            yield pa.record_batch([batch.column("grade"), pa.array(rows, pa.list_(pa.int32()))], names=["grade", "features"])

    data = sorted((r["grade"], sorted(r["features"])) for r in seen.mapInArrow(features, "grade int, features array<int>").collect())
    grades, rows = np.array([g for g, _ in data]), [r for _, r in data]
    kinds = np.unique(grades)
    grades, place = np.searchsorted(kinds, grades), int(np.searchsorted(kinds, reject))
    w, cuts = fit_ordinal(rows, grades, len(vocabulary))
    return OrdinalModel({word: float(w[i]) for word, i in vocabulary.items()}, [float(c) for c in cuts], place)


def _parts(batch: pa.RecordBatch, text: str, model: OrdinalModel) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Stretches of a batch by size of text, with their chances of each grade or more."""
    for part in slices(batch.set_column(batch.schema.get_field_index(text), text, batch.column(text).cast(pa.binary())), text):
        yield part, model.at_least(part.column(text).to_pylist())


def _score(model: OrdinalModel, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, up in _parts(batch, "text", model):
                first = up[:, model.reject - 1] if up.shape[1] else np.zeros(len(part))
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(up.sum(axis=1)), pa.array(first), pa.array((up >= 0.5).sum(axis=1).astype(np.int32)), pa.array(first < threshold)],
                    names=["doc_id", "severity", "p_toxic", "grade", "kept"],
                )

    return run


def severity(docs: DataFrame, model: OrdinalModel, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, severity (expected grade), p_toxic (P(grade >= reject)), grade and kept."""
    ship(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_score(model, threshold), "doc_id long, severity double, p_toxic double, grade int, kept boolean")


def drop_toxic(docs: DataFrame, model: OrdinalModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that stay, with all their columns."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [up[:, model.reject - 1] < threshold if up.shape[1] else np.ones(len(part), bool) for part, up in _parts(batch, text, model)]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
