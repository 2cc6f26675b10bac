"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, decontam, huffman, likelihood, minhash, mixing, oracles, reputation, secrets, substring, toxicity, whitening, winnow
from ._stage import Workspace

#: Where the public vocabulary is found, unless the caller says otherwise.
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_file(spark: SparkSession, docs: DataFrame, **options: int) -> DataFrame:
    path = Workspace(spark, "token-file", lasting=True).path
    huffman.write_tokens(docs, path, vocabulary_path(), **options)
    return huffman.read_digests(spark, path)


def op1_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file(spark, table(spark, sf_dir, "documents"), text_bytes=2 << 20, memo_bytes=96 << 20)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_words(table(spark, sf_dir, "documents"), n_batches=2).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: The first grade that is rejected.
TOXIC = 2


def severity_grades(labels: DataFrame) -> DataFrame:
    """Grades from the labels alone: 0 harmless, 1 not toxic but of no quality, 2 toxic."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, TOXIC).when(F.col("toxic") == 0, F.when(F.col("quality") == 0, 1).otherwise(0)).alias("toxic"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.fit(docs, severity_grades(table(spark, sf_dir, "labels")), reject=TOXIC))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of a page is its label: good means of quality and not toxic."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.expr("quality = 1 and toxic = 0").alias("good")).where("good is not null")
    return reputation.judge(table(spark, sf_dir, "pages"), labels).select("page_id", "host", "path", "rule", "verdict")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted are the documents labelled as of quality and not toxic; the threshold is set by all labels of quality."""
    labels = table(spark, sf_dir, "labels")
    return likelihood.quality(table(spark, sf_dir, "documents"), labels.where("quality = 1 and toxic = 0"), judged=labels.select("doc_id", F.expr("quality = 1").alias("good")))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), "contaminated")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.repeated_lines(table(spark, sf_dir, "documents"))
    numbers = F.array_join(F.transform("removed", lambda i: i.cast("string")), ",")
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(numbers, 256).alias("removed_sha256"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    show = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["rule"] < len(secrets.BASE))

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(r.kind) for r in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(show(base), 256).alias("base_sha256"), show(F.col("spans")).alias("spans"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    whitened, found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    if found is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = whitening.identity_error(whitened, found)
    explained = F.element_at(F.array(*[F.lit(float(x)) for x in found.explained]), F.col("component"))
    rows = whitened.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")).withColumn("component", (F.col("place") + 1).cast("int"))
    return rows.select("vec_id", "component", F.lit(found.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    back = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern), ranks, pattern)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    byte_level, pieces = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align.alignment(table(spark, sf_dir, "documents"), byte_level, pieces, show=lambda groups: F.sha2(groups, 256)).withColumnRenamed("groups", "groups_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_huffman_tokens, op2_source_mix, op3_substring_dedup, op4_toxicity, op5_minhash, op6_url_reputation, op7_quality, op8_decontaminate, op9_line_dedup, op10_secrets, op11_whitening, op12_byte_bpe, op13_alignment, pipeline]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
