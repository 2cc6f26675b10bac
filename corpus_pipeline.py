"""A corpus pipeline of five of the operators, each stage written and read again by the next.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns what it keeps
of docs: all but the last return the columns of documents.

Defined cases: rows with a null or empty text pass every stage; rows of one id are near duplicates of one another if they have
words, and then all stay or go together; other columns travel along unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortwright.llm import decontam, minhash, mixing, queries, toxicity
from sortwright.llm._stage import Workspace, passing


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labels of this input, does not reject."""
    model = toxicity.fit(docs, queries.severity_grades(queries.table(spark, sf_dir, "labels")), reject=queries.TOXIC)
    return toxicity.drop_toxic(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity 0.8 or more); texts without words stay."""
    groups = minhash.near_duplicates(docs, percent=80, bands=24)
    stay = groups.where("kept or component_id is null or n_shingles = 0").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["_kept_id"]), "left_semi")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken."""
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of the token file."""
    return queries.token_file(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: The model of the first stage is fitted by gradient steps, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage read is deleted once its result is written; the token file stays."""
    work = Workspace(spark, "pipeline", lasting=True)
    docs, before = queries.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with passing(spark):
            docs = work.save(stage(spark, docs, sf_dir), name)
        if before is not None:
            work.drop(before)
        before = name
    return docs
