"""Tables that outlive a run: examples and the question queue as JSON lines, and the schemas of what ``keyed`` holds."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.journal import add_line

EXAMPLE = "name string, snippet string, category string"
VERDICT = "key string, category string, confidence double, alternatives array<string>, reason string"
VECTOR = "key string, vec array<double>"
QUESTION = "src string, kind string, category string, alternatives array<string>, reason string, snippet string, about string, dest string, asked double"
SNIPPET = 600


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or an empty one where there is none; unreadable lines are dropped."""
    if "://" not in path and not Path(path).exists():
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def add_example(path: str | Path, name: str, snippet: str, category: str, taxonomy: list[str]) -> None:
    if category not in taxonomy:
        raise ValueError(f"no category {category!r}")
    add_line(path, json.dumps({"name": name, "snippet": snippet[:SNIPPET], "category": category}, ensure_ascii=False))


def live(examples: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Examples whose category still exists."""
    return examples.join(taxonomy.select("category"), "category", "left_semi")


def verdict_key(fingerprint: str, kind: Column, name: Column, text: Column, image: Column | None = None) -> Column:
    """A key of all that a verdict depends on; the fingerprint covers settings and examples."""
    picture = F.coalesce(F.sha2(image, 256), F.lit("")) if image is not None else F.lit("")
    return F.substring(F.sha2(F.concat_ws("\0", F.lit(fingerprint), kind, name, text, picture), 256), 1, 24)
