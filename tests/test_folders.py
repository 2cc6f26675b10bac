"""Folders as aggregates against the walk of one folder after another."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from sortwright.sources import extract, folders, listing


def test_texts_are_those_of_a_walk(spark, tmp_path):
    rng = random.Random(1)
    for box in ("few", "many", "empty words", "mixed"):
        for i in range({"few": 3, "many": 40, "empty words": 5, "mixed": 25}[box]):
            p = tmp_path / box / f"f{i:03}{rng.choice(['.txt', '.md', '', '.TXT'])}"
            p.parent.mkdir(exist_ok=True)
            p.write_text("  \n" if box == "empty words" or (box == "mixed" and i < 4) else f"words  of\n {box} {i} " * 60)
    rows = listing.listed_tree(spark, str(tmp_path)).where("not hidden")
    files = rows.withColumns({"folder": F.element_at(F.split("rel", "/"), 1), "text": F.decode("head", "UTF-8")})
    found = {r["folder"]: r["text"] for r in folders.folder_texts(files, many=30).collect()}
    assert found == {box: extract.folder(str(tmp_path / box), many=30).text for box in ("few", "many", "empty words", "mixed")}


def test_defined_cases(spark):
    rows = [(None, "a.txt", "a.txt", None), (None, "b", "b", "said"), ("x", "c.md", "c.md", None), ("x", "c.md", "c.md", " ")]
    files = spark.createDataFrame([(*r, 1, "n") for r in rows], "folder string, name string, rel string, text string, n int, names string")
    assert {r["folder"]: r["text"] for r in folders.folder_texts(files).collect()} == {None: "2 files: .txt×1, (none)×1\nNames: a.txt, b\nFrom b: said", "x": "2 files: .md×2\nNames: c.md, c.md"}
    assert folders.folder_texts(files.limit(0)).collect() == []


def test_signatures_stop(spark):
    files = spark.range(5000).select(F.lit("big").alias("folder"), F.format_string("%05d", "id").alias("rel"), F.lit(2).alias("size"), F.col("id").alias("mtime"))
    files = files.unionByName(spark.range(3).select(F.lit("small").alias("folder"), F.col("id").cast("string").alias("rel"), F.lit(1).alias("size"), F.col("id").alias("mtime")))
    found = folders.signatures(files, ["rel"])
    assert {r["folder"]: (r["n"], r["total"], r["newest"]) for r in found.collect()} == {"big": (2001, 4002, 2000), "small": (3, 3, 2)}
    # Small limits are Spark's own, larger ones work by parts.
    assert "WindowGroupLimit" in folders.signatures(files, ["rel"], 500)._jdf.queryExecution().executedPlan().toString()
    assert found._jdf.queryExecution().executedPlan().toString().count("row_number()") >= 2
