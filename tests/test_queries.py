"""Every registered query of the engine against its SQL, at the smallest scale."""

from __future__ import annotations

import duckdb
import pytest
from oracle import SMALL, same

from sortwright import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, tmp_path, name):
    same(queries.QUERIES[name](spark, SMALL), queries.SQL[name], str(tmp_path / "out"))


def test_over_split_covers_the_sample(spark):
    found = queries.over_split(spark, SMALL).collect()
    assert len(found) == 300 and len({r["vec_id"] for r in found}) == 300
    assert len({r["cluster"] for r in found}) <= 30


def test_flagship(spark):
    assert queries.flagship(spark, SMALL).count() == 500


#: Pages whose entities are not closed, are unknown to the SQL or end a title; without a doctype; long; empty and null.
PAGES = [
    "<!doctype html><html><p>a&amp b &am &amp;lt; &#8217; &eacute; &hellip; &lt;i&gt;</p></html>", "<html><title>T&eacute;&amp</title>x", "<html><title> &nbsp; </title>x", "<html><title>x&nbsp;</title>y",
    "no page <b>at</b> all", "<!-- first --><html><script>x</script>y", f"<html><p>{'word ' * 60_000}</p>", "", None,
]


def test_page_file_on_odd_pages(spark, tmp_path):
    spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = dict(c.execute(f"SELECT page_id, sha256 FROM ({queries.SQL['ex13_page_file']})").fetchall())
    assert dict(queries.QUERIES["ex13_page_file"](spark, str(tmp_path)).collect()) == want
