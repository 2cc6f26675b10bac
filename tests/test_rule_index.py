"""The rule index against every rule tried on every name."""

from __future__ import annotations

import fnmatch
import random

from hypothesis import given
from hypothesis import strategies as st

from sortwright.operators import ruleindex

RULE = "ord int, pattern string, category string, action string"
GLOBS = st.text(st.sampled_from("ab.*?[]!-"), max_size=9)


@given(GLOBS, st.text(st.sampled_from("ab.[]-"), max_size=9))
def test_what_fits_holds_the_grams(glob, name):
    if fnmatch.fnmatchcase(name, glob):
        assert all(g in name for g in ruleindex.grams(glob))


def test_grams():
    assert ruleindex.grams("*.pdf") == [".pd", "pdf"] and ruleindex.grams("a?bc*") == ["bc"] and ruleindex.grams("*[xyz]?") == [] and ruleindex.grams("[ab") == ["[ab"]


def brute(name, rules):
    fits = [o for o, p, *_ in rules if name is not None and o is not None and p is not None and fnmatch.fnmatchcase(name.lower(), p.lower())]
    return min(fits, default=None)


def check(spark, names, rules):
    frame = spark.createDataFrame([(i, n, 7, "x", "y") for i, n in enumerate(names)], "id int, name string, ord int, key string, rule string").repartition(3)
    found = ruleindex.first_rule_join(frame, spark.createDataFrame(rules, RULE).repartition(2))
    assert found.columns == ["id", "name", "ord", "key", "rule"]
    rows = found.collect()
    assert {r["id"]: r["rule"] and r["rule"]["ord"] for r in rows} == {i: brute(n, rules) for i, n in enumerate(names)} and len(rows) == len(names)
    return rows


def test_random_rules(spark):
    rng = random.Random(1)
    words = ["report", "scan", "tax", "Bill", "a", "b2", "été", "x-y", "[1]"]
    names = ["".join(rng.choices(words, k=rng.randint(1, 4))) + rng.choice([".pdf", ".TXT", "", ".tar.gz"]) for _ in range(300)] + [None, "", "same.pdf", "same.pdf", "?", "*"]
    bits = [*words, "*", "?", "[a-c]", "[!x]", "*.", ".pdf", "[", "]"]
    globs = ["".join(rng.choices(bits, k=rng.randint(1, 5))) for _ in range(400)]
    rules = [(rng.randint(3, 500), g, f"C{i}", "move") for i, g in enumerate(globs) if g.strip("*")] + [(2, None, "n", "move"), (None, "a*", "n", "move")]
    check(spark, names, rules)
    check(spark, names, [*rules, (400, "**", "all", "skip"), (401, "*", "late", "move")])
    check(spark, names, [])


def test_globs_without_letters(spark, monkeypatch):
    monkeypatch.setattr(ruleindex, "BLOCK", 2)
    check(spark, ["1", "12", "a1", "", "abc", "9z"], [(5, "?", "a", "m"), (3, "[0-9]*", "b", "m"), (4, "??", "c", "m"), (9, "???", "d", "m"), (1, "a?c", "e", "m"), (7, "", "f", "m")])


def test_repeated_rows_and_rules(spark):
    rows = check(spark, ["a.pdf"] * 5 + ["b"], [(1, "*.pdf", "Z", "skip"), (1, "*.pdf", "A", "move"), (2, "b", "B", "move"), (2, "*.pdf", "B", "move")])
    assert {(r["rule"]["category"], r["rule"]["action"]) for r in rows if r["name"] == "a.pdf"} == {("A", "move")}


def test_many_rules(spark):
    """Fifty thousand rules over as many names: nothing tries them all."""
    names = spark.range(20_000).selectExpr("concat('file-', id, '.txt') as name")
    rules = spark.range(50_000).selectExpr("cast(id as int) as ord", "concat('*-', id, '.t?t') as pattern", "'c' as category", "'move' as action")
    found = ruleindex.first_rule_join(names, rules)
    assert found.where("name = concat('file-', rule.ord, '.txt')").count() == 20_000


def test_globs_mean_what_they_mean_in_python(spark):
    from pyspark.sql import functions as F

    from sortwright.functions.names import glob_regex

    rng = random.Random(3)
    bits = ["a", "c", "-", "]", "[", "!", "*", "?", "[a-c]", "[!a-c]", "[]-a]", "[a-]", "[-a]", "[c-a]", "[!c-a]", "&&", "^", "\\", "é", "\n", "[&&]", "[\\a]", "[^a]", ".", "[[]"]
    globs = ["".join(rng.choices(bits, k=rng.randint(1, 5))) for _ in range(600)]
    names = ["".join(rng.choices("abc-]![^\\é\n&.", k=rng.randint(0, 4))) for _ in range(120)]
    tried = spark.createDataFrame([(g, glob_regex([g])) for g in globs], "glob string, regex string").crossJoin(spark.createDataFrame([(n,) for n in set(names)], "name string"))
    for r in tried.withColumn("fits", F.rlike("name", F.col("regex"))).collect():
        assert r["fits"] == fnmatch.fnmatchcase(r["name"], r["glob"]), (r["glob"], r["name"])
