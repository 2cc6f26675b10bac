"""The registered queries over the star-schema and text tables, each with DuckDB SQL for the same rows.

Stand-ins: a category is the mean vector of an ``embeddings`` label; examples are the first three rows of
each label; file names are built from ``part``; directory observations are ``events``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import Rule
from .functions import names, sniff, text
from .functions.vectors import cosine, doubles, key_of, mean_vectors
from .operators import cascade, cluster, metrics, rank, rules
from .plans import plan, questions
from .sources import folders
from .streaming import watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TAU, SEED_EXAMPLES = 0.3, 3
MARGINS = [0.0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.08, 0.1]
RULES = [Rule(["*tin.*copper", "*?nickel"], None, "skip"), Rule(["a*"], "Metals/A"), Rule(["[b-g]*.*steel"], "Metals/Steel"), Rule(["*"], "Keep/Rest")]
WORDS = ("the", "and", "tion", "er", "de", "que")
SETTLE_SECONDS = 8 * 3600


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Rankings over embeddings


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("label").cast("int").alias("truth"), doubles(F.col("embedding")).alias("vec"))


def categories(rows: DataFrame) -> DataFrame:
    return mean_vectors(rows, ["truth"], "vec", "vec").select(F.col("truth").alias("ord"), F.col("truth").cast("string").alias("category"), "vec")


def seeds(rows: DataFrame, n: int = SEED_EXAMPLES) -> DataFrame:
    """The first n rows of each label, as examples."""
    w = Window.partitionBy("truth").orderBy("vec_id")
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).select(F.col("vec_id").alias("seq"), F.col("truth").cast("string").alias("category"), "vec")


def ranking(spark: SparkSession, d: str, examples: bool = False) -> DataFrame:
    rows = vectors(spark, d)
    return rank.ranked(rows, categories(rows), examples=seeds(rows) if examples else None, tau=TAU)


def decided(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of the ranking alone: every seventh row counts as unreadable."""
    rows = ranking(spark, d).withColumns({"readable": F.col("vec_id") % 7 != 0, "image": F.lit(None).cast("binary"), "name": F.concat(F.lit("doc-"), F.col("vec_id"), F.lit(".txt"))})
    found, _ = cascade.by_rank(rows, cascade.Settings("embed"))
    return cascade.finish(found, "0")


_V = "v AS (SELECT vec_id, label AS truth, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"
_CAT = _V + """, places AS (SELECT truth, unnest(e) AS x, unnest(range(len(e))) AS pos FROM v),
cats AS (SELECT truth AS category, list(x ORDER BY pos) AS c FROM (SELECT truth, pos, avg(x) AS x FROM places GROUP BY ALL) GROUP BY truth)"""
_SCORES = _CAT + ", scores AS (SELECT vec_id, truth, e, category, list_cosine_similarity(e, c) AS score FROM v, cats)"
_RANKED = _SCORES + """, ranked AS (SELECT *, row_number() OVER w AS rank, score - lead(score) OVER w AS lead FROM scores WINDOW w AS (PARTITION BY vec_id ORDER BY score DESC, category)),
best AS (SELECT vec_id, truth, category, score, lead AS margin FROM ranked WHERE rank = 1)"""
_SEEDS = "seeds AS (SELECT vec_id AS seq, truth AS category, e AS s FROM (SELECT *, row_number() OVER (PARTITION BY truth ORDER BY vec_id) AS n FROM v) WHERE n <= 3)"
_VERDICT = _RANKED + """, verdict AS (
  SELECT vec_id, CAST(category AS VARCHAR) AS category, vec_id % 7 <> 0 AS readable,
    CASE WHEN vec_id % 7 = 0 THEN 0.2::DOUBLE WHEN margin >= 0.04 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM best),
items AS (SELECT *, 'doc-' || vec_id || '.txt' AS name, confidence < 0.55 AS review FROM verdict)"""


@register("jn4_rank_categories", f"WITH {_RANKED} SELECT vec_id, CAST(rank AS INTEGER) AS rank, CAST(category AS VARCHAR) AS category, round(score, 6) AS score FROM ranked")
def rank_categories(spark: SparkSession, d: str) -> DataFrame:
    return ranking(spark, d).select("vec_id", F.posexplode("ranked").alias("p", "r")).select("vec_id", (F.col("p") + 1).alias("rank"), "r.category", F.round("r.score", 6).alias("score"))


@register("s1_category_cosine", f"WITH {_SCORES} SELECT vec_id, round(max(score), 6) AS best, round(min(score), 6) AS worst FROM scores GROUP BY vec_id")
def category_cosine(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    side = rank.as_side(categories(rows), "category", "vec", order="ord", name="cats")
    scored = rows.crossJoin(F.broadcast(side)).select("vec_id", F.transform("cats", lambda c: cosine(F.col("vec"), c["vec"])).alias("s"))
    return scored.select("vec_id", F.round(F.array_max("s"), 6).alias("best"), F.round(F.array_min("s"), 6).alias("worst"))


@register("wn2_margin_decision", f"WITH {_RANKED} SELECT vec_id, CAST(category AS VARCHAR) AS category, round(margin, 6) AS margin, margin >= 0.04 AS clear FROM best")
def margin_decision(spark: SparkSession, d: str) -> DataFrame:
    lead = rank.margin(F.col("ranked"))
    return ranking(spark, d).select("vec_id", F.get("ranked", F.lit(0))["category"].alias("category"), F.round(lead, 6).alias("margin"), cascade.is_clear(lead, F.lit(True), F.lit(False)).alias("clear"))


@register("jn4_rank_by_blocks", f"WITH {_RANKED} SELECT vec_id, CAST(category AS VARCHAR) AS category, round(margin, 6) AS margin FROM best")
def rank_by_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    found = rank.ranked_by_blocks(rows, categories(rows))
    return found.select("vec_id", F.get("ranked", F.lit(0))["category"].alias("category"), F.round(rank.margin(F.col("ranked")), 6).alias("margin"))


@register(
    "ag5_example_boost",
    f"""WITH {_SCORES}, {_SEEDS}, boost AS (SELECT v.vec_id, seeds.category, greatest(0, max(list_cosine_similarity(v.e, s) - 0.3)) AS b FROM v, seeds GROUP BY ALL)
SELECT vec_id, CAST(category AS VARCHAR) AS category, round(score + 0.5 * b, 6) AS score FROM scores JOIN boost USING (vec_id, category)""",
)
def example_boost(spark: SparkSession, d: str) -> DataFrame:
    return ranking(spark, d, examples=True).select("vec_id", F.explode("ranked").alias("r")).select("vec_id", "r.category", F.round("r.score", 6).alias("score"))


_NEAR = f"WITH {_V}, {_SEEDS}, near AS (SELECT v.vec_id, seq, category, list_cosine_similarity(v.e, s) AS score, row_number() OVER (PARTITION BY v.vec_id ORDER BY list_cosine_similarity(v.e, s) DESC, seq) AS rank FROM v, seeds)"


@register("jn6_nearest_example", _NEAR + " SELECT vec_id, seq, round(score, 6) AS score, CASE WHEN score >= 0.62 THEN CAST(category AS VARCHAR) END AS taught FROM near WHERE rank = 1")
def nearest_example(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    best = F.get("nearest", F.lit(0))
    return rank.nearest(rows, seeds(rows), 1).select("vec_id", best["seq"].alias("seq"), F.round(best["score"], 6).alias("score"), rank.taught(F.col("nearest"), 0.62).alias("taught"))


@register("jn7_knn_examples", _NEAR + " SELECT vec_id, CAST(rank AS INTEGER) AS rank, seq, round(score, 6) AS score FROM near WHERE rank <= 4")
def knn_examples(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    return rank.nearest(rows, seeds(rows), 4).select("vec_id", F.posexplode("nearest").alias("p", "n")).select("vec_id", (F.col("p") + 1).alias("rank"), "n.seq", F.round("n.score", 6).alias("score"))


_ALL_NEAR = f"WITH {_V}, near AS (SELECT a.vec_id, b.vec_id AS seq, list_cosine_similarity(a.e, b.e) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 9) DESC, b.vec_id) AS rank FROM v a, v b)"


@register("jn7_knn_blocks", _ALL_NEAR + " SELECT vec_id, CAST(rank AS INTEGER) AS rank, seq, round(score, 6) AS score FROM near WHERE rank <= 4")
def knn_blocks(spark: SparkSession, d: str) -> DataFrame:
    """All rows are examples, in blocks of some 300."""
    rows = vectors(spark, d)
    held = rows.select(F.col("vec_id").alias("seq"), F.col("truth").cast("string").alias("category"), "vec")
    found = rank.nearest_by_blocks(rows.select("vec_id", "vec"), held, 4, size=300 * 8 * 64)
    return found.select("vec_id", F.posexplode("nearest").alias("p", "n")).select("vec_id", (F.col("p") + 1).alias("rank"), "n.seq", F.round("n.score", 6).alias("score"))


@register("wn3_alternatives", f"WITH {_RANKED} SELECT vec_id, string_agg(CAST(category AS VARCHAR), ',' ORDER BY rank) FILTER (rank BETWEEN 2 AND 4) AS alternatives, string_agg(CAST(category AS VARCHAR), ',' ORDER BY rank) FILTER (rank <= 3) AS shortlist FROM ranked GROUP BY vec_id")
def alternatives(spark: SparkSession, d: str) -> DataFrame:
    return ranking(spark, d).select("vec_id", F.array_join(rank.alternatives(F.col("ranked")), ",").alias("alternatives"), F.array_join(rank.shortlist(F.col("ranked"), 3), ",").alias("shortlist"))


@register("md9_decisions", f"WITH {_VERDICT} SELECT vec_id, category, confidence, review FROM items")
def decisions(spark: SparkSession, d: str) -> DataFrame:
    return decided(spark, d).select("vec_id", "category", "confidence", "review")


@register("ag11_accuracy", f"WITH {_RANKED} SELECT count(*) AS n, count_if(truth = category) AS correct, count_if(category IS NULL) AS invalid, count_if(truth = category) / count(*) AS accuracy FROM best")
def accuracy(spark: SparkSession, d: str) -> DataFrame:
    return metrics.accuracy(ranking(spark, d).select(F.col("truth").cast("string").alias("truth"), F.get("ranked", F.lit(0))["category"].alias("category")))


_SWEEP = " UNION ALL ".join(
    f"SELECT CAST({m} AS DOUBLE) AS threshold, count_if(margin >= {m}) AS decided, coalesce(count_if(margin >= {m} AND place = 1) / nullif(count_if(margin >= {m}), 0), 0.0) AS accuracy_when_decided, count_if(margin < {m}) AS escalated, "
    f"coalesce(count_if(margin < {m} AND place <= 2) / nullif(count_if(margin < {m}), 0), 0.0) AS recall_top2, coalesce(count_if(margin < {m} AND place <= 3) / nullif(count_if(margin < {m}), 0), 0.0) AS recall_top3 FROM placed"
    for m in MARGINS
)


@register("ag12_margin_sweep", f"WITH {_RANKED}, placed AS (SELECT b.vec_id, margin, r.rank AS place FROM best b JOIN ranked r ON r.vec_id = b.vec_id AND r.category = b.truth) {_SWEEP}")
def margin_sweep(spark: SparkSession, d: str) -> DataFrame:
    at = F.array_position(F.transform("ranked", lambda r: r["category"]), F.col("truth").cast("string"))
    return metrics.margin_sweep(ranking(spark, d).select(rank.margin(F.col("ranked")).alias("margin"), at.alias("at")), MARGINS)


@register(
    "ag13_teach_one_worst",
    f"""WITH {_SCORES}, {_SEEDS}, boost AS (SELECT v.vec_id, seeds.category, greatest(0, max(list_cosine_similarity(v.e, s) - 0.3)) AS b FROM v, seeds GROUP BY ALL),
runs AS (SELECT t.category AS taught, s.vec_id, s.truth, s.category, s.score + CASE WHEN s.category = t.category THEN 0.5 * b ELSE 0 END AS score FROM scores s JOIN boost USING (vec_id, category), cats t),
first AS (SELECT taught, vec_id, truth, category, row_number() OVER (PARTITION BY taught, vec_id ORDER BY score DESC, category) AS rank FROM runs)
SELECT min(a) AS worst_accuracy FROM (SELECT taught, count_if(truth = category) / count(*) AS a FROM first WHERE rank = 1 GROUP BY taught)""",
)
def teach_one_worst(spark: SparkSession, d: str) -> DataFrame:
    """The lowest accuracy when the examples of one category alone are taught: all runs in one pass over the rows."""
    plain = ranking(spark, d).select("vec_id", "truth", "ranked")
    taught = ranking(spark, d, examples=True).select("vec_id", F.col("ranked").alias("boosted"))
    return metrics.worst_of_one_taught(plain.join(taught, "vec_id"))


@register("ag15_leave_one_out", "SELECT a.vec_id, b.vec_id AS example FROM embeddings a JOIN (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) b ON a.label = b.label AND a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY b.vec_id) <= 2")
def leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    return metrics.leave_one_out(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", "label", 2)


@register("ag14_latency", f"WITH {_RANKED} SELECT 0.089 + count_if(margin < 0.04) / count(*) * 22.085 AS seconds_per_file FROM best")
def latency(spark: SparkSession, d: str) -> DataFrame:
    lead = ranking(spark, d).select(rank.margin(F.col("ranked")).alias("m"))
    return lead.agg(metrics.latency(F.lit(0.089), F.count_if(F.col("m") < 0.04), F.count(F.lit(1)), F.lit(22.085)).alias("seconds_per_file"))


# Plans


def _target(mode: str) -> Column:
    return plan.target(F.col("category"), F.col("review"), F.col("name"), "/home", "_Review", mode)


@register("sk1_plan_target", f"WITH {_VERDICT} SELECT vec_id, CASE WHEN NOT review THEN '/home/' || category || '/' || name END AS asked, CASE WHEN review THEN '/home/_Review/' || name ELSE '/home/' || category || '/' || name END AS reviewed FROM items")
def plan_target(spark: SparkSession, d: str) -> DataFrame:
    return decided(spark, d).select("vec_id", _target("ask").alias("asked"), _target("review_folder").alias("reviewed"))


@register("ag2_plan_summary", f"WITH {_VERDICT} SELECT count_if(category IS NOT NULL AND NOT review) AS to_file, count_if(category IS NOT NULL AND review) AS unsure, count_if(category IS NULL) AS left_behind FROM items")
def plan_summary(spark: SparkSession, d: str) -> DataFrame:
    return plan.summary(decided(spark, d))


@register("ag3_plan_grouping", f"WITH {_VERDICT} SELECT CASE WHEN review THEN '(review)' ELSE category END AS heading, string_agg(name, ',' ORDER BY name) AS names FROM items GROUP BY 1")
def plan_grouping(spark: SparkSession, d: str) -> DataFrame:
    return plan.grouped(decided(spark, d)).select("heading", F.array_join("names", ",").alias("names"))


@register("ag1_via_counts", "SELECT CASE WHEN p_partkey % 5 = 0 THEN 'cache' WHEN p_partkey % 3 = 0 THEN 'llm' ELSE 'embed' END AS via, count(*) AS n FROM part GROUP BY 1")
def via_counts(spark: SparkSession, d: str) -> DataFrame:
    via = F.when(F.col("p_partkey") % 5 == 0, "cache").when(F.col("p_partkey") % 3 == 0, "llm").otherwise("embed")
    return plan.via_counts(table(spark, d, "part").select(via.alias("via")))


@register("wn5_free_name", "SELECT doc_id, CASE WHEN n = 1 THEN source || '.txt' ELSE source || ' (' || n || ').txt' END AS free_name FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) + CASE WHEN source = 'src1' THEN 1 ELSE 0 END AS n FROM documents)")
def free_name(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.lit("/home").alias("folder"), F.concat("source", F.lit(".txt")).alias("name"))
    taken = spark.createDataFrame([("/home", "src1.txt")], "folder string, name string")
    return plan.free_names(rows, "folder", "name", "doc_id", taken).select("doc_id", "free_name")


@register("ag1_counted_pass", f"WITH {_VERDICT}, b AS (SELECT CASE WHEN vec_id % 4 = 0 THEN 'cache' WHEN vec_id % 9 = 0 THEN NULL ELSE 'embed' END AS via FROM items) SELECT coalesce(via, 'other') AS via, count(*) AS n FROM b GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM b")
def counted_pass(spark: SparkSession, d: str) -> DataFrame:
    """Counts that come with the pass that writes the plan."""
    from .runtime import staged

    via = F.when(F.col("vec_id") % 4 == 0, "cache").when(F.col("vec_id") % 9 != 0, F.col("via"))
    rows, seen = plan.counted(decided(spark, d).withColumn("via", via))
    staged(rows, "plan")
    return spark.createDataFrame([(k, n) for k, n in seen.get.items() if n], "via string, n long")


_NUMBERED = "source || CASE WHEN doc_id % 4 = 1 THEN ' (' || (doc_id % 13) || ')' WHEN doc_id % 16 = 2 THEN ' (2) (' || (doc_id % 5) || ')' ELSE '' END"


@register(
    "wn5_numbered_names",
    f"""WITH RECURSIVE items AS (SELECT doc_id, lang, doc_id % 9 = 0 AS folder, {_NUMBERED} || '.txt' AS name, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents),
cut AS (SELECT *, CASE WHEN folder THEN name ELSE left(name, length(name) - 4) END AS stem, CASE WHEN folder THEN '' ELSE '.txt' END AS ext FROM items),
step AS (SELECT lang, 0::BIGINT AS i, NULL::BIGINT AS doc_id, NULL::VARCHAR AS free_name, list(DISTINCT source || ' (3).txt') AS used FROM documents GROUP BY lang
  UNION ALL SELECT lang, i, doc_id, free_name, list_append(used, free_name) FROM (
    SELECT s.lang, c.i, c.doc_id, s.used, CASE WHEN NOT list_contains(s.used, c.name) THEN c.name ELSE list_filter(list_transform(range(2, len(s.used) + 3), lambda k: c.stem || ' (' || k || ')' || c.ext), lambda x: NOT list_contains(s.used, x))[1] END AS free_name
    FROM step s JOIN cut c ON c.lang = s.lang AND c.i = s.i + 1))
SELECT doc_id, free_name FROM step WHERE doc_id IS NOT NULL""",
)
def numbered_names(spark: SparkSession, d: str) -> DataFrame:
    """Names that are numbered themselves, files and folders, beside taken ones; the SQL takes item by item."""
    docs = table(spark, d, "documents")
    kind = F.when(F.col("doc_id") % 9 == 0, "folder").otherwise("file")
    rows = docs.select("doc_id", "lang", F.concat(F.expr(_NUMBERED), F.lit(".txt")).alias("name"), kind.alias("kind"))
    taken = docs.select("lang", F.concat("source", F.lit(" (3).txt")).alias("name"))
    return plan.free_names(rows, "lang", "name", "doc_id", taken, "kind").select("doc_id", "free_name")


@register("wn9_journal_undo_last", "SELECT event_id AS seq, event_type AS src FROM events ORDER BY event_id DESC LIMIT 25")
def journal_undo_last(spark: SparkSession, d: str) -> DataFrame:
    return plan.last_moves(table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("src")), 25)


_STATE = "CASE l_returnflag WHEN 'R' THEN 'done' WHEN 'A' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'undoing' ELSE 'undone' END ELSE 'meant' END"


@register(
    "sk2_journal_settled",
    f"""WITH last AS (SELECT l_orderkey AS id, arg_max({_STATE}, {{'n': l_linenumber, 's': {_STATE}}}) AS state FROM lineitem GROUP BY 1),
e AS (SELECT id, 'in/' || id AS src, 'home/' || id % 97 || '/' || id AS dst, state FROM last WHERE state <> 'undone'),
present AS (SELECT 'in/' || o_orderkey AS path FROM orders WHERE o_orderstatus <> 'F' UNION SELECT 'home/' || o_orderkey % 97 || '/' || o_orderkey FROM orders WHERE o_custkey % 3 = 0)
SELECT CAST(id AS VARCHAR) AS id, src, dst, CASE WHEN state = 'done' THEN 'moved' WHEN src IN (FROM present) THEN CASE WHEN dst IN (FROM present) THEN 'both' ELSE 'stayed' END WHEN dst IN (FROM present) THEN 'moved' ELSE 'lost' END AS outcome FROM e""",
)
def journal_settled(spark: SparkSession, d: str) -> DataFrame:
    """Order lines stand for journal lines, orders for what is there."""
    src, dst = lambda k: F.concat(F.lit("in/"), k), lambda k: F.concat(F.lit("home/"), F.col(k) % 97, F.lit("/"), k)
    lines = table(spark, d, "lineitem").select(F.struct("l_linenumber", F.expr(_STATE)).alias("seq"), F.col("l_orderkey").cast("string").alias("id"), src("l_orderkey").alias("src"), dst("l_orderkey").alias("dst"), F.expr(_STATE).alias("state"))
    orders = table(spark, d, "orders")
    present = orders.where("o_orderstatus <> 'F'").select(src("o_orderkey").alias("path")).unionByName(orders.where("o_custkey % 3 = 0").select(dst("o_orderkey").alias("path")))
    return plan.settled(lines, present)


@register("sc10_latest_run", "SELECT max_by(user_id, {'ts': ts, 'user_id': user_id}) AS run_id FROM events")
def latest_run(spark: SparkSession, d: str) -> DataFrame:
    return plan.latest_run(table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("ts").alias("at")))


# Questions


@register("jn11_question_enqueue", "SELECT conv_id AS src, min(turn) AS seq FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels) GROUP BY conv_id")
def question_enqueue(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "conversations").select(F.col("conv_id").alias("src"), F.col("turn").alias("seq"))
    return questions.enqueue(table(spark, d, "labels").select(F.col("doc_id").alias("src")), items)


@register("fl7_question_pending", "SELECT conv_id AS src, turn FROM conversations WHERE conv_id IN (SELECT doc_id FROM labels)")
def question_pending(spark: SparkSession, d: str) -> DataFrame:
    return questions.pending(table(spark, d, "conversations").select(F.col("conv_id").alias("src"), "turn"), table(spark, d, "labels").select(F.col("doc_id").alias("src")))


@register("jn10_guesses", f"WITH {_RANKED} SELECT vec_id, coalesce(nullif(array_to_string(list(CAST(category AS VARCHAR) ORDER BY rank) FILTER (rank <= 4 AND category % 2 = 0), ','), ''), '0,2,4') AS guesses FROM ranked GROUP BY vec_id".replace("array_to_string(list(", "array_to_string((list(").replace("category % 2 = 0), ',')", "category % 2 = 0))[1:3], ',')"))
def guesses(spark: SparkSession, d: str) -> DataFrame:
    first = F.get("ranked", F.lit(0))["category"]
    return ranking(spark, d).select("vec_id", F.array_join(questions.guesses(first, rank.alternatives(F.col("ranked")), ["0", "2", "4", "6", "8"]), ",").alias("guesses"))


# Names and rules

_NAME = "p_name || '.' || lower(p_type)"


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_brand", F.concat("p_name", F.lit("."), F.lower("p_type")).alias("name"))


def _globs(rules_: list[Rule]) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'''lower({_NAME}) GLOB '{p}' ''' for p in r.patterns)} THEN {i}" for i, r in enumerate(rules_))
    return f"CASE {cases} END"


@register("jn1_rule_first_match", f"SELECT p_partkey, ord, CASE ord {' '.join(f'WHEN {i} THEN ' + (repr(r.category) if r.category else 'NULL') for i, r in enumerate(RULES))} END AS category, CASE WHEN ord = 0 THEN 'skip' ELSE 'move' END AS action FROM (SELECT p_partkey, {_globs(RULES)} AS ord FROM part)")
def rule_first_match(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("p_partkey", rules.first_rule(F.col("name"), RULES).alias("r")).select("p_partkey", "r.ord", "r.category", "r.action")


@register("jn1_rule_join", f"SELECT p_partkey, {_globs(RULES)} AS ord FROM part")
def rule_join(spark: SparkSession, d: str) -> DataFrame:
    held = spark.createDataFrame([(i, p, r.category, r.action) for i, r in enumerate(RULES) for p in r.patterns], "ord int, pattern string, category string, action string")
    return rules.first_rule_join(files(spark, d), held).select("p_partkey", "rule.ord")


_MADE = "CASE o_orderkey % 6 WHEN 0 THEN p_name || '.*' WHEN 1 THEN '*' || right(p_name, 9) || '*' || left(lower(p_type), 9) || '*' WHEN 2 THEN left(p_name, 5) || '?*' || lower(p_type) WHEN 3 THEN '*[a-f]' || right(lower(p_type), 4) || '*' || right(p_name, 6) || '?' || lower(p_type) WHEN 4 THEN '*.x' || lower(p_type) ELSE substr(p_name, 2) || '.*' END"


@register(
    "jn1_rule_index",
    f"""WITH rules AS (SELECT {_MADE} AS pattern, min(o_orderkey) AS ord FROM orders JOIN part ON p_partkey = o_custkey + o_orderkey % 7 GROUP BY 1),
best AS (SELECT name, min(ord) AS ord FROM (SELECT DISTINCT lower({_NAME}) AS name FROM part) JOIN rules ON name GLOB lower(pattern) GROUP BY name)
SELECT p_partkey, ord, CASE WHEN ord IS NOT NULL THEN 'C' || ord % 10 END AS category FROM part LEFT JOIN best ON lower({_NAME}) = name""",
)
def rule_index(spark: SparkSession, d: str) -> DataFrame:
    """As many rules as there are orders, made from the names of parts."""
    orders, part = table(spark, d, "orders"), table(spark, d, "part")
    made = orders.join(part, part["p_partkey"] == orders["o_custkey"] + orders["o_orderkey"] % 7)
    held = made.select(F.col("o_orderkey").alias("ord"), F.expr(_MADE).alias("pattern"), F.concat(F.lit("C"), F.col("o_orderkey") % 10).alias("category"), F.lit("move").alias("action"))
    return rules.first_rule_join(files(spark, d), held).select("p_partkey", "rule.ord", "rule.category")


@register("fl1_ignore_filter", f"SELECT p_partkey FROM part WHERE NOT (lower({_NAME}) GLOB '*.*steel' OR lower({_NAME}) GLOB '[a-c]*.small*')")
def ignore_filter(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).where(rules.not_ignored(F.col("name"), ["*.*STEEL", "[a-c]*.small*"])).select("p_partkey")


@register("fl3_owned_anti_join", "SELECT p_partkey, p_brand AS name FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#23', 'Brand#45')")
def owned_anti_join(spark: SparkSession, d: str) -> DataFrame:
    owned = spark.createDataFrame([("Brand#11",), ("Brand#23",), ("Brand#45",)], "name string")
    return rules.without_owned(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("name")), owned)


@register("ag4_ext_histogram", "SELECT ext, n FROM (SELECT coalesce(nullif(lower(regexp_extract(p_name || '.' || lower(p_type), '^.*[^./](\\.[^./]+)$', 1)), ''), '(none)') AS ext, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1) ORDER BY n DESC, first LIMIT 8")
def ext_histogram(spark: SparkSession, d: str) -> DataFrame:
    held = files(spark, d).select(F.lit("parts").alias("folder"), "name", F.col("p_partkey").alias("_place"))
    return folders.histogram(held).select("ext", "n")


_RAW = "'  ' || p_type || '\\' || p_name || '!/' || p_brand || '//x'"


@register("s9_clean_path", f"""SELECT p_partkey, array_to_string(list_transform(list_filter(list_transform(string_split(replace({_RAW}, '\\', '/'), '/'), lambda p: trim(regexp_replace(p, '[^\\p{{L}}\\p{{N}}_ &+-]', '', 'g'))), lambda p: p <> '')[1:2],
 lambda p: array_to_string(list_transform(string_split_regex(p, '\\s+'), lambda w: upper(w[1:1]) || w[2:]), ' ')), '/') AS path FROM part""")
def clean_path(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("  "), "p_type", F.lit("\\"), "p_name", F.lit("!/"), "p_brand", F.lit("//x"))
    return table(spark, d, "part").select("p_partkey", names.clean_path(raw).alias("path"))


@register("fl10_category_path_valid", "SELECT p_partkey, NOT (p_partkey % 3 = 0 OR p_partkey % 5 = 0) AS valid FROM part")
def category_path_valid(spark: SparkSession, d: str) -> DataFrame:
    path = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_type", F.lit("/../x"))).when(F.col("p_partkey") % 5 == 0, F.concat("p_type", F.lit("//"), "p_name")).otherwise(F.concat(F.lit("/"), "p_type", F.lit("/"), "p_name", F.lit("/")))
    return table(spark, d, "part").select("p_partkey", names.valid_path(path).alias("valid"))


@register("fl8_locality", """SELECT page_id, place, count(*) AS n FROM (SELECT page_id, CASE WHEN page_id % 4 = 1 THEN 'device' WHEN page_id % 4 IN (2, 3) THEN 'network' ELSE 'remote' END AS place FROM pages) GROUP BY ALL""")
def locality(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("page_id") % 4
    url = F.when(m == 1, "http://localhost:11434/x").when(m == 2, "http://192.168.1.20:8080").when(m == 3, "https://box.local/a").otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", names.locality_of(url).alias("place")).groupBy("page_id", "place").agg(F.count(F.lit(1)).alias("n"))


@register("sc1_listed_tree", "SELECT DISTINCT 'lang=' || lang || '/source=' || source AS folder, 3 AS depth FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def listed_tree(spark: SparkSession, d: str) -> DataFrame:
    """Folders in which files lie, of a tree written from the documents; what is hidden or deeper is not entered."""
    import uuid

    from .runtime import shared_root
    from .sources import listing

    at = f"{shared_root(spark)}/tree-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").where("source is not null and lang is not null").select("doc_id", "lang", "source")
    docs.write.partitionBy("lang", "source").parquet(f"{at}/home")
    docs.withColumn("deep", F.lit(1)).write.partitionBy("lang", "source", "deep").parquet(f"{at}/home/.hidden")
    files = listing.listed_tree(spark, f"{at}/home".removeprefix("file://"), ["_*"]).where("depth <= 3 and not hidden")
    return files.select(F.regexp_replace("rel", "/[^/]*$", "").alias("folder"), "depth").distinct()


@register("sc2_even_sample", "WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT doc_id FROM o WHERE n <= 300 OR i IN (SELECT (s * n) // 300 FROM range(300) t(s))")
def even_sample(spark: SparkSession, d: str) -> DataFrame:
    """The gather step's sample: its limit is the operator's own."""
    return rules.even_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 300)


# Text


def _entities(x: str) -> str:
    for entity, char in text.ENTITIES:
        x = f"replace({x}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return x


def _stripped(x: str) -> str:
    for tag in ("script", "style", "noscript", "svg"):
        x = f"regexp_replace({x}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    return _entities(f"regexp_replace({x}, '(?s)<[^>]+>', ' ', 'g')")


def _squashed(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '[ \t' || chr(160) || ']+', ' ', 'g'), '\n\s*\n+', chr(10), 'g'), '^\s+|\s+$', '', 'g')"


_TITLE = rf"regexp_replace({_entities('''regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', '', 'g')''')}, '^\s+|\s+$', '', 'g')"


@register("s4_html_title", f"SELECT page_id, {_TITLE} AS title FROM pages")
def html_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.html_title(F.col("html")).alias("title"))


@register("ex13_html_text", f"SELECT page_id, sha256({_squashed('t')}) AS sha256, length({_squashed('t')}) AS n FROM (SELECT page_id, CASE WHEN title <> '' THEN 'Title: ' || title || chr(10) ELSE '' END || {_stripped('html')} AS t FROM (SELECT *, {_TITLE} AS title FROM pages))")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    t = text.squash(text.html_text(F.col("html")))
    return table(spark, d, "pages").select("page_id", F.sha2(t, 256).alias("sha256"), F.length(t).cast("long").alias("n"))


@register("s5_squash_text", f"SELECT doc_id, sha256({_squashed('text')}) AS sha256 FROM documents")
def squash_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(text.squash(F.col("text")), 256).alias("sha256"))


_KIND = r"CASE WHEN regexp_matches(t, '(?is)\A\s*(<!doctype html|<html)') THEN 'html' WHEN regexp_matches(t, '\A(Return-Path|Received|Delivered-To|MIME-Version|From|Message-ID):') AND regexp_matches(t, '(?mi)^(Subject|Date):') THEN 'email' ELSE 'text' END"


@register("ex1_text_kind", f"SELECT kind, count(*) AS n FROM (SELECT {_KIND} AS kind FROM (SELECT html AS t FROM pages UNION ALL SELECT CASE WHEN doc_id % 10 = 0 THEN 'From: a@b.c' || chr(10) || 'Subject: x' || chr(10) || text ELSE text END FROM documents)) GROUP BY kind")
def text_kind(spark: SparkSession, d: str) -> DataFrame:
    mail = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("From: a@b.c\nSubject: x\n"), "text")).otherwise(F.col("text"))
    both = table(spark, d, "pages").select(F.col("html").alias("t")).union(table(spark, d, "documents").select(mail))
    return both.groupBy(sniff.text_kind(F.col("t")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_PREVIEW = f"substr('Type: text (TXT). Size: ' || CASE WHEN n_chars > 1e6 THEN format('{{:.1f}} MB', n_chars / 1e6) ELSE format('{{:.0f}} KB', round_even(greatest(n_chars, 1) / 1e3, 0)) END || '. Modified: 2024-01-02.' || CASE WHEN {_squashed('text')} <> '' THEN chr(10) || {_squashed('text')} ELSE '' END, 1, 2000)"


@register("ex0_preview", f"SELECT doc_id, sha256({_PREVIEW}) AS sha256, length({_PREVIEW}) AS n FROM documents")
def preview(spark: SparkSession, d: str) -> DataFrame:
    p = text.described(F.lit("text (TXT)"), F.col("n_chars"), F.lit("2024-01-02").cast("timestamp"), F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.sha2(p, 256).alias("sha256"), F.length(p).cast("long").alias("n"))


@register("s6_document_key", "SELECT doc_id, substr(sha256('embeddinggemma' || chr(0) || 'File: ' || source || chr(10) || text), 1, 24) AS key FROM documents")
def document_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", key_of("embeddinggemma", F.concat(F.lit("File: "), "source", F.lit("\n"), "text")).alias("key"))


@register("fl11_first_line", r"""SELECT doc_id, CASE WHEN length(f) <= 90 THEN f ELSE substr(f, 1, 89) || '…' END AS line FROM (SELECT doc_id, coalesce(regexp_replace(trim(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND NOT starts_with(x, 'Type:') AND NOT starts_with(x, 'Size:'))[1]), '\s+', ' ', 'g'), '') AS f FROM documents)""")
def first_line(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.clip(text.first_line(F.col("text")), 90).alias("line"))


@register("s7_parse_choice", """SELECT event_id, CASE WHEN k % 3 = 0 THEN 'Finance/Taxes' WHEN k % 3 = 1 THEN 'Study/Notes' END AS category, 'k' || k AS reason FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""")
def parse_choice(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    body = F.when(k % 3 == 0, "Finance/Taxes").when(k % 3 == 1, "study - NOTES").otherwise("Nowhere")
    reply = F.concat(F.when(k % 2 == 0, "Sure: ").otherwise(""), F.to_json(F.struct(body.alias("category"), F.concat(F.lit("k"), k).alias("reason"))))
    choices = F.array(F.lit("Finance/Taxes"), F.lit("Study/Notes"))
    return table(spark, d, "events").select("event_id", cascade.parse_choice(reply, choices).alias("p")).select("event_id", "p.category", "p.reason")


# Caches and deterministic embedding


@register("jn2_cache_lookup", "SELECT doc_id, doc_id % 3 = 0 AS hit FROM documents")
def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("key"))
    held = rows.where("doc_id % 3 = 0").select("key", F.lit("A").alias("category"), F.lit(0.9).alias("confidence"), F.array(F.lit("B")).alias("alternatives"), F.lit("r").alias("reason"))
    hits, misses = cascade.by_cache(rows, held)
    return hits.select("doc_id", (F.col("via") == "cache").alias("hit")).unionByName(misses.select("doc_id", F.lit(False).alias("hit")))


@register(
    "sc8_keyed_store",
    """WITH rows AS (SELECT doc_id // 3 AS key, doc_id % 7 AS batch, doc_id, source, n_chars FROM documents),
last AS (SELECT key, arg_max({'d': doc_id, 's': source, 'n': n_chars}, {'b': batch, 'd': doc_id}) AS r FROM rows GROUP BY key)
SELECT l.doc_id, r.d AS held_id, r.s AS source, r.n AS n_chars FROM labels l LEFT JOIN last ON last.key = l.doc_id // 2""",
)
def keyed_store(spark: SparkSession, d: str) -> DataFrame:
    """A store that documents are put into in seven rounds, three of them to a key, and that the labels look their documents up in."""
    import uuid

    from .runtime import shared_root
    from .sources.keyed import KeyedStore

    store = KeyedStore(spark, f"{shared_root(spark)}/store-{uuid.uuid4().hex}", "key string, doc_id long, source string, n_chars long", buckets=4, runs=3)
    docs = table(spark, d, "documents").withColumn("key", F.floor(F.col("doc_id") / 3).cast("string"))
    for batch in range(7):
        store.put(docs.where(F.col("doc_id") % 7 == batch))
    asked = table(spark, d, "labels").select("doc_id", F.floor(F.col("doc_id") / 2).cast("string").alias("_at"))
    return store.lookup(asked, "_at").select("doc_id", F.col("held.doc_id").alias("held_id"), "held.source", "held.n_chars")


@register("jn3_embed_missing", "SELECT md5(text) AS key FROM documents GROUP BY text HAVING count_if(doc_id % 3 = 0) = 0")
def embed_missing(spark: SparkSession, d: str) -> DataFrame:
    from .models import missing_texts

    rows = table(spark, d, "documents").select("doc_id", F.md5("text").alias("key"), "text")
    return missing_texts(rows, rows.where("doc_id % 3 = 0").select("key").distinct()).select("key")


def _count(w: str) -> str:
    return f"(length(t) - length(replace(t, '{w}', ''))) / {len(w)} + 0.01"


_BOW = f"""bags AS (SELECT doc_id, [{', '.join(_count(w) for w in WORDS)}] AS e FROM (SELECT doc_id, lower(text) AS t FROM documents)),
cats AS (SELECT unnest(range({len(WORDS)})) AS ord, unnest([{', '.join(repr(w) for w in WORDS)}]) AS category),
scores AS (SELECT doc_id, ord, category, list_cosine_similarity(e, list_transform(range({len(WORDS)}), lambda j: CASE WHEN j = ord THEN 1.01 ELSE 0.01 END)) AS score FROM bags, cats)"""


@register("md1_bow_embed_classify", f"WITH {_BOW} SELECT doc_id, category, round(score, 6) AS score FROM scores QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, ord) = 1")
def bow_embed_classify(spark: SparkSession, d: str) -> DataFrame:
    from .models import WordBag, embed_column

    cats = spark.createDataFrame([(i, w, [1.01 if j == i else 0.01 for j in range(len(WORDS))]) for i, w in enumerate(WORDS)], "ord int, category string, vec array<double>")
    rows = embed_column(table(spark, d, "documents").select("doc_id", "text"), WordBag(WORDS)).select("doc_id", "vec")
    best = F.get("ranked", F.lit(0))
    return rank.ranked(rows, cats).select("doc_id", best["category"].alias("category"), F.round(best["score"], 6).alias("score"))


# Clustering: labels stand for clusters

_UNIT = _V + ", u AS (SELECT vec_id, truth AS cluster, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v)"
_TOTALS = _UNIT + """, sums AS (SELECT cluster, list(x ORDER BY pos) AS s FROM (SELECT cluster, pos, sum(x) AS x FROM (SELECT cluster, unnest(e) AS x, unnest(range(len(e))) AS pos FROM u) GROUP BY ALL) GROUP BY cluster),
totals AS (SELECT vec_id, cluster, list_dot_product(e, s) AS total FROM u JOIN sums USING (cluster)),
medoids AS (SELECT cluster, vec_id, total FROM totals QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(total, 9) DESC, vec_id) = 1)"""


def clustered(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).withColumnRenamed("truth", "cluster")


@register("jn8_pairwise_similarity", f"WITH {_V}, o AS (SELECT vec_id, e, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM v), g AS (SELECT * FROM o WHERE n <= 300 OR i IN (SELECT (s * n) // 300 FROM range(300) t(s))) SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.e, b.e), 6) AS sim FROM g a JOIN g b ON a.vec_id < b.vec_id")
def pairwise_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of the gathered sample of 300, as the clustering step takes them."""
    some = rules.even_sample(vectors(spark, d).select(F.col("vec_id").alias("key"), "vec"), "key", 300)
    return rank.pairs(some).select("i", "j", F.round("sim", 6).alias("sim"))


@register("md10_medoid_update", f"WITH {_TOTALS} SELECT cluster, vec_id, round(total, 6) AS total FROM medoids")
def medoid_update(spark: SparkSession, d: str) -> DataFrame:
    return cluster.medoids(clustered(spark, d), "vec_id").select("cluster", "vec_id", F.round("total", 6).alias("total"))


@register("md10_medoid_assign", f"WITH {_TOTALS} SELECT u.vec_id, m.cluster, round(list_dot_product(u.e, c.e), 6) AS score FROM u, medoids m JOIN u c ON c.vec_id = m.vec_id QUALIFY row_number() OVER (PARTITION BY u.vec_id ORDER BY list_dot_product(u.e, c.e) DESC, m.cluster) = 1")
def medoid_assign(spark: SparkSession, d: str) -> DataFrame:
    rows = clustered(spark, d)
    held = cluster.medoids(rows, "vec_id").select("cluster", "vec_id").join(rows.select("vec_id", "vec"), "vec_id")
    return cluster.assign(rows.select("vec_id", "vec"), held).select("vec_id", "cluster", F.round("score", 6).alias("score"))


def _rounds(n: int) -> str:
    """The rounds of k-medoids, one after another."""
    parts = ["m0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cluster, vec_id FROM u WHERE vec_id IN (3, 40, 77, 101, 230))"]
    for i in range(n):
        parts.append(f"l{i} AS (SELECT u.vec_id, m.cluster, u.e FROM u, m{i} m JOIN u c ON c.vec_id = m.vec_id QUALIFY row_number() OVER (PARTITION BY u.vec_id ORDER BY list_dot_product(u.e, c.e) DESC, m.cluster) = 1)")
        parts.append(f"s{i} AS (SELECT cluster, list(x ORDER BY pos) AS s FROM (SELECT cluster, pos, sum(x) AS x FROM (SELECT cluster, unnest(e) AS x, unnest(range(len(e))) AS pos FROM l{i}) GROUP BY ALL) GROUP BY cluster)")
        parts.append(f"m{i + 1} AS (SELECT cluster, vec_id FROM l{i} JOIN s{i} USING (cluster) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(list_dot_product(e, s), 9) DESC, vec_id) = 1)")
    return f"WITH {_V}, u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v), {', '.join(parts)} SELECT vec_id, cluster::INT AS cluster FROM l{n - 1}"


@register("md10_k_medoids", _rounds(4))
def k_medoids(spark: SparkSession, d: str) -> DataFrame:
    """All rows in five clusters, four rounds from given seeds."""
    return cluster.k_medoids(vectors(spark, d), "vec_id", 5, start=[3, 40, 77, 101, 230], steps=4)


@register("ag7_cluster_objective", f"WITH {_TOTALS} SELECT round(sum(total), 5) AS objective FROM medoids")
def cluster_objective(spark: SparkSession, d: str) -> DataFrame:
    return cluster.objective(clustered(spark, d), "vec_id").select(F.round("objective", 5).alias("objective"))


@register("wn6_central_members", f"WITH {_TOTALS} SELECT cluster, vec_id, rank, round(total / sqrt(list_dot_product(s, s)), 6) AS centrality FROM (SELECT t.*, s, row_number() OVER (PARTITION BY t.cluster ORDER BY round(total / sqrt(list_dot_product(s, s)), 9) DESC, vec_id) AS rank FROM totals t JOIN sums USING (cluster)) WHERE rank <= 8")
def central_members(spark: SparkSession, d: str) -> DataFrame:
    return cluster.central(clustered(spark, d), "vec_id", 8).select("cluster", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("centrality", 6).alias("centrality"))


@register("ag6_cluster_centroid", f"WITH {_TOTALS} SELECT cluster, unnest(range(len(s))) AS pos, round(unnest(list_transform(s, lambda x: x / sqrt(list_dot_product(s, s)))), 6) AS x FROM sums")
def cluster_centroid(spark: SparkSession, d: str) -> DataFrame:
    centre = mean_vectors(clustered(spark, d), ["cluster"], "vec", normalised=True)
    return centre.select("cluster", F.posexplode("centre").alias("pos", "x")).select("cluster", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@register("ag8_group_sizes", "SELECT label AS cluster, count(*) AS n, count(*) >= 2 AS grouped FROM embeddings GROUP BY label")
def group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return cluster.sizes(clustered(spark, d))


@register("ag9_merge_groups", "SELECT CASE WHEN path IN (2) THEN NULL ELSE 'Area/Topic ' || path END AS path, count(*) AS n_members, count(DISTINCT label) AS n_groups, sum(vec_id)::BIGINT AS id_sum FROM (SELECT vec_id, label, label % 4 AS path FROM embeddings) GROUP BY 1".replace("count(*) AS n_members", "count(*)::INT AS n_members").replace("count(DISTINCT label) AS", "count(DISTINCT label)::INT AS"))
def merge_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups named by label modulo 4; one of the names is not a usable path, and its members are kept ungrouped."""
    m = F.col("cluster") % 4
    path = F.when(m == 2, "a/../b").otherwise(F.concat(F.lit("Area/Topic "), m))
    groups = clustered(spark, d).groupBy("cluster").agg(F.array_sort(F.collect_list("vec_id")).alias("members")).withColumn("path", path)
    return cluster.merge_named(groups).select("path", "n_members", "n_groups", F.aggregate("members", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))


@register("md11_over_split_k", "SELECT n, CASE WHEN n < 4 THEN 1 ELSE greatest(3, least(30, CAST(round_even(n / 3, 0) AS BIGINT), n // 2)) END AS k FROM range(1, 301) t(n)")
def over_split_k(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1, 301).select(F.col("id").alias("n"), cluster.group_count(F.col("id")).alias("k"))


@register("md11_over_split")
def over_split(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of the gathered sample; the seeding follows a generator that SQL lacks."""
    some = rules.even_sample(vectors(spark, d).select("vec_id", "vec"), "vec_id", 300)
    return cluster.over_split(some, "vec_id")


_SHORT = r"substr(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), 1, 220)"
_FOUND = "CASE " + " ".join(f"WHEN contains(u, '{w}') THEN '{w}'" for w in WORDS) + " END"


@register(
    "md12_named_groups",
    f"""WITH d AS (SELECT doc_id, coalesce(source, '-') || '/' || coalesce(lang, '-') || '/' || doc_id % 5 AS cluster, row_number() OVER (PARTITION BY source, lang, doc_id % 5 ORDER BY doc_id) AS rank, {_SHORT} AS t FROM documents),
g AS (SELECT cluster, count(*) AS n, sum(doc_id)::BIGINT AS id_sum, min(doc_id) AS first, lower(count(*) || ' files. Typical ones:' || chr(10) || string_agg('- doc ' || doc_id || ': ' || t, chr(10) ORDER BY rank) FILTER (rank <= 8)) AS u FROM d GROUP BY cluster HAVING count(*) >= 2)
SELECT cluster, n::INT AS n, id_sum, coalesce('Found/' || upper({_FOUND}[1:1]) || {_FOUND}[2:], 'Unsorted/Group') AS path, CASE WHEN {_FOUND} = 'the' THEN 'what is known' ELSE 'Files like ' || first END AS description FROM g""",
)
def named_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of documents named by the first known word that stands in what is shown of them."""
    from .models import WordBag
    from .operators import naming

    docs = table(spark, d, "documents")
    cluster_ = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.col("doc_id") % 5)
    rank_ = F.row_number().over(Window.partitionBy("source", "lang", F.col("doc_id") % 5).orderBy("doc_id"))
    members = docs.select(cluster_.alias("cluster"), rank_.alias("rank"), F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("doc "), "doc_id").alias("name"), "text")
    taxonomy = spark.createDataFrame([(0, "Found/The", "what is known")], "ord int, category string, description string")
    found = naming.named(members, taxonomy, WordBag(WORDS))
    total = F.aggregate("members", F.lit(0).cast("long"), lambda a, m: a + m.cast("long"))
    return found.select("cluster", "n", total.alias("id_sum"), "path", "description")


# Streams


def observations(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("sig"), ts.alias("observed_at"), F.lit(False).alias("gone"))


_RUNS = f"""WITH o AS (SELECT event_id, user_id, event_type, ts, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS change FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(change) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM o),
b AS (SELECT *, min(ts) OVER (PARTITION BY user_id, run) AS since FROM r),
s AS (SELECT user_id, run, min(ts) AS settled, min(since) AS since, min(event_type) AS sig FROM b WHERE epoch_us(ts) - epoch_us(since) >= {SETTLE_SECONDS} * 1000000::BIGINT GROUP BY ALL)"""
_MICROS = "CAST(user_id AS VARCHAR) AS path, sig, epoch_us(since) AS since_us, epoch_us(settled) AS settled_us"


def _micros(df: DataFrame) -> DataFrame:
    return df.select("path", "sig", F.unix_micros("since").alias("since_us"), F.unix_micros("settled_at").alias("settled_us"))


@register("st2_settled_runs", f"{_RUNS} SELECT {_MICROS} FROM s")
def settled_runs(spark: SparkSession, d: str) -> DataFrame:
    return _micros(watch.settled_runs(observations(spark, d), SETTLE_SECONDS))


_FIRST = f"{_RUNS} SELECT {_MICROS} FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY settled) = 1"


@register("st2_first_settled", _FIRST)
def first_settled(spark: SparkSession, d: str) -> DataFrame:
    return _micros(watch.first_settled(observations(spark, d), SETTLE_SECONDS))


@register("st2_settle_stream", _FIRST)
def settle_stream(spark: SparkSession, d: str) -> DataFrame:
    """The stateful stream over the same events, drained at once; its state lives in the checkpoint folder."""
    import uuid

    from .runtime import shared_root

    at = f"{shared_root(spark)}/settle-{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    ts = F.col("ts").cast("timestamp")
    rows = events.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("sig"), ts.alias("observed_at"), F.lit(False).alias("gone"))
    query = watch.settle_stream(rows, SETTLE_SECONDS).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return _micros(spark.read.schema("path string, sig string, since timestamp, settled_at timestamp").parquet(f"{at}/out"))


@register("st1_watch_restart", "SELECT DISTINCT 'part=' || event_id % 40 AS name FROM events WHERE event_id % 40 % 3 <> 0 AND event_id % 40 < 30")
def watch_restart(spark: SparkSession, d: str) -> DataFrame:
    """Folders written from the events and watched over a restart: those there before are left alone, those that come between the
    two looks are not settled yet."""
    import uuid

    from .runtime import shared_root

    at = f"{shared_root(spark)}/watch-{uuid.uuid4().hex}"
    box = f"{at}/box".removeprefix("file://")
    events = table(spark, d, "events").withColumn("part", F.col("event_id") % 40)
    put = lambda rows: rows.write.partitionBy("part").mode("append").parquet(f"{at}/box")
    put(events.where("part % 3 = 0"))
    before = watch.present(spark, [box], ["_*", ".*"])
    before.write.parquet(f"{at}/before")
    put(events.where("part % 3 <> 0 and part < 30"))
    for _ in range(2):
        looks = watch.observe(spark, [box], ["_*", ".*"])
        found = watch.watch_stream(looks, 0, spark.read.schema(before.schema).parquet(f"{at}/before"))
        found.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
        put(events.where("part >= 30"))
    return spark.read.schema("path string").parquet(f"{at}/out").select(F.element_at(F.split("path", "/"), -1).alias("name"))


@register("st5_sweep_ready", "SELECT event_id, epoch_us(ts) <= epoch_us(TIMESTAMP '2024-01-20 00:00:00') - 8000000 AS ready FROM events")
def sweep_ready(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("mtime"))
    return watch.sweep(entries, F.lit("2024-01-20 00:00:00").cast("timestamp"), 8).select("event_id", "ready")


@register("st6_route", f"WITH {_VERDICT} SELECT vec_id, CASE WHEN review THEN 'asked' ELSE 'filed' END AS route FROM items")
def route(spark: SparkSession, d: str) -> DataFrame:
    return watch.route(decided(spark, d), "ask").select("vec_id", "route")


@register("ag10_folder_signature", "SELECT l_orderkey AS folder, count(*) AS n, sum(l_linenumber)::BIGINT AS total, epoch_us(max(l_shipdate)) AS newest FROM lineitem GROUP BY l_orderkey")
def folder_signature(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("folder"), F.col("l_partkey").alias("rel"), F.col("l_linenumber").alias("size"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("mtime"))
    return folders.signatures(files, ["rel", "mtime", "size"])


@register(
    "ex19_folder_texts",
    r"""WITH f AS (SELECT source AS folder, CASE doc_id % 3 WHEN 0 THEN 'md' WHEN 1 THEN 'TXT' ELSE lang END AS ext, printf('%07d', doc_id) || '.' || ext AS name, doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY name) AS place FROM f QUALIFY place <= 121),
k AS (SELECT folder, '.' || lower(ext) AS ext, count(*) AS n, min(place) AS first FROM p GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY n DESC, first) AS rank FROM k),
m AS (SELECT folder, string_agg(ext || '×' || n, ', ' ORDER BY rank) AS mixture FROM r WHERE rank <= 8 GROUP BY folder),
w AS (SELECT folder, count(*) AS n, string_agg(name, ', ' ORDER BY place) FILTER (place <= 15) AS names, min_by('From ' || name || ': ' || substr(t, 1, 400), place) FILTER (place <= 20 AND t <> '' AND doc_id % 4 <> 0) AS excerpt FROM p GROUP BY folder)
SELECT w.folder, sha256(CASE WHEN n > 120 THEN 'over 120' ELSE n || '' END || ' files: ' || mixture || chr(10) || 'Names: ' || names || coalesce(chr(10) || excerpt, '')) AS sha256 FROM w JOIN m ON w.folder IS NOT DISTINCT FROM m.folder""",
)
def folder_texts(spark: SparkSession, d: str) -> DataFrame:
    """Sources are folders; of each at most 120 files are looked at, and every fourth cannot be read."""
    docs = table(spark, d, "documents")
    kind = F.when(F.col("doc_id") % 3 == 0, "md").when(F.col("doc_id") % 3 == 1, "TXT").otherwise(F.col("lang"))
    name = F.concat(F.format_string("%07d", "doc_id"), F.lit("."), kind)
    files = docs.select(F.col("source").alias("folder"), name.alias("name"), name.alias("rel"), "doc_id", "text")
    return folders.folder_texts(files, readable=F.col("doc_id") % 4 != 0, many=120).select("folder", F.sha2("text", 256).alias("sha256"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Ranked verdicts with margin, confidence and review for every embedding."""
    return decided(spark, d).select("vec_id", "category", "confidence", "via", "review", F.array_join("alternatives", ",").alias("alternatives"))


from . import queries_files  # noqa: E402, F401  (registers its queries here)
