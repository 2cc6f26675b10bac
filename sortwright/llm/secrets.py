"""Secret scanning over a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that any match must contain
(an AND of ORs of ANDs). The index holds the postings (trigram, document) of all trigrams in the rules'
queries; postings are intersected per rule, and the expression itself is run on the candidates
alone. A rule without a mandatory trigram scans every text.

Trigrams are those of the lower-cased text, so candidates are a superset whatever the rule's case.

Defined cases: a null text is an empty one; rows with the same id share candidates, which only adds work,
and each gets its own spans; a null id is an id like others; other columns are ignored; an empty table
gives an empty result. Matches are leftmost and do not overlap within a rule.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass
from re import _constants as K  # type: ignore[attr-defined]
from re import _parser  # type: ignore[attr-defined]

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import Workspace


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """kind, expression, and the least length of the match or of one of its groups."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


_NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + either_case("api") + "_?" + either_case("key")
BASE = (
    Rule("assign", f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]{24,}", 0, 24),
)
#: Public formats of well-known credentials.
MORE = (
    Rule("github", "gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("google", "AIza[0-9A-Za-z_-]{35}"),
    Rule("slack", "xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("stripe", "sk_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{10,}[.]eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]+"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

#: More strings than this, or larger character classes, count as unknown text.
_MANY = 64
_WIDE = 6

Query = tuple[tuple[frozenset[str], ...], ...]


class _Deriver:
    """Walks an expression, holding the strings that may stand at the current end of what is certain."""

    def __init__(self) -> None:
        self.open: set[str] = {""}
        self.clauses: list[tuple[frozenset[str], ...]] = []

    def flush(self) -> None:
        if all(len(s) >= 3 for s in self.open):
            found = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in self.open}
            self.clauses.append(tuple(sorted((f for f in found if not any(o < f for o in found)), key=sorted)))
        self.open = {""}

    def add(self, strings: set[str] | None) -> None:
        if strings is None or len(self.open) * len(strings) > _MANY:
            self.flush()
        if strings is not None and len(strings) <= _MANY:
            self.open = {a + b for a, b in itertools.product(self.open, strings)}

    def exact(self, items) -> set[str] | None:
        """All strings a part can match, if they are few."""
        own = _Deriver()
        own.walk(items)
        return own.open if own.clauses == [] and not own.broken else None

    broken = False

    def walk(self, items) -> None:
        for op, value in items:
            if op is K.LITERAL:
                self.add({chr(value).lower()})
            elif op is K.IN:
                chars = {chr(v).lower() for o, v in value if o is K.LITERAL} if all(o is K.LITERAL for o, _ in value) else None
                self.unknown() if chars is None or len(chars) > _WIDE else self.add(chars)
            elif op is K.SUBPATTERN:
                self.walk(value[3])
            elif op is K.BRANCH:
                parts = [self.exact(b) for b in value[1]]
                self.unknown() if None in parts else self.add(set().union(*parts))
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
                least, most, inner = value
                part = self.exact(inner)
                if part is not None and most is not K.MAXREPEAT and most <= 2:
                    for _ in range(least):
                        self.add(part)
                    for _ in range(most - least):
                        self.add(part | {""})
                else:
                    for _ in range(min(least, 3)):
                        self.walk(inner)
                    self.unknown()
            elif op is not K.AT:
                self.unknown()

    def unknown(self) -> None:
        self.broken = True
        self.flush()


def trigram_query(pattern: str) -> Query:
    """Clauses that all must hold; a clause holds if all trigrams of one of its sets occur. Empty: no mandatory trigram."""
    walker = _Deriver()
    walker.walk(_parser.parse(pattern))
    walker.flush()
    return tuple(walker.clauses)


def postings(docs: DataFrame, trigrams: list[str], doc_id: str, text: str) -> DataFrame:
    """The index: rows (trigram, doc_id) for the given trigrams."""
    held = F.array(*[F.lit(t) for t in trigrams])
    lower = F.lower(F.coalesce(F.col(text).cast("string"), F.lit("")))
    found = F.transform(F.array(lower), lambda x: F.filter(held, lambda t: F.contains(x, t)))[0]
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.explode(found).alias("trigram")).select("trigram", "doc_id")


def candidates(index: DataFrame, queries: dict[str, Query], trigrams: list[str]) -> DataFrame:
    """doc_id and kinds: the rules whose queries a document's postings satisfy."""
    place = {t: i for i, t in enumerate(trigrams)}
    number = F.create_map(*[x for t, i in place.items() for x in (F.lit(t), F.lit(i))])
    words = len(trigrams) // 62 + 1
    at = F.element_at(number, F.col("trigram"))
    masks = [F.bit_or(F.when(F.floor(at / 62) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (at % 62).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"m{w}") for w in range(words)]
    bits = index.groupBy("doc_id").agg(*masks)

    def has(needed: frozenset[str]) -> Column:
        need = [0] * words
        for t in needed:
            need[place[t] // 62] |= 1 << place[t] % 62
        tests = [F.col(f"m{w}").bitwiseAND(F.lit(n)) == n for w, n in enumerate(need) if n]
        return _all(tests)

    kinds = [F.when(_all([_any([has(s) for s in clause]) for clause in query]), F.lit(kind)) for kind, query in queries.items()]
    return bits.select("doc_id", F.filter(F.array(*kinds), lambda k: k.isNotNull()).alias("kinds")).where(F.size("kinds") > 0)


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """start, rule number, end and kind of each match, in code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    kind = "struct<start:int,rule:int,end:int,kind:string,ok:boolean>"
    steps = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("hit"), judged.alias("part"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(number).alias("rule"), end.alias("end"), F.lit(rule.kind).alias("kind"), (F.length(x["part"]) >= rule.least).alias("ok"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.when(F.size(found) > 0, F.filter(F.aggregate(steps, zero, step)["out"], lambda s: s["ok"])).otherwise(F.array().cast(f"array<{kind}>"))


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """One row per document: doc_id and spans, sorted by start and rule: array<struct<start,rule,end,kind>>."""
    work = Workspace(docs.sparkSession, "secrets")
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    trigrams = sorted({t for q in queries.values() for clause in q for s in clause for t in s})
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("at"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    if queries:
        index = work.save(postings(rows, trigrams, "at", "text").repartition("trigram", "doc_id").sortWithinPartitions("trigram", "doc_id"), "postings")
        rows = rows.join(candidates(index, queries, trigrams).withColumnRenamed("doc_id", "at"), "at", "left")
    else:
        rows = rows.withColumn("kinds", F.array().cast("array<string>"))
    none = F.array().cast("array<struct<start:int,rule:int,end:int,kind:string,ok:boolean>>")
    parts = [spans_of(F.col("text"), r, i) if r.kind not in queries else F.when(F.coalesce(F.array_contains("kinds", r.kind), F.lit(False)), spans_of(F.col("text"), r, i)).otherwise(none) for i, r in enumerate(rules)]
    spans = F.transform(F.array_sort(F.concat(*parts)), lambda s: F.struct(s["start"].alias("start"), s["rule"].alias("rule"), s["end"].alias("end"), s["kind"].alias("kind")))
    return rows.select("doc_id", spans.alias("spans"))
