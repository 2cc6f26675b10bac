"""DuckDB SQL for the queries that SQL can express, at the same parameters."""

from __future__ import annotations

import math

from . import mixing, reputation, secrets, winnow

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def mix() -> str:
    return rf"""
WITH rows AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    -ln((CAST(('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 13)) AS BIGINT) + 1) / 4503599627370496.0)
      / greatest(0.1, 1 - 4.0 * len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>!]')) / greatest(length(coalesce(text, '')), 1)) AS key
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM sizes),
weighed AS (SELECT *, CAST(rank % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0 AS cap FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
goal AS (SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM levels),
epochs AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM goal),
upto AS (
  SELECT r.doc_id, r.size, e.*, sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM rows r JOIN epochs e ON r.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN epochs < 3 AND 2 * upto - size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM upto"""


SUBSTRING = rf"""
WITH docs AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM docs)),
twice AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT doc_id, list(DISTINCT i + j) AS spots FROM win JOIN twice USING (g), range(35) t(j) GROUP BY doc_id),
kept AS (
  SELECT doc_id, len(ws) AS n, coalesce(len(spots), 0) AS cut, array_to_string(list_filter(ws, lambda w, i: spots IS NULL OR NOT list_contains(spots, i)), ' ') AS rest
  FROM docs LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(cut AS BIGINT) AS n_removed, sha256(rest) AS kept_sha256 FROM kept"""

MINHASH = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce({_LOWER}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
sets AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM docs WHERE len(ws) >= 5)
    UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM docs WHERE len(ws) BETWEEN 1 AND 4)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS m FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM common JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * m >= 85 * (x.n + y.n - m)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT a, v FROM reach JOIN links ON b = u)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, r.root AS component_id, d.doc_id = r.root AND coalesce(n, 0) > 0 OR (coalesce(n, 0) = 0) AS kept
FROM docs d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a, min(b) AS root FROM reach GROUP BY a) r ON r.a = d.doc_id"""

DECONTAMINATION = rf"""
WITH docs AS (SELECT doc_id, list_filter(string_split_regex(coalesce({_LOWER}, ''), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
items AS (SELECT item_id, list_filter(string_split_regex(coalesce({_LOWER}, ''), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM items WHERE len(ws) > 0)),
own AS (
  SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)),
hits AS (SELECT doc_id, i, own.n, item_id FROM own JOIN win ON own.g = win.g AND own.n = win.n),
words AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hits, range(13) t(j) WHERE j < n GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)"""


def url_verdicts() -> str:
    second = ", ".join(f"'{s}'" for s in reputation.SECOND_LEVEL)
    text = action = "NULL"
    for what, where, begin in sorted(reputation.RULES, key=lambda r: len(r[1] + r[2])):
        fits = f"(host = '{where}' OR ends_with(host, '.{where}')) AND starts_with(path, '{begin}')"
        text, action = f"CASE WHEN {fits} THEN '{where + begin}' ELSE {text} END", f"CASE WHEN {fits} THEN '{what}' ELSE {action} END"
    rho = "(sum(CASE WHEN n > 0 THEN n * pow(s / n - parent, 2) / (parent * (1 - parent)) END) - count(CASE WHEN n > 0 THEN 1 END)) / nullif(sum(CASE WHEN n > 0 THEN n - 1 END), 0)"
    cut = math.log(reputation.FLOOR / (1 - reputation.FLOOR))
    log1p = lambda x: f"(CASE WHEN {x} > 0 THEN {x} + ln(1 + exp(-({x}))) ELSE ln(1 + exp({x})) END)"
    at = lambda x: f"exp(a * ({x} - mode) - (a + b) * ({log1p(x)} - {log1p('mode')}))"
    n = reputation.STEPS
    side = lambda lo, hi: f"CASE WHEN {hi} > {lo} THEN list_sum(list_transform(range({n + 1}), lambda i: {at(f'({lo} + ({hi} - {lo}) / {n} * i)')} * CASE WHEN i IN (0, {n}) THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END)) * ({hi} - {lo}) / {n} / 3 ELSE 0 END"
    k = lambda t: f"(SELECT 1 / least(greatest(coalesce({rho}, 0), 1 / 1001), 0.5) - 1 FROM {t})"
    return rf"""
WITH parsed AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
known AS (SELECT doc_id AS page_id, count(*) AS n, sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS s FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id),
counts AS (SELECT host, coalesce(sum(n), 0) AS n, coalesce(sum(s), 0) AS s, string_split(regexp_replace(host, '^[^@]*@|:[0-9]*$', '', 'g'), '.') AS part FROM parsed LEFT JOIN known USING (page_id) GROUP BY host),
named AS (SELECT host, n, s, part, len(part) > 2 AND length(part[-1]) = 2 AND part[-2] IN ({second}) AS long FROM counts),
level0 AS (SELECT host, n, s, array_to_string(part[greatest(len(part) - long::INT, 1):], '.') AS suffix, array_to_string(part[greatest(len(part) - 1 - long::INT, 1):], '.') AS domain FROM named),
domain0 AS (SELECT domain, suffix, sum(n) AS n, sum(s) AS s FROM level0 GROUP BY ALL),
suffix0 AS (SELECT suffix, sum(n) AS n, sum(s) AS s FROM domain0 GROUP BY suffix),
suffix1 AS (SELECT *, (SELECT (coalesce(sum(s), 0) + 1) / (coalesce(sum(n), 0) + 2) FROM suffix0) AS parent FROM suffix0),
suffix2 AS (SELECT suffix, n AS near, (s + k * parent) / (n + k) AS mean FROM (SELECT *, {k('suffix1')} AS k FROM suffix1)),
domain1 AS (SELECT d.*, near, mean AS parent FROM domain0 d JOIN suffix2 USING (suffix)),
domain2 AS (SELECT domain, suffix, near, (s + k * parent) / (n + k) AS mean FROM (SELECT *, {k('domain1')} AS k FROM domain1)),
host1 AS (SELECT h.*, near, mean AS parent FROM level0 h JOIN domain2 USING (domain, suffix)),
host2 AS (SELECT host, near, CAST(s + k * parent AS DOUBLE) AS a, CAST(n - s + k * (1 - parent) AS DOUBLE) AS b FROM (SELECT *, {k('host1')} AS k FROM host1)),
host3 AS (SELECT *, {cut} AS cut, ln(a / b) AS mode, {reputation.REACH} * sqrt(1 / a + 1 / b) AS wide FROM host2),
host4 AS (SELECT *, least(cut, greatest(mode - wide, -30)) AS l0, greatest(cut, least(mode + wide, 30)) AS r1 FROM host3),
host5 AS (SELECT *, greatest(l0, least(cut, mode + wide)) AS l1, least(r1, greatest(cut, mode - wide)) AS r0 FROM host4),
sides AS (SELECT *, {side('l0', 'l1')} + CASE WHEN l0 = -30 THEN {at('l0')} / a ELSE 0 END AS under, {side('r0', 'r1')} + CASE WHEN r1 = 30 THEN {at('r1')} / b ELSE 0 END AS over FROM host5),
verdicts AS (SELECT host, CASE WHEN near > 0 AND CASE WHEN under + over > 0 THEN under / (under + over) WHEN mode < cut THEN 1 ELSE 0 END >= {reputation.SURE} THEN 'block' ELSE 'allow' END AS verdict FROM sides)
SELECT page_id, host, path, {text} AS rule, coalesce({action}, verdict) AS verdict FROM parsed JOIN verdicts USING (host)"""


def line_dedup() -> str:
    run = winnow.GRAM + winnow.SPAN - 1
    after = " || ".join(f"chr(10) || coalesce(lead(k, {j}) OVER w, '')" for j in range(1, winnow.GRAM))
    return rf"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
every AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS raw FROM cut),
lines AS (
  SELECT doc_id, i, x, md5(x) AS k, length(x) AS size, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, count(*) OVER (PARTITION BY doc_id) AS n
  FROM (SELECT doc_id, i, regexp_replace(raw, '^[ 	-
]+|[ 	-
]+$', '', 'g') AS x FROM every) WHERE x <> ''),
grams AS (SELECT doc_id, pos, n, md5(k || {after}) AS g FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
least AS (
  SELECT doc_id, pos, n, min(g || lpad(CAST(pos AS VARCHAR), 9, '0')) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {winnow.SPAN - 1} FOLLOWING) AS m FROM grams),
posts AS (
  SELECT DISTINCT doc_id, m[1:32] AS g, CAST(m[33:] AS BIGINT) AS place FROM least WHERE pos <= greatest(n - {winnow.SPAN}, 0)
  UNION SELECT doc_id, md5(k || repeat(chr(10), {winnow.GRAM - 1})), pos FROM lines WHERE size >= {winnow.HEAVY}),
placed AS (SELECT *, first_value(doc_id) OVER w AS home, first_value(place) OVER w AS spot, row_number() OVER w AS rn FROM posts WINDOW w AS (PARTITION BY g ORDER BY doc_id, place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
matches AS (SELECT DISTINCT doc_id, home, spot - place AS shift, place FROM placed WHERE rn > 1),
diagonals AS (SELECT DISTINCT doc_id, home, shift FROM matches),
same AS (
  SELECT d.*, a.pos, a.size, a.n, a.pos - row_number() OVER (PARTITION BY d.doc_id, d.home, d.shift ORDER BY a.pos) AS island
  FROM diagonals d JOIN lines a ON a.doc_id = d.doc_id JOIN lines b ON b.doc_id = d.home AND b.pos = a.pos + d.shift AND b.x = a.x),
runs AS (SELECT doc_id, home, shift, island, min(pos) AS lo, max(pos) AS hi, sum(size) AS size, min(n) AS n FROM same GROUP BY ALL),
long AS (
  SELECT DISTINCT r.doc_id, lo, hi FROM runs r JOIN matches m ON m.doc_id = r.doc_id AND m.home = r.home AND m.shift = r.shift AND m.place BETWEEN lo AND hi
  WHERE hi - lo + 1 >= least({run}, n) OR size >= {winnow.LONG}),
gone AS (SELECT DISTINCT l.doc_id, l.i FROM lines l JOIN long r ON l.doc_id = r.doc_id AND l.pos BETWEEN r.lo AND r.hi),
n AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS m, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS spots FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(coalesce(m, 0) AS BIGINT) AS n_removed, sha256(coalesce(spots, '')) AS removed_sha256
FROM cut LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id)"""


def secret_spans() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for number, rule in enumerate(secrets.BASE + secrets.MORE):
        parts.append(rf"""
  SELECT doc_id, {number} AS rule, '{rule.kind}' AS kind,
    CAST(list_sum(list_transform(gap[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hit[1:i - 1], lambda h: length(h))), 0) AS BIGINT) AS s, length(hit[i]) AS n, length(part[i]) AS judged
  FROM (SELECT doc_id, gap, hit, part, unnest(range(1, len(hit) + 1)) AS i FROM (
    SELECT doc_id, string_split_regex(t, {quote(rule.pattern)}) AS gap, regexp_extract_all(t, {quote(rule.pattern)}, 0) AS hit, regexp_extract_all(t, {quote(rule.pattern)}, {rule.group}) AS part
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))) WHERE length(part[i]) >= {rule.least}""")
    base = len(secrets.BASE)
    counts = ", ".join(f"CAST(count(*) FILTER (rule = {i}) AS BIGINT) AS n_{r.kind}" for i, r in enumerate(secrets.BASE))
    return rf"""
WITH spans AS ({' UNION ALL '.join(parts)}),
shown AS (SELECT doc_id, rule, s, kind || ':' || s || ':' || (s + n) AS span FROM spans),
g AS (
  SELECT doc_id, {counts}, coalesce(string_agg(span, ',' ORDER BY s, rule) FILTER (rule < {base}), '') AS base, string_agg(span, ',' ORDER BY s, rule) AS spans
  FROM shown GROUP BY doc_id)
SELECT doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN g USING (doc_id)"""


SQL = {
    "op2_source_mix": mix(),
    "op3_substring_dedup": SUBSTRING,
    "op5_minhash": MINHASH,
    "op6_url_reputation": url_verdicts(),
    "op8_decontaminate": DECONTAMINATION,
    "op9_line_dedup": line_dedup(),
    "op10_secrets": secret_spans(),
}
