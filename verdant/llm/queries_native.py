"""Queries of the operators written in DataFrame functions only: quality rules, licence scans, URL filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdant.llm import licences, quality, urls
from verdant.llm.registry import query, table

_QUALITY_SQL = r"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM g) WHERE k > 1),
n AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, t, ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM l LEFT JOIN n USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 10 * n_symbols <= n_words
  AND NOT (n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines) AND word_chars >= 2 * n_words AND word_chars <= 15 * n_words AS kept,
  CAST(n_words < 50 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 50 * n_words AS BIGINT) + 4 * CAST(10 * n_symbols > n_words AS BIGINT)
  + 8 * CAST(n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines AS BIGINT) + 16 * CAST(word_chars < 2 * n_words OR word_chars > 15 * n_words AS BIGINT) AS failed FROM f"""


@query("op6_quality_rules", _QUALITY_SQL)
def _(spark, sf):
    book = quality.ledger(table(spark, sf, "documents"))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.passes(F.col("failed"), "v1")).alias("base_failed"), quality.passes(F.col("failed"), "v2").alias("kept"), "failed",
    )


@query("quality_ablation", f"""WITH q AS ({_QUALITY_SQL}), n AS (SELECT rule, bit FROM (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('repeated_lines', 8), ('word_length', 16)) AS v(rule, bit))
SELECT rule, CAST(count(*) FILTER (failed & bit <> 0) AS BIGINT) AS n_failed, CAST(count(*) FILTER (failed = bit) AS BIGINT) AS n_only, CAST(count(*) FILTER (failed IN (0, bit)) AS BIGINT) AS n_kept_without
FROM q, n GROUP BY rule""")
def _(spark, sf):
    return quality.ablation(quality.ledger(table(spark, sf, "documents")))


def _text(value) -> str:
    return "'" + value + "'" if isinstance(value, str) else str(value)


_TEMPLATE_ROWS = ", ".join("(" + ", ".join(map(_text, row)) + ")" for row in licences.word_rows())
_LICENCE_SQL = rf"""WITH t(tid, label, base, need, n, tpos, word, must) AS (VALUES {_TEMPLATE_ROWS}),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT doc_id, word, pos FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM w) WHERE word IN (SELECT word FROM t)),
df AS (SELECT word, count(DISTINCT doc_id) AS df FROM p GROUP BY word),
a AS (SELECT tid, word, tpos FROM t LEFT JOIN df USING (word) WHERE must QUALIFY row_number() OVER (PARTITION BY tid ORDER BY coalesce(df, 0), tpos) = 1),
c AS (SELECT doc_id, tid, pos - tpos AS start FROM p JOIN a USING (word)),
g AS (SELECT c.doc_id, tid, label, base, start, count(p.pos) / n AS part, bool_and(p.pos IS NOT NULL) FILTER (must) AND 100 * count(p.pos) >= need * n AS found
  FROM c JOIN t USING (tid) LEFT JOIN p ON p.doc_id = c.doc_id AND p.word = t.word AND p.pos = start + tpos GROUP BY c.doc_id, tid, label, base, need, n, start),
r AS (SELECT doc_id, count(*) FILTER (found AND base) AS n_base, min(start) FILTER (found AND base) AS first_word, max(start) FILTER (found AND base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (found AND base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (found) AS labels, max(part) AS score FROM g GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM w LEFT JOIN r USING (doc_id)"""


@query("op5_license_scans", _LICENCE_SQL)
def _(spark, sf):
    return licences.scan(table(spark, sf, "documents"))


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def _url_sql() -> str:
    upper = urls.UPPER
    fits = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{}}" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    )
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE " + fits.format(*[f"'{h}{p}'" for _, h, p in ordered]) + " END"
    decision = "CASE " + fits.format(*[f"'{v}'" for v, _, _ in ordered]) + " END"
    return rf"""WITH RECURSIVE u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parsed AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{upper.lower()}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
base AS (SELECT *, {rule} AS rule, {decision} AS decision, list_filter(string_split(regexp_replace(path, '[0-9]+', '*', 'g'), '/'), lambda s: s <> '') AS parts FROM parsed),
leaves AS (SELECT host, parts, count(*) AS n, count(rule) AS labelled, count(*) FILTER (decision = 'block') AS blocked FROM base GROUP BY 1, 2),
walk AS (SELECT host, parts, n, 0 AS level, '' AS template FROM leaves
  UNION ALL SELECT host, parts, n, level + 1, template || '/' || CASE WHEN kinds >= 32 OR (kinds >= 8 AND 2 * kinds > total) THEN '*' ELSE parts[level + 1] END
  FROM (SELECT *, count(DISTINCT parts[level + 1]) OVER (PARTITION BY host, template) AS kinds, sum(n) OVER (PARTITION BY host, template) AS total FROM walk WHERE len(parts) > level)),
nodes AS (SELECT host, parts, template FROM walk WHERE level = len(parts)),
stats AS (SELECT host, template, sum(labelled) AS l, sum(blocked) AS b, regexp_replace(template, '/[^/*]+((?:/[^/]*\*[^/]*)*)$', '/*\1') AS parent FROM nodes JOIN leaves USING (host, parts) GROUP BY 1, 2),
sib AS (SELECT *, b / l AS share FROM stats WHERE l >= 3 AND parent <> template),
pre AS (SELECT *, lag(l) OVER w AS m, lag(b) OVER w AS c, lag(share) OVER w AS before FROM sib WINDOW w AS (PARTITION BY host, parent ORDER BY share, template)),
test AS (SELECT *, (b + c) / (l + m) AS p FROM pre),
runs AS (SELECT *, sum(CASE WHEN p = 0 OR p = 1 OR (share - before) * (share - before) <= 4 * p * (1 - p) * (1 / l + 1 / m) THEN 0 ELSE 1 END) OVER (PARTITION BY host, parent ORDER BY share, template) AS run FROM test),
named AS (SELECT host, template, CASE WHEN count(*) OVER (PARTITION BY host, parent, run) > 1 THEN '~' || parent || '#' || run ELSE template END AS name FROM runs),
branches AS (SELECT s.host, s.template, l, b, coalesce(name, s.template) AS branch FROM stats s LEFT JOIN named n ON n.host = s.host AND n.template = s.template),
own AS (SELECT host, branch, (sum(b) + 1) / (sum(l) + 2) AS own FROM branches GROUP BY 1, 2 HAVING sum(l) > 0),
above AS (SELECT a.host, a.template, (sum(c.b) + 1) / (sum(c.l) + 2) AS given, length(node) AS deep
  FROM (SELECT host, template, unnest([template] || list_transform(range(length(template)), lambda i: CASE WHEN substr(template, i + 1, 1) = '/' THEN substr(template, 1, i) END)) AS node FROM stats) a
  JOIN stats c ON c.host = a.host AND (c.template = node OR starts_with(c.template, node || '/')) WHERE node IS NOT NULL AND c.l > 0 GROUP BY a.host, a.template, node),
nearest AS (SELECT host, template, arg_max(given, deep) AS given FROM above GROUP BY 1, 2),
purity AS (SELECT b.host, b.template, b.branch, coalesce(own, given, 0.5::DOUBLE) AS purity FROM branches b LEFT JOIN own o ON o.host = b.host AND o.branch = b.branch LEFT JOIN nearest n ON n.host = b.host AND n.template = b.template)
SELECT page_id, base.host AS host, path, rule, coalesce(decision, CASE WHEN purity >= 0.9 THEN 'block' ELSE 'allow' END) AS verdict, purity.branch AS template, purity
FROM base JOIN nodes ON nodes.host = base.host AND nodes.parts = base.parts JOIN purity ON purity.host = nodes.host AND purity.template = nodes.template"""


@query("op10_url_filters", _url_sql())
def _(spark, sf):
    return urls.judge(table(spark, sf, "pages"), RULES)
