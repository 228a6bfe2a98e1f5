"""SQL for DuckDB that gives the rows of those queries that SQL can express."""

from __future__ import annotations

from .license_scan import CLOSE, TEMPLATES, THRESHOLD, rules

SPACED = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def alnum(text: str = LOW) -> str:
    return rf"list_filter(string_split_regex({text}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


SUBSTRING = f"""
WITH w AS (SELECT doc_id, {SPACED} AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
f AS (SELECT k, min(doc_id) AS m FROM g GROUP BY k),
h AS (SELECT DISTINCT doc_id, i + j AS p FROM g JOIN f USING (k), range(13) r(j) WHERE m < doc_id),
l AS (SELECT doc_id, p, ws[p] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
c AS (SELECT l.doc_id, count(h.p) AS n_removed, string_agg(word, ' ' ORDER BY l.p) FILTER (WHERE h.p IS NULL) AS kept FROM l LEFT JOIN h ON h.doc_id = l.doc_id AND h.p = l.p GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN c USING (doc_id)
"""

LEAKS = f"""
WITH b AS (SELECT item_id, {alnum()} AS ws FROM benchmark),
i AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[a:a + least(10, len(ws)) - 1], ' ') AS k FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS a FROM b WHERE len(ws) > 0)),
w AS (SELECT doc_id, {alnum()} AS ws FROM documents),
g AS (SELECT doc_id, a, n, array_to_string(ws[a:a + n - 1], ' ') AS k FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS a FROM w, (SELECT DISTINCT n FROM i))),
m AS (SELECT doc_id, a, g.n, item_id FROM g JOIN i ON i.k = g.k AND i.n = g.n),
h AS (SELECT doc_id, count(DISTINCT a + j) AS n_hit FROM m, range(10) r(j) WHERE j < n GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), s AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\<\[>]', '', 'g')) + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 5 WHEN 'system' THEN 15 ELSE 14 + length(role) END AS size FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""


def licenses() -> str:
    """Base places by comparing words in turn; template labels by trying every run of every paragraph with every template."""
    rows = []
    for k, r in enumerate(rules([*TEMPLATES, *CLOSE], THRESHOLD)):
        texts = ", ".join(f"{r[c]!r}::VARCHAR[]" for c in ("set", "order", "own", "ends"))
        rows.append(f"({k}, '{r['label']}', {texts}, {r['need']}, {r['run']}, '{r['terms']}')")
    phrase = "CASE WHEN ws[a:a + 3] = ['gnu', 'general', 'public', 'license'] THEN 'gpl' WHEN ws[a:a + 1] = ['apache', 'license'] THEN 'apache' WHEN ws[a:a + 1] = ['cc', 'by'] THEN 'cc-by' WHEN ws[a:a + 1] = ['mit', 'license'] THEN 'mit' END"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
w AS (SELECT row, doc_id, {alnum()} AS ws FROM d),
p AS (SELECT row, a - 1 AS spot, {phrase} AS label FROM (SELECT row, ws, unnest(range(1, len(ws) + 1)) AS a FROM w)),
b AS (SELECT row, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word FROM p WHERE label IS NOT NULL GROUP BY 1),
t(k, label, tw, ordered, own, ends, need, run, terms) AS (VALUES {", ".join(rows)}),
l AS (SELECT row, {alnum("block")} AS bw FROM (SELECT row, unnest(string_split_regex({LOW}, '\n[ \t\r\f\x0B]*\n')) AS block FROM d)),
f AS (SELECT row, bw, t.* FROM l JOIN t ON len(bw) >= need AND len(list_intersect(tw, bw)) >= need),
c AS (SELECT f.* EXCLUDE (bw), bw[i:i + run - 1] AS part FROM f, LATERAL (SELECT unnest(range(1, len(bw) + 1)) AS i)),
u AS (SELECT c.* EXCLUDE (part), part[:COALESCE(list_min(list_transform(ends, lambda x: NULLIF(list_position(part, x), 0))) - 1, run)] AS part FROM c),
v AS (SELECT u.*, len(list_intersect(tw, part)) AS n, list_filter(list_transform(ordered, lambda x: COALESCE(list_position(part, x), 0)), lambda x: x > 0) AS stand FROM u),
m AS (SELECT row, label, CAST(n AS DOUBLE) / len(tw) AS share FROM v WHERE n >= need AND len(list_intersect(own, part)) = len(own) AND contains(' ' || array_to_string(part, ' ') || ' ', terms) AND stand = list_sort(stand)),
s AS (SELECT row, max(share) AS best FROM m GROUP BY 1),
bl AS (SELECT row, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT row, label FROM p WHERE label IS NOT NULL) GROUP BY 1),
al AS (SELECT row, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT row, label FROM p WHERE label IS NOT NULL UNION SELECT row, label FROM m) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(bl.labels, '') AS base_labels, coalesce(al.labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS score
FROM w LEFT JOIN b USING (row) LEFT JOIN s USING (row) LEFT JOIN bl USING (row) LEFT JOIN al USING (row)
"""
