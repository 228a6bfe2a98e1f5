"""The filter audit as DuckDB SQL: each step of each order counted by itself."""

AUDIT = r"""WITH t AS (SELECT doc_id, COALESCE(lang, '') AS part, COALESCE(text, '') AS text FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
g AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, COALESCE(good, 0) AS good, COALESCE(toxic, 0) AS toxic,
 CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT) + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS INT)
 + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(COALESCE(u.doc_id > least, FALSE) AS INT) AS mask FROM u LEFT JOIN g USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
f AS (SELECT substr('ABCDE', CAST(i AS INT), 1) AS f FROM range(1, 6) r(i)),
p AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a JOIN f b ON b.f <> a.f JOIN f c ON c.f NOT IN (a.f, b.f) JOIN f d ON d.f NOT IN (a.f, b.f, c.f) JOIN f e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
s AS (SELECT filter_order, CAST(i AS INT) AS step, 1 << (ord(substr(filter_order, CAST(i AS INT), 1)) - 65) AS bit, CAST(COALESCE(list_sum([1 << (ord(x) - 65) FOR x IN string_split(substr(filter_order, 1, CAST(i AS INT) - 1), '') IF x <> '']), 0) AS INT) AS before FROM p, range(1, 6) r(i)),
o AS (SELECT part, filter_order, step, bit,
 COALESCE(sum(n) FILTER (WHERE mask & bit = 0 AND mask & before = 0), 0) AS kept, COALESCE(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0) AS removed,
 COALESCE(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before <> 0), 0) AS redundant, COALESCE(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
 COALESCE(sum(good) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0) AS good_lost, COALESCE(sum(toxic) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0) AS toxic_lost
 FROM c JOIN s ON TRUE GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
 CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM o"""
