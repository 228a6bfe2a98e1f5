"""The enrichment of sales as DuckDB SQL: the same results in closed form, batch by batch, without state."""

#: crc32 of a decimal number's digits, bit by bit (fixed polynomial 0xEDB88320, all ones before and after).
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(change_id AS VARCHAR), ''), lambda x: ord(x)::BIGINT)),
 lambda c, d: list_reduce(list_prepend(xor(c, d), [0::BIGINT for i in range(8)]), lambda a, z: xor(a >> 1, 3988292384::BIGINT * (a & 1)))), 4294967295::BIGINT)"""

SALES = f"""WITH batches AS (SELECT range AS batch FROM range(13)),
s AS (SELECT row_number() OVER () AS row, sale_id, client_id, sold_at, least(11, CAST(floor((date_diff('day', DATE '1970-01-01', CAST(arrived_at AS DATE)) - 19723) * 12 / 152) AS BIGINT)) AS batch FROM sales),
d AS (SELECT DISTINCT * FROM client_changes WHERE valid_at IS NOT NULL),
c AS (SELECT change_id, client_id, valid_at, op, CAST(floor(100 * balance + 0.5) AS BIGINT) AS balance_cents,
 least(11, CAST(floor((date_diff('day', DATE '1970-01-01', CAST(valid_at AS DATE)) + {_CRC} % 4 - 19723) * 12 / 152) AS BIGINT)) AS batch FROM d),
m AS (SELECT b.batch, COALESCE((SELECT max(sold_at) FROM s WHERE s.batch < b.batch), TIMESTAMP '0001-01-01') AS ws, COALESCE((SELECT max(valid_at) FROM c WHERE c.batch < b.batch), TIMESTAMP '0001-01-01') AS wc FROM batches b),
h AS (SELECT batch, wc, CASE WHEN batch = 12 THEN TIMESTAMP '9999-01-01' ELSE least(ws, wc) END AS h, lag(least(ws, wc), 1, TIMESTAMP '0001-01-01') OVER (ORDER BY batch) AS before FROM m),
v AS (SELECT c.* FROM c JOIN h USING (batch) WHERE valid_at >= wc),
base AS (SELECT client_id, h.batch, max((valid_at, change_id)) AS top FROM v JOIN h ON v.batch < h.batch AND valid_at <= h.before GROUP BY 1, 2),
left_over AS (SELECT h.batch, v.client_id, v.valid_at, v.change_id, v.balance_cents, v.op FROM v JOIN h ON v.batch <= h.batch LEFT JOIN base b ON b.batch = h.batch AND b.client_id = v.client_id WHERE v.batch = h.batch OR v.valid_at > h.before OR (v.valid_at, v.change_id) = b.top),
held AS (SELECT batch, client_id, count(*) AS n_held FROM left_over GROUP BY 1, 2),
e AS (SELECT s.row, s.sale_id, s.client_id, s.sold_at, CASE WHEN sold_at IS NULL THEN s.batch ELSE (SELECT min(h.batch) FROM h WHERE h.batch >= s.batch AND s.sold_at < h.h) END AS batch FROM s),
t AS (SELECT e.row, arg_max(l, (l.valid_at, l.change_id)) AS l FROM e JOIN left_over l ON l.batch = e.batch AND l.client_id = e.client_id AND l.valid_at <= e.sold_at GROUP BY 1)
SELECT 'sale' AS rec, e.sale_id AS id, CAST(e.batch AS BIGINT) AS batch, CAST(COALESCE(n_held, 0) AS BIGINT) AS n_held, l.change_id, l.balance_cents, l.op FROM e LEFT JOIN held USING (batch, client_id) LEFT JOIN t USING (row)
UNION ALL SELECT 'late', change_id, CAST(batch AS BIGINT), NULL, NULL, NULL, NULL FROM c JOIN h USING (batch) WHERE valid_at < wc"""
