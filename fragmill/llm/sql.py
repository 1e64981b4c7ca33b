"""DuckDB SQL of the queries that SQL can express on whole tables."""

WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"

OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS.format(text="text")} AS w FROM documents),
win AS (SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
dup AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
cov AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS p FROM win WHERE s IN (SELECT s FROM dup)),
pos AS (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT pos.rid, string_agg(x, ' ' ORDER BY pos.p) AS t FROM pos LEFT JOIN cov ON pos.rid = cov.rid AND pos.p = cov.p WHERE cov.p IS NULL GROUP BY 1),
gone AS (SELECT rid, count(*) AS n FROM cov GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.rid = kept.rid LEFT JOIN gone ON d.rid = gone.rid"""

OP2 = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
win AS (SELECT rid, i, md5_number(b[i:i + 399]) AS k FROM (SELECT rid, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d WHERE octet_length(b) >= 400)),
dup AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
hit AS (SELECT rid, i FROM win WHERE k IN (SELECT k FROM dup)),
isl AS (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 400 THEN 0 ELSE 1 END AS n FROM hit),
run AS (SELECT rid, i, sum(n) OVER (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM isl),
sp AS (SELECT rid, min(i) AS s, max(i) + 399 AS e FROM run GROUP BY rid, g),
gone AS (SELECT rid, count(*) AS n_spans, sum(e - s + 1) AS n_removed FROM sp GROUP BY rid),
pieces AS (SELECT rid, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY s), 0) + 1 AS a, s - 1 AS z FROM sp UNION ALL SELECT sp.rid, max(e) + 1, any_value(octet_length(b)) FROM sp JOIN d ON sp.rid = d.rid GROUP BY sp.rid),
kept AS (SELECT p.rid, string_agg(hex(b[a:z]), '' ORDER BY a) AS h FROM pieces p JOIN d ON p.rid = d.rid WHERE z >= a GROUP BY p.rid)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(CASE WHEN n_spans IS NULL THEN b ELSE unhex(coalesce(h, '')) END) AS kept_sha256, coalesce(n_removed, 0) / greatest(octet_length(b), 1) AS share_removed
FROM d LEFT JOIN gone ON d.rid = gone.rid LEFT JOIN kept ON d.rid = kept.rid"""

OP4 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pr AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT pr.a, pr.b FROM pr JOIN n x ON pr.a = x.doc_id JOIN n y ON pr.b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(c.least, d.doc_id)) AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.a"""
