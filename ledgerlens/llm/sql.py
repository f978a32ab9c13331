"""DuckDB twins of the queries that SQL can express over whole tables."""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_T = LOWER.format("coalesce(text, '')")

EXACT_DEDUP = f"""
WITH t AS (SELECT doc_id, {_T} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t.t) AS text_sha256
FROM t JOIN g USING (t)
"""

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w FROM s0),
s2 AS (
  SELECT *, 3 * source_size AS cap, 3.0 * source_size / w AS r,
         coalesce(sum(3 * source_size) OVER o, 0) AS caps, coalesce(sum(w) OVER o, 0) AS ws,
         sum(source_size) OVER () AS total, sum(w) OVER () AS wall
  FROM s1 WINDOW o AS (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (
  SELECT CAST(total - caps AS DOUBLE) AS num, CAST(wall - ws AS DOUBLE) AS den
  FROM s2 WHERE cap * (wall - ws) >= w * (total - caps) ORDER BY r, source NULLS LAST LIMIT 1),
s AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), CAST(w AS DOUBLE) * num / den) AS target FROM s2, lev),
s3 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM s),
c AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT doc_id, size, source_size, target,
       CAST((whole + CASE WHEN before + size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM c JOIN s3 ON c.source IS NOT DISTINCT FROM s3.source
"""

_WORDS = "regexp_extract_all(" + LOWER.format("{}") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION = f"""
WITH i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS l, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
dw AS (
  SELECT doc_id, s, l, array_to_string(w[s : s + l - 1], ' ') AS win
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, (SELECT DISTINCT l FROM iw))),
h AS (SELECT doc_id, s, l, item_id FROM dw JOIN iw USING (l, win)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM h) GROUP BY doc_id),
x AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN x USING (doc_id)
"""

SUBSTRING_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, s, md5(array_to_string(w[s : s + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d)),
owner AS (SELECT h, min(doc_id) AS lo FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 50)) AS p FROM win JOIN owner USING (h) WHERE lo < doc_id)),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS k, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

NGRAM_JOIN = (
    """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all("""
    + _T
    + r""", '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[s : s + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, min(y)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.x = d.doc_id GROUP BY d.doc_id, n
"""
)

_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({} AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
  lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"""
_USED = "CASE WHEN h % 2 = 1 THEN t - t % 86400000000 ELSE t END"
TOLERANT_ASOF = f"""
WITH bits AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS tab
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)),
c0 AS (SELECT click_id, max(client_id) AS client_id, max(epoch_us(ts)) AS t FROM clicks GROUP BY click_id),
c1 AS (SELECT click_id, client_id, t, {_CRC.format("click_id")} AS h FROM c0, bits),
c AS (SELECT click_id, client_id, {_USED} AS ts_us FROM c1),
s0 AS (SELECT *, epoch_us(sold_at) AS t, {_CRC.format("sale_id")} AS h FROM sales, bits),
s1 AS (SELECT sale_id, client_id, {_USED} AS us, h, CAST(priority AS BIGINT) AS priority, CAST(floor(100 * total + 0.5) AS BIGINT) AS cents FROM s0),
s AS (
  SELECT client_id, us, sale_id, priority, cents FROM s1
  UNION ALL SELECT client_id, us, -1 - sale_id, 6 - priority, cents FROM s1 WHERE h % 3 <> 0),
r AS (
  SELECT *, count(*) OVER (PARTITION BY client_id, us) AS n_tied,
         row_number() OVER (PARTITION BY client_id, us ORDER BY priority DESC NULLS LAST, sale_id NULLS LAST, cents DESC NULLS LAST) AS k
  FROM s WHERE client_id IS NOT NULL AND us IS NOT NULL),
w AS (SELECT * FROM r WHERE k = 1),
m AS (SELECT c.*, w.sale_id, w.us, w.cents, w.n_tied FROM c ASOF LEFT JOIN w ON c.client_id = w.client_id AND c.ts_us >= w.us)
SELECT click_id, client_id, ts_us,
       CASE WHEN ok THEN sale_id END AS sale_id, CASE WHEN ok THEN ts_us - us END AS lag_us,
       CASE WHEN ok THEN cents END AS total_cents, CASE WHEN ok THEN n_tied ELSE 0 END AS n_tied
FROM (SELECT *, coalesce(ts_us - us <= 259200000000, false) AS ok FROM m)
"""

_TERMS = "regexp_extract_all(" + _T + r", '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
SOURCE_DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS} AS w FROM documents),
t AS (SELECT k, lang, source, unnest(w) AS term FROM d),
v AS (SELECT lang, term, count(*) AS n_all FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
x AS (
  SELECT g.lang, g.source, v.term, coalesce(n, 0) AS n, n_all,
         sum(coalesce(n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, count(*) OVER (PARTITION BY g.lang, g.source) AS kinds
  FROM g JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
l AS (SELECT lang, sum(n_all) AS lang_total FROM v GROUP BY lang),
p AS (
  SELECT lang, source, term, n, CAST(1 + (1000000000 * (CAST(n AS HUGEINT) + 1)) // (total + kinds) AS BIGINT) AS p,
         CAST(1 + (1000000000 * (CAST(n_all AS HUGEINT) + 1)) // (lang_total + kinds) AS BIGINT) AS q
  FROM x JOIN l USING (lang)),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM o)
SELECT * FROM k WHERE part = 'pair' OR rank <= 200
"""
