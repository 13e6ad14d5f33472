"""DuckDB statements for the operators whose whole result SQL can express."""

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# All shingles, all pairs that share one, and components by spreading the least id.
NGRAM_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 2], ' ') END AS g
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 90 * (na.n + nb.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM documents d JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) m USING (doc_id) LEFT JOIN n USING (doc_id)"""

# Equal words by alignment, windows with two differences at most, and the best alignment of each document and item.
SPACED_SEEDS = f"""
WITH dw AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w, unnest(range(0, len(ws))) AS i FROM (SELECT doc_id,
  regexp_extract_all({_FOLD}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents)),
bw AS (SELECT item_id, len(ws) AS m, unnest(ws) AS w, unnest(range(0, len(ws))) AS j FROM (SELECT item_id,
  regexp_extract_all({_FOLD}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark)),
eq AS (SELECT doc_id, item_id, n, m, i - j AS shift, j, least(m, 13) AS win, CASE WHEN m >= 13 THEN 11 ELSE m END AS need
  FROM dw JOIN bw USING (w) WHERE m >= 3),
al AS (SELECT doc_id, item_id, n, m, shift, win, need FROM eq GROUP BY doc_id, item_id, n, m, shift, win, need HAVING count(*) >= need),
st AS (SELECT *, unnest(range(greatest(0, -shift), least(m, n - shift) - win + 1)) AS p FROM al),
gd AS (SELECT st.doc_id, st.item_id, st.m, st.shift, st.win, p FROM st JOIN eq USING (doc_id, item_id, shift)
  WHERE eq.j BETWEEN p AND p + st.win - 1 GROUP BY st.doc_id, st.item_id, st.m, st.shift, st.win, p HAVING count(*) >= max(st.need)),
cv AS (SELECT DISTINCT doc_id, item_id, m, shift, unnest(range(p, p + win)) AS j FROM gd),
sc AS (SELECT cv.doc_id, cv.item_id, cv.m, cv.shift, count(*) AS covered, count(eq.j) AS matched, min(cv.j) + cv.shift AS first
  FROM cv LEFT JOIN eq USING (doc_id, item_id, shift, j) GROUP BY cv.doc_id, cv.item_id, cv.m, cv.shift)
SELECT doc_id, item_id, CAST(m AS INTEGER) AS item_words, CAST(covered AS INTEGER) AS covered_words, CAST(matched AS INTEGER) AS matched_words,
  CAST(first AS BIGINT) AS first_word FROM sc
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY covered DESC, matched DESC, first DESC) = 1"""

# All strings of 200 bytes by their digest, the runs that repeated ones cover, and what is left between them.
REPEATED_BYTES = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT r, i, md5(b[i:i + 199]) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - 198)) AS i FROM d)),
f AS (SELECT h FROM p GROUP BY h HAVING count(*) > 1),
s AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS q FROM p SEMI JOIN f USING (h)),
g AS (SELECT r, i, sum(CASE WHEN q IS NULL OR i > q + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS k FROM s),
v AS (SELECT r, min(i) AS a, max(i) + 199 AS z FROM g GROUP BY r, k),
t AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS y FROM v),
x AS (SELECT t.r, sum(z - a + 1) AS gone, count(*) AS spans, max(z) AS last,
  string_agg(CASE WHEN a > y + 1 THEN hex(b[y + 1:a - 1]) ELSE '' END, '' ORDER BY a) AS head FROM t JOIN d USING (r) GROUP BY t.r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN gone IS NULL THEN b ELSE unhex(head || CASE WHEN last < octet_length(b) THEN hex(b[last + 1:octet_length(b)]) ELSE '' END) END) AS kept_sha256
FROM d LEFT JOIN x USING (r)"""


# Failure bits of every row, and all orders as permutations of the five letters.
FILTER_AUDIT = """
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY x) AS least FROM t),
b AS (SELECT doc_id, part, (CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * (length(x) - length(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(x) THEN 4 ELSE 0 END)
  + (CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN least < doc_id THEN 16 ELSE 0 END) AS m FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
c AS (SELECT part, m, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM b LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
f AS (SELECT unnest(range(0, 5)) AS k),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS ks FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT array_to_string(list_transform(ks, lambda k: chr(65 + k::INT)), '') AS filter_order, unnest(range(1, 6)) AS step, ks FROM o),
q AS (SELECT filter_order, step, 1 << ks[step] AS bit, coalesce(list_sum(list_transform(ks[1:step - 1], lambda k: 1 << k)), 0)::BIGINT AS before FROM s)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(sum(n) FILTER (WHERE m & (bit | before) = 0), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (WHERE m & bit <> 0 AND m & before = 0), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (WHERE m & bit <> 0 AND m & before <> 0), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (WHERE m = bit), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (WHERE m & bit <> 0 AND m & before = 0), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(toxic) FILTER (WHERE m & bit <> 0 AND m & before = 0), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * 120 // nullif(bit_count(m), 0)) FILTER (WHERE m & bit <> 0), 0) AS BIGINT) AS shapley
FROM c, q GROUP BY part, filter_order, step"""


# The checksum from its table, near words by leaving out each code point, and roots by following forms.
SPELLING_VARIANTS = """
WITH RECURSIVE tab AS (SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{C0}-\\x{FF}]+')) AS w FROM documents),
k AS (SELECT d, w, count(*) AS n, hex(encode(d || ':' || w)) AS x FROM r WHERE length(w) >= 5 GROUP BY d, w),
y AS (SELECT d, w, n, list_transform(range(1, length(x), 2), lambda i: CAST('0x' || x[i:i + 1] AS BIGINT)) AS b FROM k),
c AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295) AS h FROM y, tab),
e AS (SELECT CASE WHEN h % 97 = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:length(w)] ELSE w END AS word, n FROM c),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
g AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:length(word)] AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word AS a, b.word AS b, b.n AS bn FROM g a JOIN g b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM v a JOIN g b ON a.word = b.s UNION SELECT b.word, a.word, a.n FROM v a JOIN g b ON a.word = b.s),
m AS (SELECT a, count(*) AS n_near, first(b ORDER BY bn DESC, b) AS f, max(bn) AS fn FROM p GROUP BY 1),
o AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN fn >= 2 * v.n THEN f END AS form, CASE WHEN fn >= 2 * v.n THEN fn END AS form_n
  FROM v LEFT JOIN m ON m.a = v.word),
z(word, here) AS (SELECT word, word FROM o UNION ALL SELECT z.word, o.form FROM z JOIN o ON o.word = z.here AND o.form IS NOT NULL)
SELECT o.word, o.n, CAST(o.n_near AS BIGINT) AS n_near, o.form, CAST(o.form_n AS BIGINT) AS form_n, q.here AS root
FROM o JOIN (SELECT z.word, z.here FROM z JOIN o ON o.word = z.here WHERE o.form IS NULL) q ON q.word = o.word"""
