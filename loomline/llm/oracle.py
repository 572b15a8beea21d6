"""DuckDB SQL for the queries that SQL can express on whole tables."""

from .license_scan import TEMPLATES

OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2
  ) p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 5 * p.c >= 4 * (x.n + y.n - p.c)
), keyed AS (SELECT doc_id, md5(string_agg(s, chr(10) ORDER BY s)) AS k FROM sh GROUP BY doc_id),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
cls AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a),
lk AS (SELECT p.a AS doc_id, count(*) AS n_links, count(DISTINCT CASE WHEN y.k <> x.k THEN y.k END) AS n_text_links
  FROM pairs p JOIN keyed x ON x.doc_id = p.a JOIN keyed y ON y.doc_id = p.b GROUP BY p.a)
SELECT d.doc_id, c.class_id, CAST(coalesce(l.n_links, 0) AS BIGINT) AS n_links, CAST(coalesce(l.n_text_links, 0) AS BIGINT) AS n_text_links
FROM documents d JOIN cls c USING (doc_id) LEFT JOIN lk l USING (doc_id)
"""

OP2 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, strlen(t) AS n, sha1(t) AS h FROM p),
e AS (
  SELECT *, array_to_string(list_transform(range(0, 160), lambda i:
    CAST((instr('0123456789abcdef', h[i // 4 + 1]) - 1) >> (3 - i % 4) & 1 AS VARCHAR)), '') AS bits FROM d
), f AS (
  SELECT *, array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
    16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT) + 4 * CAST(bits[5 * i + 3] AS INT)
    + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT) + 1]), '') AS digest, max(page_id) OVER (PARTITION BY h) AS chosen FROM e
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM chosen OR chosen IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM chosen THEN NULL ELSE chosen END AS refers_to
FROM f
"""

OP4 = r"""
WITH lists AS (SELECT ['.', '!', '?', ':', chr(10)] AS stops, string_split('% $ € £ ° km m cm mm mi ft in kg g mg lb oz l ml s sec min h hr hour hours day days week weeks month months year years mph kmh usd eur dollar dollars euro euros cent cents percent degrees meters metres miles feet inches grams litres liters minutes seconds', ' ') AS units),
src AS (
  SELECT 0 AS kind, doc_id AS id, text FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 1, item_id, text FROM benchmark WHERE text IS NOT NULL
), raw AS (
  SELECT DISTINCT kind, id, text, regexp_extract_all(text, '(\p{N}+(?:[.,]\p{N}+)*|[\p{L}\p{M}]+|[%$€£°]|[.!?:\n])', 1) AS t FROM src
), marked AS (
  SELECT kind, id, md5(text) AS text, list_filter(list_transform(t, lambda x, i:
    CASE WHEN list_contains(stops, x) THEN NULL
      WHEN regexp_matches(x, '^\p{N}') THEN '#' || lower(x)
      WHEN list_contains(units, lower(x)) AND i > 1 AND regexp_matches(t[i - 1], '^\p{N}') THEN '~' || lower(x)
      WHEN regexp_matches(x, '^\p{Lu}\p{Ll}') AND i > 1 AND NOT list_contains(stops, t[i - 1]) THEN '@' || lower(x)
      ELSE lower(x) END), lambda x: x IS NOT NULL) AS t FROM raw, lists
), tokens AS (
  SELECT kind, id, text, list_filter(t, lambda x, i: NOT (x[1] = '@' AND i > 1 AND coalesce(t[i - 1][1] = '@', false))) AS t FROM marked
), sizes AS (SELECT DISTINCT least(len(t), 5) AS s FROM tokens WHERE kind = 1 AND len(t) > 0 UNION SELECT 5),
win AS (
  SELECT kind, id, text, s, unnest(list_transform(range(0, len(t) - s + 1), lambda p: struct_pack(place := p, w := t[p + 1:p + s]))) AS u
  FROM tokens, sizes WHERE len(t) >= s AND (kind = 0 OR s = least(len(t), 5))
), parts AS (
  SELECT kind, id, text, s, u.place AS place, u.w AS w, list_filter(u.w, lambda x: x[1] IN ('#', '@', '~')) AS slots FROM win
), keyed AS (
  SELECT kind, id, text, place, s, CASE WHEN len(slots) > s - CAST(ceil(3 * s / 5.0) AS INT) THEN '=' || array_to_string(w, ' ')
    ELSE array_to_string(list_transform(w, lambda x: CASE WHEN x[1] IN ('#', '@', '~') THEN x[1] ELSE x END), ' ') END AS form,
    list_transform(slots, lambda x: x[2:]) AS slots FROM parts
), hits AS (
  SELECT d.id AS doc_id, d.text AS dt, i.id AS item_id, i.text AS it, i.s AS s, d.place - i.place AS diagonal, i.place AS ip, list_zip(i.slots, d.slots) AS pairs
  FROM keyed d JOIN keyed i ON d.kind = 0 AND i.kind = 1 AND d.form = i.form
), spans AS (
  SELECT doc_id, dt, item_id, it, s, diagonal - k AS lo, w, list_distinct(list(ip)) AS places, list_distinct(flatten(list(pairs))) AS pairs
  FROM hits, range(5) a(w), range(5) b(k) WHERE k <= w GROUP BY ALL
), facts AS (
  SELECT id AS item_id, text AS it, len(t) AS size, list_transform(t, lambda x: x[1] NOT IN ('#', '@', '~')) AS literal FROM tokens WHERE kind = 1
), covered AS (
  SELECT *, list_distinct(flatten(list_transform(places, lambda p: range(p, p + s)))) AS c FROM spans JOIN facts USING (item_id, it)
  WHERE len(list_distinct(list_transform(pairs, lambda x: x[1]))) = len(pairs) AND len(list_distinct(list_transform(pairs, lambda x: x[2]))) = len(pairs)
), measured AS (SELECT *, len(c) AS n, len(list_filter(c, lambda p: literal[p + 1])) AS literals FROM covered),
best AS (
  SELECT doc_id, dt, item_id, max(struct_pack(n := len(places), c := n / size, s := len(pairs))) AS b FROM measured
  WHERE CASE WHEN len(list_filter(literal, lambda x: x)) > 7 THEN literals >= 7 AND (n + 1 >= floor(0.5 * size) OR literals >= 13)
    ELSE n + CAST(NOT list_contains(c, 0) AS INT) = size AND (8 * literals >= 5 * n OR len(list_filter(pairs, lambda x: x[1] <> x[2])) = 0) END
  GROUP BY ALL
)
SELECT doc_id, item_id, CAST(b.n AS BIGINT) AS n_windows, CAST(b.c AS DOUBLE) AS coverage, CAST(b.s AS BIGINT) AS n_slots FROM best
"""

OP5 = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT r, unnest(list_transform(range(1, len(ws) - 33), lambda p: struct_pack(p := p, h := md5(array_to_string(ws[p:p + 34], ' '))))) AS u FROM w WHERE len(ws) >= 35
), again AS (SELECT u.h AS h FROM win GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT r, list_sort(list_distinct(flatten(list(range(u.p, u.p + 35))))) AS g FROM win JOIN again ON u.h = again.h GROUP BY r),
kept AS (
  SELECT w.doc_id, len(ws) AS n, coalesce(len(g), 0) AS k, CASE WHEN g IS NULL THEN ws ELSE
    list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: NOT list_contains(g, x[2])), lambda x: x[1]) END AS rest
  FROM w LEFT JOIN gone USING (r)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(k AS BIGINT) AS n_removed, sha256(array_to_string(rest, ' ')) AS kept_sha256 FROM kept
"""

OP6 = r"""
WITH a AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, row_number() OVER () AS r FROM documents
), win AS (SELECT r, unnest(list_transform(range(1, len(ws) - 1), lambda i: struct_pack(i := i, s := array_to_string(ws[i:i + 2], ' ')))) AS u FROM a WHERE len(ws) >= 3
), rep AS (SELECT r, u.i AS i FROM win QUALIFY count(*) OVER (PARTITION BY r, u.s) > 1
), cov AS (SELECT r, count(DISTINCT i + j) AS n FROM rep, range(3) x(j) GROUP BY r),
stop AS (SELECT list_distinct(string_split('the of and to in that is for it with as on be at by this are or from der die das und in zu den mit von ist nicht auf für ein eine im dem de la le les et des en un une du que dans pour qui sur au par el los las y del se por con una para es al lo como', ' ')) AS words),
s AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines, len(list_filter(words, lambda x: list_contains(ws, x))) AS n_stop
  FROM a LEFT JOIN cov USING (r), stop
), v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / greatest(n_words, 1) BETWEEN 2.0 AND 16.0 AND n_symbols / greatest(word_chars, 1) <= 0.2 AND n_stop >= 2
  AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AS kept
FROM v
"""

OP7 = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(coalesce(text, ''))) AS r FROM documents
), win AS (
  SELECT r, u AS p, md5(substr(h, 2 * u + 1, 200)) AS s FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 99)) AS u FROM d WHERE len(h) >= 200)
), late AS (SELECT r, p FROM win QUALIFY row_number() OVER (PARTITION BY s ORDER BY r, p) > 1
), marked AS (SELECT r, p, CASE WHEN p <= 100 + lag(p) OVER (PARTITION BY r ORDER BY p) THEN 0 ELSE 1 END AS opens FROM late
), numbered AS (SELECT r, p, sum(opens) OVER (PARTITION BY r ORDER BY p) AS k FROM marked
), spans AS (SELECT r, k, min(p) AS a, max(p) + 100 AS b FROM numbered GROUP BY r, k
), gaps AS (
  SELECT r, k, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY k), 0) AS after FROM spans
), cut AS (
  SELECT d.r, sum(b - a) AS gone, count(*) AS n, string_agg(substr(h, CAST(2 * after + 1 AS BIGINT), CAST(2 * (a - after) AS BIGINT)), '' ORDER BY k) || substr(any_value(h), CAST(2 * max(b) + 1 AS BIGINT)) AS kept
  FROM gaps JOIN d USING (r) GROUP BY d.r
)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""

_NOTICES = ", ".join("({}, '{}', '{}')".format(k, name, text.replace("'", "''")) for k, (name, text) in enumerate(TEMPLATES))
OP8 = (
    r"""
WITH RECURSIVE tpl(k, name, text) AS (VALUES """
    + _NOTICES
    + r"""), src AS (
  SELECT 0 AS kind, row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents UNION ALL SELECT 1, k, NULL, text FROM tpl
), tok AS (
  SELECT kind, r, doc_id, list_transform(regexp_extract_all(t, '[0-9A-Za-z\x{80}-\x{10FFFF}]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w,
    list_transform(regexp_split_to_array(t, '[0-9A-Za-z\x{80}-\x{10FFFF}]+'), lambda x: len(x)) AS g FROM src
), sh AS (
  SELECT kind, r, u.i AS i, u.s AS s FROM (SELECT kind, r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [struct_pack(i := CAST(0 AS BIGINT), s := array_to_string(w, ' '))]
    ELSE list_transform(range(len(w) - 4), lambda p: struct_pack(i := p, s := array_to_string(w[p + 1:p + 5], ' '))) END) AS u FROM tok)
), own AS (SELECT DISTINCT r AS k, s FROM sh WHERE kind = 1
), sizes AS (SELECT r AS k, count(DISTINCT s) AS size, CAST(ceil(count(*) / 0.8 - 1e-9) AS BIGINT) AS reach FROM sh WHERE kind = 1 GROUP BY r
), hits AS (SELECT sh.r, own.k, sh.i, sh.s FROM sh JOIN own USING (s) WHERE sh.kind = 0
), held AS (
  SELECT a.r, a.k, a.i, b.s, min(b.i) AS place FROM hits a JOIN sizes USING (k) JOIN hits b ON a.r = b.r AND a.k = b.k AND b.i >= a.i AND b.i < a.i + reach GROUP BY ALL
), opens AS (
  SELECT r, k, i, count(*) AS n, max(place) AS last, any_value(size) AS size FROM held JOIN sizes USING (k) GROUP BY r, k, i HAVING count(*) >= 0.8 * any_value(size) - 1e-9
), follows AS (SELECT a.r, a.k, a.i, min(b.i) AS j FROM opens a JOIN opens b ON a.r = b.r AND a.k = b.k AND b.i > a.last GROUP BY ALL
), walk(r, k, i) AS (SELECT r, k, min(i) FROM opens GROUP BY r, k UNION ALL SELECT f.r, f.k, f.j FROM walk w JOIN follows f ON f.r = w.r AND f.k = w.k AND f.i = w.i
), found AS (
  SELECT tok.doc_id, tpl.name, walk.k, n / size AS share, w, g, o.i AS a, least(o.last + 5, len(w)) - 1 AS b
  FROM walk JOIN opens o ON o.r = walk.r AND o.k = walk.k AND o.i = walk.i JOIN tok ON tok.kind = 0 AND tok.r = walk.r JOIN tpl ON tpl.k = walk.k
)
SELECT doc_id, name AS license, CAST(k AS INT) AS template, CAST(list_sum(g[1:a + 1]) + coalesce(list_sum(list_transform(w[1:a], lambda x: len(x))), 0) AS BIGINT) AS start,
  CAST(list_sum(g[1:b + 1]) + list_sum(list_transform(w[1:b + 1], lambda x: len(x))) AS BIGINT) AS stop, CAST(share AS DOUBLE) AS containment FROM found
"""
)

OP12 = r"""
WITH src AS (
  SELECT 0 AS kind, row_number() OVER () AS r, doc_id AS id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), item_id, text FROM benchmark
), tok AS (
  SELECT kind, r, unnest(list_transform(regexp_extract_all(text, '[0-9A-Za-z\x{80}-\x{10FFFF}]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS t FROM src WHERE text IS NOT NULL
), tf AS (SELECT r, t, count(*) AS tf FROM tok WHERE kind = 0 GROUP BY r, t
), ln AS (SELECT r, count(*) AS n FROM tok WHERE kind = 0 GROUP BY r
), st AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM ln
), w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, st GROUP BY t, docs
), q AS (SELECT r AS q, t, count(*) AS k FROM tok WHERE kind = 1 GROUP BY r, t
), s AS (
  SELECT q.q, tf.r, CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // len)))) AS BIGINT) AS score
  FROM q JOIN w USING (t) JOIN tf USING (t) JOIN ln ON ln.r = tf.r, st GROUP BY q.q, tf.r
), best AS (
  SELECT s.q, d.id AS doc_id, score, row_number() OVER (PARTITION BY s.q ORDER BY score DESC, d.id) AS rank FROM s JOIN src d ON d.kind = 0 AND d.r = s.r WHERE score > 0
)
SELECT b.id AS item_id, CAST(rank AS INT) AS rank, doc_id, score FROM best JOIN src b ON b.kind = 1 AND b.r = best.q WHERE rank <= 20
"""

OP13 = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p
), g AS (
  SELECT lang, k, unnest(list_transform(range(0, len(w) - k + 1), lambda i: array_to_string(w[i + 1:i + k], ' '))) AS g FROM w, range(1, 5) x(k) WHERE len(w) >= k
), f AS (SELECT lang, CAST(k AS INT) AS k, g, count(*) AS a FROM g GROUP BY lang, k, g
), n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (SELECT *, string_split(g, ' ') AS w FROM f WHERE k > 1 AND a >= 30
), cut AS (
  SELECT c.lang, c.g, c.a, CAST(i AS INT) AS i, l.a AS l, r.a AS r, CAST((2000000::HUGEINT * c.a) // (l.a::HUGEINT + r.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS i FROM c) c JOIN f l ON l.lang = c.lang AND l.g = array_to_string(c.w[1:i], ' ') JOIN f r ON r.lang = c.lang AND r.g = array_to_string(c.w[i + 1:], ' ')
), low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, i) = 1
), inside AS (
  SELECT lang, g, max(a) AS longer FROM (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS g, a FROM c, range(2, 4) y(s), range(1, 4) z(i) WHERE s < k AND i + s - 1 <= k) GROUP BY lang, g
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT low.lang, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, low.g) AS rank, low.g AS phrase, a, l, r, n, score
  FROM low JOIN n USING (lang) LEFT JOIN inside USING (lang, g) WHERE NOT coalesce(100::HUGEINT * longer >= 80::HUGEINT * a, false)
) WHERE rank <= 2000
"""

#: tokenizers and entropy are not SQL's: tests hold the other queries against brute force
SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": OP1,
    "op2_warc": OP2,
    "op4_decontamination": OP4,
    "op5_substring_dedup": OP5,
    "op6_quality_rules": OP6,
    "op7_suffix_dedup": OP7,
    "op8_license_scan": OP8,
    "op12_lexical_search": OP12,
    "op13_collocations": OP13,
}
