"""DuckDB statements that give the rows of the operators' queries."""

LINE_DEDUP = r"""
WITH line AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM line
), shared AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
)
SELECT y.doc_id, count(*) AS n_lines, count(s.k) FILTER (y.doc_id <> s.keeper) AS n_dropped,
  sha256(coalesce(string_agg(y.line, chr(10) ORDER BY y.pos) FILTER (s.k IS NULL OR y.doc_id = s.keeper), '')) AS kept_sha256
FROM keyed y LEFT JOIN shared s ON y.k = s.k AND length(y.k) >= 20
GROUP BY y.doc_id
"""

QUALITY_RULES = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]'), lambda x: x <> '') AS w
  FROM documents
), lines AS (
  SELECT doc_id, t, w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
), win AS (
  SELECT doc_id, i, w[i:i + 7] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), covered AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM dup) GROUP BY doc_id
), m AS (
  SELECT lines.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM lines LEFT JOIN covered USING (doc_id)
), bits AS (
  SELECT *, (n_words < 20)::INT AS b0, (100 * n_repeat_words > 30 * n_words)::INT AS b1, (n_symbols > n_words)::INT AS b2,
    (100 * n_dup_lines > 30 * n_lines)::INT AS b3, (word_chars < 2 * n_words)::INT AS b4, (word_chars > 25 * n_words)::INT AS b5
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, b0 + b1 > 0 AS base_failed,
  b0 + b1 + b2 + b4 + b5 = 0 AS kept, (b0 + 2 * b1 + 4 * b2 + 8 * b3 + 16 * b4 + 32 * b5)::BIGINT AS fail_bits
FROM bits
"""

_HOST_PATH = r"""
coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
coalesce(regexp_extract(rest, '^[^?#]*(\?[^#]*)?', 1), '') AS query
"""

_REST = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest"


def _plain(path: str) -> str:
    """A path without dot segments, ``/`` if empty."""
    return rf"""CASE WHEN {path} = '' THEN '/' ELSE list_reduce(
  list_concat(string_split(substr({path}, 2), '/'), CASE WHEN regexp_matches({path}, '/\.\.?$') THEN [''] ELSE [] END),
  lambda a, s: CASE s WHEN '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN '.' THEN a ELSE a || '/' || s END, '') END"""


def _unescaped(text: str) -> str:
    for c in [*"/:?=#%.+;", "'", '"', "&"]:
        shown = c.replace("'", "''")
        text = f"regexp_replace({text}, '(?i)&#(0*{ord(c)}|x0*{ord(c):x});', '{shown}', 'g')"
    for name, c in (("quot", '"'), ("apos", "''"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        text = f"replace({text}, '&{name};', '{c}')"
    return text


URL_FILTERS = rf"""
WITH RECURSIVE p AS (
  SELECT *, {_plain("path")} AS plain FROM (SELECT page_id, url, html, {_HOST_PATH} FROM (SELECT *, {_REST} FROM pages))
), ref AS (
  SELECT url, host, path, host || plain || query AS u, regexp_extract(path, '^(.*)/', 1) || '/' AS folder, unnest(list_concat(
    list_transform(list_filter(regexp_extract_all(coalesce(html, ''), '(?is)<link\s[^>]*>'),
      lambda t: regexp_matches(t, '(?is)\srel\s*=\s*["'']?[^"''>]*\bcanonical\b')),
      lambda t: regexp_extract(t, '(?is)\shref\s*=\s*["'']?\s*([^"''\s>]*)', 1)),
    list_transform(list_filter(regexp_extract_all(coalesce(html, ''), '(?is)<meta\s[^>]*>'),
      lambda t: regexp_matches(t, '(?is)\shttp-equiv\s*=\s*["'']?refresh\b')),
      lambda t: regexp_extract(t, '(?is)\scontent\s*=[^>]*?\burl\s*=\s*["'']?\s*([^"''\s>]*)', 1)))) AS escaped
  FROM p WHERE host <> ''
), read AS (
  SELECT *, {_unescaped("escaped")} AS r FROM ref WHERE escaped <> ''
), target AS (
  SELECT u, CASE WHEN regexp_matches(r, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN r WHEN regexp_matches(r, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(r, '//') THEN 'http:' || r WHEN starts_with(r, '/') THEN 'http://' || host || r
    WHEN starts_with(r, '?') THEN 'http://' || host || path || r WHEN starts_with(r, '#') THEN url ELSE 'http://' || host || folder || r END AS url
  FROM read
), edge AS (
  SELECT DISTINCT u, host || {_plain("path")} || query AS v FROM (SELECT u, {_HOST_PATH} FROM (SELECT u, {_REST} FROM target WHERE url IS NOT NULL)) WHERE host <> ''
), both_ways AS (
  SELECT u, v FROM edge WHERE u <> v UNION SELECT v, u FROM edge WHERE u <> v
), reach(a, b) AS (
  SELECT u, u FROM both_ways UNION SELECT a, v FROM reach JOIN both_ways ON b = u
), place AS (
  SELECT b AS n, {_HOST_PATH} FROM (SELECT DISTINCT b, b AS rest FROM reach)
), rules(action, h, pre) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fit AS (
  SELECT host, path, arg_max(h || pre, length(h || pre)) AS rule, arg_max(action, length(h || pre)) AS action
  FROM (SELECT host, path FROM p UNION SELECT host, plain FROM p UNION SELECT host, path FROM place)
  JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY host, path
), told AS (
  SELECT p.*, f.rule, coalesce(f.action, g.action) AS action FROM p LEFT JOIN fit f ON p.host = f.host AND p.path = f.path LEFT JOIN fit g ON p.host = g.host AND p.plain = g.path
), bad AS (
  SELECT DISTINCT a FROM reach JOIN (
    SELECT n FROM place JOIN fit USING (host, path) WHERE action = 'block' UNION SELECT host || plain || query FROM told WHERE action = 'block') ON b = n
)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN a IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM told LEFT JOIN bad ON host <> '' AND a = host || plain || query
"""

SOURCE_MIXING = r"""
WITH size AS (
  SELECT source, sum(greatest(coalesce(length(text), 0), 1)) AS chars FROM documents GROUP BY source
), rate AS (
  SELECT source, pow(chars, 0.5) / (SELECT sum(pow(chars, 0.5)) FROM size) * 1.0 * (SELECT sum(chars) FROM size) / chars AS m FROM size
), pmf AS (
  SELECT source, k, exp(-m + k * ln(m) - lgamma(k + 1)) AS p
  FROM (SELECT source, m, unnest(range(0, ceil(m + 10 * sqrt(m) + 20)::BIGINT + 1)) AS k FROM rate)
), cdf AS (
  SELECT source, list(c ORDER BY k) AS cs FROM (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf) GROUP BY source
), drawn AS (
  SELECT d.*, len(list_filter(cs, lambda c: c <= ('0x' || substr(md5('20:' || coalesce(doc_id::VARCHAR, 'null') || ':1'), 1, 13))::BIGINT / 4503599627370496.0)) AS n
  FROM documents d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source
), copies AS (
  SELECT * EXCLUDE (n), unnest(range(0, n))::INTEGER AS copy FROM drawn
)
SELECT *, ('0x' || substr(md5('20-order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy::VARCHAR), 1, 13))::BIGINT AS mix_key FROM copies
"""

_KEYS = """
SELECT id, kind, ('0x' || substr(md5(n || ':' || piece), 1, 16))::UBIGINT AS key FROM (
  SELECT id, kind, piece, row_number() OVER (PARTITION BY id, kind, piece) AS n FROM (
    SELECT id, kind, part, string_agg(token, '' ORDER BY pos) AS piece FROM (
      SELECT id, kind, pos, token, coalesce(sum(last::INT) OVER (PARTITION BY id, kind ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part
      FROM (SELECT *, contains(token, chr(10)) OR (word <> '' AND md5(word)[1] IN ('0', '1')) AS last
        FROM (SELECT id, kind, generate_subscripts(l, 1) AS pos, unnest(l) AS token, regexp_replace(unnest(l), '[\\x20\\x09-\\x0D]+$', '') AS word
          FROM (SELECT id, kind, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*|[\\x20\\x09-\\x0D]+') AS l FROM texts))))
    GROUP BY id, kind, part))
"""

FINGERPRINTS = f"""
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS id, doc_id, coalesce(text, '') AS t FROM documents
), pair AS (
  SELECT id, doc_id, t, coalesce(lead(t) OVER (ORDER BY id), first_value(t) OVER (ORDER BY id)) AS u, length(t) AS n FROM d
), edit AS (
  SELECT *, left(t, (n - n // 2)::BIGINT) || left(u, (n // 2)::BIGINT) AS e FROM pair
), texts AS (
  SELECT id, 'own' AS kind, t FROM edit UNION ALL SELECT id, 'edited', e FROM edit
), keyed AS ({_KEYS}),
halves AS (SELECT *, key & 4294967295 AS lo, key >> 32 AS hi FROM keyed),
checked AS (SELECT *, ((lo * 1359893119::UBIGINT + hi * 1249961773::UBIGINT) >> 16) & 4294967295 AS chk FROM halves),
placed AS (
  SELECT *, unnest([((lo * 2135587861::UBIGINT + hi * 1640531527::UBIGINT) >> 24) % 4, ((lo * 1779033703::UBIGINT + hi * 1013904223::UBIGINT) >> 24) % 4 + 4,
    ((lo * 1541459225::UBIGINT + hi * 2027808485::UBIGINT) >> 24) % 4 + 8]) AS cell FROM checked
), cells AS (
  SELECT id, kind, cell, count(*) AS c, bit_xor(key) AS k, bit_xor(chk) AS x FROM placed GROUP BY ALL
), prints AS (
  SELECT id, kind, string_agg(format('{{:08x}}', coalesce(c, 0)) || format('{{:016x}}', coalesce(k, 0)) || format('{{:08x}}', coalesce(x, 0)), '' ORDER BY cell) AS f
  FROM (SELECT id, kind, cell FROM (SELECT DISTINCT id, kind FROM texts) CROSS JOIN (SELECT range::UBIGINT AS cell FROM range(12))) LEFT JOIN cells USING (id, kind, cell)
  GROUP BY id, kind
), size AS (SELECT id, kind, count(*) AS m FROM keyed GROUP BY ALL),
beside AS (SELECT id, CASE WHEN id = (SELECT max(id) FROM d) THEN 1 ELSE id + 1 END AS nid FROM d),
both_edited AS (SELECT a.id, count(*) AS s FROM keyed a JOIN keyed b ON a.id = b.id AND a.kind = 'own' AND b.kind = 'edited' AND a.key = b.key GROUP BY 1),
both_next AS (SELECT a.id, count(*) AS s FROM keyed a JOIN beside USING (id) JOIN keyed b ON b.id = nid AND a.kind = 'own' AND b.kind = 'own' AND a.key = b.key GROUP BY 1),
numbers AS (
  SELECT id, coalesce(o.m, 0) AS a, coalesce(e.m, 0) AS b, coalesce(x.m, 0) AS c, coalesce(be.s, 0) AS se, coalesce(bn.s, 0) AS sn
  FROM beside LEFT JOIN (FROM size WHERE kind = 'own') o USING (id) LEFT JOIN (FROM size WHERE kind = 'edited') e USING (id)
  LEFT JOIN (FROM size WHERE kind = 'own') x ON x.id = nid LEFT JOIN both_edited be USING (id) LEFT JOIN both_next bn USING (id)
)
SELECT doc_id, n AS n_chars, sha256(e) AS edited_sha256, o.f AS fingerprint, g.f AS edited_fingerprint,
  CASE WHEN a + b - se = 0 THEN 1.0::DOUBLE ELSE se::DOUBLE / (a + b - se) END AS near_edited,
  CASE WHEN a + c - sn = 0 THEN 1.0::DOUBLE ELSE sn::DOUBLE / (a + c - sn) END AS near_next,
  a AS n_paragraphs, a - se AS removed_in_edited, b - se AS added_in_edited
FROM edit JOIN numbers USING (id) JOIN (FROM prints WHERE kind = 'own') o USING (id) JOIN (FROM prints WHERE kind = 'edited') g USING (id)
"""

INFILL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents
), drawn AS (
  SELECT *, [('0x' || h[1:8])::BIGINT, ('0x' || h[9:16])::BIGINT, ('0x' || h[17:24])::BIGINT, ('0x' || h[25:32])::BIGINT] AS r FROM d
), form AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 90 THEN 'plain'
      WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), part AS (
  SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM form
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM part
"""

IMPORTANCE = r"""
WITH crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS v FROM range(256) r(i))
), texts AS (
  SELECT 's' AS side, row_number() OVER () AS id, doc_id, text FROM documents UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark
), words AS (
  SELECT side, id, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM texts
), feature AS (
  SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words
), bucket AS (
  SELECT f, xor(list_reduce(list_transform(range(0, octet_length(encode(f))), lambda k: ('0x' || substr(hex(encode(f)), 2 * k + 1, 2))::BIGINT),
    lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)]), 4294967295), 4294967295) % 10000 AS b
  FROM (SELECT DISTINCT f FROM feature), crc
), tally AS (
  SELECT b, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM feature JOIN bucket USING (f) GROUP BY 1
), gain AS (
  SELECT b, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM tally) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM tally) + 10000)::DOUBLE)))::BIGINT AS g FROM tally
), weighed AS (
  SELECT id, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight, count(*) AS n_features FROM feature JOIN bucket USING (f) JOIN gain USING (b) WHERE side = 's' GROUP BY 1
), scored AS (
  SELECT id, doc_id, len(w) >= 20 AS eligible, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weighed USING (id) WHERE side = 's'
), ranked AS (
  SELECT id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, 25 * count(*) OVER () // 100 AS k FROM scored WHERE eligible
)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= k THEN r END AS rank FROM scored LEFT JOIN ranked USING (id)
"""
