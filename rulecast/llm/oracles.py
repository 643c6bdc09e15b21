"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .queries import LISTED_HOSTS

#: White space of str.split() and str.strip(), as a character class.
_BLANK = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

_LINES = rf"""
WITH RECURSIVE raw AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
each AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS no FROM raw),
placed AS (
  SELECT doc_id, no, line, trim(regexp_replace(line, '[{_BLANK}]+', ' ', 'g'), ' ') AS plain
  FROM each),
lines AS (
  SELECT doc_id, no, line, plain, len(string_split(plain, ' ')) AS words,
    row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS unit
  FROM placed WHERE plain <> '')"""

LINE_DEDUP = f"""{_LINES},
runs AS (
  SELECT doc_id, unit, words, plain, lead(plain, 1) OVER w AS p1, lead(plain, 2) OVER w AS p2, lead(words, 1) OVER w AS w1
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY unit)),
wide AS (
  SELECT doc_id, unit, 3 AS n, [plain, p1, p2] AS run FROM runs WHERE p2 IS NOT NULL
  UNION ALL SELECT doc_id, unit, 2, [plain, p1] FROM runs WHERE p1 IS NOT NULL AND words + w1 >= 20
  UNION ALL SELECT doc_id, unit, 1, [plain] FROM runs WHERE words >= 20),
later AS (SELECT doc_id, unit, n, row_number() OVER (PARTITION BY run ORDER BY doc_id, unit) AS copy FROM wide),
gone AS (SELECT DISTINCT doc_id, unit + i AS unit FROM later JOIN range(3) t(i) ON i < n WHERE copy > 1),
lists AS (SELECT doc_id, count(*) AS n, string_agg(unit::VARCHAR, ',' ORDER BY unit) AS removed FROM gone GROUP BY 1),
counts AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY 1),
grown AS (
  SELECT doc_id, unit, 1 AS n, words, doc_id::HUGEINT * 100000000 + unit AS place,
    min(doc_id::HUGEINT * 100000000 + unit) OVER (PARTITION BY plain) AS earliest, count(*) OVER (PARTITION BY plain) AS met FROM lines
  UNION ALL
  SELECT g.doc_id, g.unit, g.n + 1, g.words + l.words, g.place,
    min(g.place) OVER (PARTITION BY g.earliest, l.plain), count(*) OVER (PARTITION BY g.earliest, l.plain)
  FROM grown g JOIN lines l ON l.doc_id = g.doc_id AND l.unit = g.unit + g.n WHERE g.met > 1),
longest AS (SELECT doc_id, max(n) AS n FROM grown WHERE place > earliest AND (n >= 3 OR words >= 20) GROUP BY 1)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_lines, coalesce(l.n, 0)::BIGINT AS n_removed, coalesce(l.removed, '') AS removed,
  coalesce(r.n, 0)::BIGINT AS longest_run
FROM documents d LEFT JOIN counts c USING (doc_id) LEFT JOIN lists l USING (doc_id) LEFT JOIN longest r USING (doc_id)"""

SUBSTRING_DEDUP = f"""{_LINES},
starts AS (
  SELECT doc_id, no, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no) - length(line) - 1 AS start FROM each),
breaks AS (SELECT doc_id, no, sum((plain = '')::INT) OVER (PARTITION BY doc_id ORDER BY no) AS paragraph FROM placed),
windows AS (
  SELECT doc_id, unit, list(plain) OVER w AS ps, list(words) OVER w AS ws
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY unit ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
units AS (
  SELECT doc_id, min(unit) AS first, max(unit) AS last, string_agg(plain, ' ' ORDER BY unit) AS t
  FROM lines JOIN breaks USING (doc_id, no) GROUP BY doc_id, paragraph HAVING sum(words) >= 8
  UNION ALL
  SELECT doc_id, unit, unit + k - 1, array_to_string(ps[1:k], ' ') FROM windows JOIN range(1, 9) r(k) ON k <= len(ps)
  WHERE list_sum(ws[1:k]) >= 30 AND (coalesce(list_sum(ws[1:k-1]), 0) < 30 OR coalesce(list_sum(ws[2:k]), 0) < 30)),
ranked AS (
  SELECT *, doc_id::HUGEINT * 100000000 + first AS place,
    min(doc_id::HUGEINT * 100000000 + first) OVER (PARTITION BY lower(t)) AS earliest FROM units),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS unit FROM ranked WHERE place > earliest),
spans AS (
  SELECT doc_id, start, start + length(line) AS fin FROM gone JOIN lines USING (doc_id, unit) JOIN starts USING (doc_id, no)),
lists AS (
  SELECT doc_id, count(*) AS n, sum(fin - start) AS chars, string_agg(start::BIGINT || '-' || fin::BIGINT, ',' ORDER BY start) AS spans
  FROM spans GROUP BY 1),
counts AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY 1)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_units, coalesce(l.n, 0)::BIGINT AS n_removed,
  coalesce(l.chars, 0)::BIGINT AS chars_removed, coalesce(l.spans, '') AS removed_spans
FROM documents d LEFT JOIN counts c USING (doc_id) LEFT JOIN lists l USING (doc_id)"""

URL_FILTER = rf"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
named AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':[0-9]*$', ''), '^(www|m|blog)\.', '')
    || regexp_replace(path, '(\.html|/)$', '') END AS canonical FROM split),
listed AS (SELECT DISTINCT canonical FROM named WHERE regexp_matches(host, '{LISTED_HOSTS}')),
ruled AS (
  SELECT n.*, l.canonical IS NOT NULL AS listed,
    CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
         WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
         WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM named n LEFT JOIN listed l USING (canonical))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM ruled"""

JACCARD_JOIN = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.c AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY 1) r ON r.a = d.doc_id"""

_WORD = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION = rf"""
WITH items AS (SELECT item_id, {_WORD} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i+size-1], ' '))) AS g
  FROM (SELECT item_id, w, least(13, len(w)) AS size FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT size FROM windows),
docs AS (SELECT doc_id, {_WORD} AS w FROM documents),
runs AS (
  SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS i,
    unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i+size-1], ' '))) AS g
  FROM docs, lengths WHERE len(w) >= size),
met AS (SELECT doc_id, r.size, i, item_id FROM runs r JOIN windows v ON r.size = v.size AND r.g = v.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM met) GROUP BY 1),
found AS (
  SELECT doc_id, count(*) AS n, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS h
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM met) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items,
  coalesce(h, sha256('')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)"""

COLLOCATIONS = r"""
WITH parts AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part
  FROM documents),
worded AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(part, '[^\x20\x09]+') AS w FROM parts),
words AS (SELECT id, lang, unnest(w) AS one, generate_subscripts(w, 1) AS i FROM worded),
runs AS (SELECT lang, one, lead(one, 1) OVER p AS two, lead(one, 2) OVER p AS three FROM words WINDOW p AS (PARTITION BY id ORDER BY i)),
grams AS (
  SELECT lang, 1 AS k, one AS phrase FROM runs
  UNION ALL SELECT lang, 2, one || ' ' || two FROM runs WHERE two IS NOT NULL
  UNION ALL SELECT lang, 3, one || ' ' || two || ' ' || three FROM runs WHERE three IS NOT NULL),
counts AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY 1),
found AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, j, x.f AS l, y.f AS r, (1000000 * c.f * c.f) // (x.f * y.f) AS score
  FROM found c JOIN range(1, 3) t(j) ON j < c.k
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:j], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j+1:c.k], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_parts AS (
  SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM found WHERE k = 3),
gone AS (SELECT DISTINCT s.lang, s.phrase FROM lowest s JOIN inner_parts t USING (lang, phrase) WHERE 100 * t.f >= 50 * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
  a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM lowest ANTI JOIN gone USING (lang, phrase) JOIN totals USING (lang)
QUALIFY rank <= 2000"""

EMBEDDING_DEDUP = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM vectors x JOIN vectors y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
smallest AS (SELECT a, min(b) AS c FROM reach GROUP BY 1),
degrees AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, s.c AS component_id, e.vec_id = s.c AS kept
FROM embeddings e JOIN smallest s ON s.a = e.vec_id LEFT JOIN degrees d ON d.a = e.vec_id"""

ORACLES = {
    "op2_line_dedup": LINE_DEDUP,
    "op3_url_filter": URL_FILTER,
    "op5_jaccard_join": JACCARD_JOIN,
    "op7_substring_dedup": SUBSTRING_DEDUP,
    "op10_decontamination": DECONTAMINATION,
    "op11_collocations": COLLOCATIONS,
    "op13_embedding_dedup": EMBEDDING_DEDUP,
}
