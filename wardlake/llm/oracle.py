"""SQL counterparts of those corpus queries that SQL can express on whole tables."""

from __future__ import annotations

import string

ORACLE: dict[str, str] = {}

_LOWERED = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_SPLIT = "list_filter(regexp_split_to_array({0}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

ORACLE["op6_digest_index"] = f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_LOWERED} AS t FROM documents) WINDOW g AS (PARTITION BY t)"""

ORACLE["op7_doubling_windows"] = f"""
WITH split AS (SELECT doc_id, {_SPLIT.format("coalesce(text, '')")} AS words FROM documents),
  windows AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS start, words FROM split WHERE len(words) >= 20),
  hashed AS (SELECT doc_id, start, array_to_string(words[start : start + 19], ' ') AS w FROM windows),
  marked AS (SELECT doc_id, start, row_number() OVER (PARTITION BY w ORDER BY doc_id, start) > 1 AS again FROM hashed),
  gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS place FROM marked WHERE again),
  places AS (SELECT doc_id, list(place) AS places FROM gone GROUP BY doc_id)
SELECT s.doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN places IS NULL THEN words ELSE list_filter(words, lambda w, i: NOT list_contains(places, i)) END, ' ')) AS kept_sha256
FROM split s LEFT JOIN places p ON s.doc_id = p.doc_id"""

ORACLE["op10_line_spread"] = """
WITH lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
  keyed AS (SELECT *, trim(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    ')) AS k FROM lines),
  sites AS (SELECT k, count(DISTINCT coalesce('s' || source, '')) AS n, min(struct_pack(d := doc_id, p := pos)) AS first FROM keyed WHERE k <> '' GROUP BY k),
  marked AS (SELECT doc_id, pos, line, coalesce(n >= 5 AND first <> struct_pack(d := doc_id, p := pos), false) AS gone FROM keyed LEFT JOIN sites USING (k)),
  texts AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS t FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS text_sha256
FROM documents d LEFT JOIN texts t ON d.doc_id = t.doc_id"""

ORACLE["op8_jaccard_tiles"] = f"""
WITH RECURSIVE split AS (SELECT doc_id, {_SPLIT.format(_LOWERED)} AS words FROM documents),
  members AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 3
    THEN list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i : i + 2], ' ')) ELSE [array_to_string(words, ' ')] END) AS s
    FROM split WHERE len(words) > 0),
  sizes AS (SELECT doc_id, count(*) AS n FROM members GROUP BY doc_id),
  common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM members a JOIN members b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
  links AS (SELECT x, y FROM common JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id WHERE 100 * c >= 90 * (p.n + q.n - c)),
  reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT x, min(y) AS least FROM reach GROUP BY x) ON d.doc_id = x""".replace("least FROM documents d", "least AS component_id FROM documents d")

ORACLE["op11_pattern_tree"] = f"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWERED} AS t FROM documents),
  words AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
  counts AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
  kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 10),
  groups AS (SELECT DISTINCT lang, source FROM docs),
  langs AS (SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept USING (lang) GROUP BY lang),
  cells AS (SELECT g.lang, source, term, coalesce(n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
  totals AS (SELECT lang, source, sum(n) AS total FROM cells GROUP BY ALL),
  rates AS (SELECT c.lang, c.source, term, n, (1 + 1000000000::HUGEINT * (n + 2) // (total + 2 * v)::HUGEINT) AS p
    FROM cells c JOIN totals USING (lang, source) JOIN langs USING (lang)),
  whole AS (SELECT lang, term, (1 + 1000000000::HUGEINT * (sum(n) + 2)::HUGEINT // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * v)::HUGEINT) AS q
    FROM cells JOIN langs USING (lang) GROUP BY lang, term, v),
  pair_values AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM rates a JOIN rates b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pair_values x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
  terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value
    FROM rates JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10"""
