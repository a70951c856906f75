"""DuckDB SQL for the pipeline operators that SQL can express."""

from __future__ import annotations

from .phrase_index import WIDTH
from .shared import LOWER, UPPER
from .warc_fixity import PAGES

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
WITH made AS (
  SELECT page_id, page_id // {PAGES} AS archive,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>'
    || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages
), placed AS (
  SELECT page_id, archive, encode(record) AS bytes, strlen(record) AS length,
    coalesce(sum(strlen(record)) OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
  FROM made
), hit AS (SELECT *, page_id % 89 AS kind FROM placed WHERE page_id % 89 IN (11, 23, 37, 53))
SELECT archive, CASE WHEN kind = 53 THEN "offset" + 17179869184 ELSE "offset" END AS "offset",
  CASE kind WHEN 37 THEN 'missing' WHEN 53 THEN 'extra' ELSE 'changed' END AS status,
  CASE WHEN kind <> 53 THEN length END AS left_length,
  CASE kind WHEN 11 THEN length WHEN 23 THEN length // 2 WHEN 53 THEN length END AS right_length,
  CASE WHEN kind <> 53 THEN sha256(bytes) END AS left_hash,
  CASE kind WHEN 11 THEN sha256(bytes[1:length - 1] || encode('X')) WHEN 23 THEN sha256(bytes[1:length // 2]) WHEN 53 THEN sha256(bytes) END AS right_hash
FROM hit
"""

OP9 = f"""
WITH item_words AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT item_id, array_to_string(list_slice(w, i, i + {WIDTH} - 1), ' ') AS said, least(len(w), {WIDTH}) AS n
  FROM item_words, unnest(generate_series(1, greatest(len(w) - {WIDTH} + 1, 1))) AS s(i) WHERE len(w) > 0
),
widths AS (SELECT DISTINCT n FROM windows),
doc_words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
starts AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS said
  FROM doc_words, widths, unnest(generate_series(1, len(w) - n + 1)) AS s(i)
),
met AS (SELECT DISTINCT doc_id, i, starts.n, item_id FROM starts JOIN windows USING (said, n)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM met, unnest(generate_series(i, i + n - 1)) AS s(p) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


OP12 = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, regexp_extract_all(said, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS said FROM documents)
),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
phrases AS (
  SELECT lang, k, list_slice(w, i, i + k - 1) AS p, count(*) AS f
  FROM pieces, unnest([1, 2, 3, 4]) AS s(k), unnest(generate_series(1, len(w) - k + 1)) AS t(i) GROUP BY lang, k, p HAVING count(*) >= 30
),
split AS (
  SELECT lang, k, p, f AS a, j, list_slice(p, 1, j) AS head, list_slice(p, j + 1, k) AS rest
  FROM phrases, unnest([1, 2, 3]) AS s(j) WHERE j < k
),
cuts AS (
  SELECT split.*, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score
  FROM split JOIN phrases x ON x.lang = split.lang AND x.p = split.head JOIN phrases y ON y.lang = split.lang AND y.p = split.rest
),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
around AS (
  SELECT lang, list_slice(p, i, i + m - 1) AS p, max(f) AS f
  FROM phrases, unnest([2, 3]) AS s(m), unnest(generate_series(1, k - m + 1)) AS t(i) WHERE m < k GROUP BY ALL
),
ranked AS (
  SELECT lowest.lang, array_to_string(lowest.p, ' ') AS phrase, a, l, r, score,
    row_number() OVER (PARTITION BY lowest.lang ORDER BY score DESC, a DESC, encode(array_to_string(lowest.p, ' '))) AS rank
  FROM lowest LEFT JOIN around ON around.lang = lowest.lang AND around.p = lowest.p
  WHERE around.f IS NULL OR 100 * around.f < 80 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

OP13 = f"""
WITH lines AS (
  SELECT doc_id, line, place, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents)
),
owners AS (SELECT key, min(doc_id) AS owner FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (owner <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (owner IS NULL OR owner = doc_id), '')) AS kept_sha256
FROM lines LEFT JOIN owners USING (key) GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_fixity": OP1, "op9_phrase_index": OP9, "op12_itemset_phrases": OP12, "op13_line_runs": OP13}
