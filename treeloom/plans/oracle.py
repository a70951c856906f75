"""The SQL each query is checked against, in DuckDB's dialect.

Written from the definition of each result, not from the Spark plan: trees, for one, are
worked out from the text by counting, where the jobs parse and flatten them.
"""

from __future__ import annotations

from ..fixed_values import ENGINE_COLUMN

LANG = "CASE d.lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' WHEN 'de' THEN 'german' ELSE '.' || d.lang END"

# Fixed values, as the bindings deal them out.
FOLDERS = "['src','node_modules','lib/.git','dist','src/x.github','pkg/__pycache__','app/core']"
SUFFIXES = (
    "['a.java','b.py','c.ts','d.js','e.cpp','f.h','g.c','h.tsx','i.jsx','j.JS','k.tar.gz','Makefile','.gitignore']"
)

CODE = f"""
code AS (
  SELECT source AS repo, doc_id, {FOLDERS}[(doc_id % 7)::INT + 1] AS folder, {SUFFIXES}[(doc_id % 13)::INT + 1] AS name,
         {FOLDERS}[(doc_id % 7)::INT + 1] || '/' || doc_id || '/' || {SUFFIXES}[(doc_id % 13)::INT + 1] AS file_path,
         ['.java','.py','.ts','.js','.cpp','.h','.c','.tsx','.jsx','.JS','.gz','',''][(doc_id % 13)::INT + 1] AS ext
  FROM documents)
"""

LABEL = """CASE ext WHEN '.java' THEN 'java' WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript'
 WHEN '.tsx' THEN 'typescript' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' WHEN '.cpp' THEN 'cpp'
 WHEN '.c' THEN 'c' WHEN '.h' THEN 'c/cpp' WHEN '' THEN 'unknown' ELSE ext END"""

# Number of tokens of a text is its blanks and line feeds plus one; nodes are the document,
# its lines and its tokens.
MEASURED = f"""
measured AS (
  SELECT d.source AS repo, {LANG} AS language, d.n_chars * 1000 AS parse_ns,
         CASE WHEN d.text = '' THEN 0 ELSE len(string_split(d.text, chr(10))) END AS loc,
         CASE WHEN d.text = '' THEN 1 ELSE 1 + len(string_split(d.text, chr(10)))
              + length(regexp_replace(d.text, '[^ \\n]', '', 'g')) + 1 END AS nodes,
         CASE WHEN d.text = '' THEN 1 ELSE 3 END AS max_depth
  FROM documents d)
"""

TOTALS = """count(*)::BIGINT AS files, sum(loc)::BIGINT AS loc, coalesce(sum(nodes), 0)::BIGINT AS nodes,
 coalesce(max(max_depth), 0)::INT AS max_depth, floor(coalesce(sum(parse_ns), 0)::BIGINT / 1e6 + 0.5)::BIGINT / 1000.0::DOUBLE AS parse_sec"""

VOID = "('area','base','br','col','embed','hr','img','input','link','meta','source','track','wbr')"

# Markup, nested by counting open and close tags.
MARKUP = rf"""
clean AS (
  SELECT page_id,
    regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'),
      '(<script\b[^>]*>).*?(</script\s*>)', '\1\2', 'gis'), '(<style\b[^>]*>).*?(</style\s*>)', '\1\2', 'gis') AS h
  FROM pages),
split AS (
  SELECT page_id, regexp_extract_all(h, '<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*>[^<]*') AS tags FROM clean),
tokens AS (
  SELECT page_id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM split),
steps AS (
  SELECT *, lower(regexp_extract(tag, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS kind,
    CASE WHEN tag LIKE '</%' THEN -1
         WHEN lower(regexp_extract(tag, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) IN {VOID} OR regexp_matches(tag, '^<[^>]*/>') THEN 0
         ELSE 1 END AS step
  FROM tokens),
summed AS (
  SELECT *, sum(step) OVER (PARTITION BY page_id ORDER BY pos) AS raw FROM steps),
floored AS (
  SELECT *, raw - least(0, min(raw) OVER (PARTITION BY page_id ORDER BY pos)) AS after FROM summed),
opens AS (
  SELECT *, CASE WHEN step = 0 THEN after + 1 ELSE after END AS level,
    row_number() OVER (PARTITION BY page_id ORDER BY pos) AS node_id
  FROM floored WHERE step >= 0),
holders AS (SELECT page_id, pos, level, node_id, kind FROM opens WHERE step = 1),
ends AS (SELECT page_id, max(pos) AS last_pos FROM tokens GROUP BY 1),
finals AS (SELECT f.page_id, f.after AS final FROM floored f JOIN ends e ON f.page_id = e.page_id AND f.pos = e.last_pos),
newest AS (SELECT page_id, level, max(pos) AS newest_pos FROM holders GROUP BY 1, 2),
parented AS (
  SELECT o.*, p.node_id AS parent_id, p.kind AS parent_kind
  FROM opens o ASOF LEFT JOIN holders p ON o.page_id = p.page_id AND o.level - 1 = p.level AND o.pos > p.pos),
nodes AS (
  SELECT n.page_id, n.node_id::INT AS node_id, n.parent_id::INT AS parent_id, n.level::INT AS depth,
    (row_number() OVER (PARTITION BY n.page_id, n.parent_id ORDER BY n.pos) - 1)::INT AS ordinal,
    n.kind, n.parent_kind,
    NOT exists(SELECT 1 FROM parented c WHERE c.page_id = n.page_id AND c.parent_id = n.node_id) AS is_leaf,
    n.step = 1 AND n.level <= f.final AND w.newest_pos = n.pos AS is_error, n.step, n.tag
  FROM parented n JOIN finals f USING (page_id)
  LEFT JOIN newest w ON w.page_id = n.page_id AND w.level = n.level),
page_nodes AS (
  SELECT page_id, node_id, parent_id, depth, ordinal, kind, parent_kind,
    CASE WHEN is_leaf THEN CASE WHEN step = 0 THEN '' ELSE
      regexp_replace(regexp_extract(tag, '^<[^>]*>([^<]*)', 1), '^\s+|\s+$', '', 'g') END END AS text,
    is_leaf, coalesce(is_error, false) AS is_error
  FROM nodes)
"""


def _text_tree(table: str, keys: str) -> str:
    """Lines and tokens of a text column, with positions."""
    return f"""
lined AS (
  SELECT {keys}, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS li,
    len(string_split(text, chr(10))) AS n_lines
  FROM {table} WHERE text <> ''),
worded AS (
  SELECT {keys}, li, n_lines, line, unnest(string_split(line, ' ')) AS tok,
    generate_subscripts(string_split(line, ' '), 1) AS j, len(string_split(line, ' ')) AS n_toks
  FROM lined),
line_start AS (
  SELECT {keys}, li, line, n_lines, len(string_split(line, ' ')) AS n_toks,
    coalesce(sum(length(line) + 1) OVER (PARTITION BY {keys} ORDER BY li ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_at
  FROM lined),
tok_start AS (
  SELECT *, coalesce(sum(length(tok) + 1) OVER (PARTITION BY {keys}, li ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS col
  FROM worded)
"""


LINES = (
    _text_tree("conversations", "conv_id, turn")
    + """,
line_ids AS (
  SELECT *, (2 + coalesce(sum(1 + n_toks) OVER (PARTITION BY conv_id, turn ORDER BY li ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS line_id
  FROM line_start),
all_nodes AS (
  SELECT conv_id, turn, 1 AS node_id, NULL AS parent_id, 1 AS depth, 0 AS ordinal, 'document' AS kind, NULL AS parent_kind,
    CASE WHEN text = '' THEN '' END AS text, 1 AS start_line, 0 AS start_col, len(string_split(text, chr(10))) AS end_line,
    length(string_split(text, chr(10))[-1]) AS end_col, 0 AS start_off, length(text) AS end_off, text = '' AS is_leaf, 0 AS closes
  FROM conversations
  UNION ALL
  SELECT conv_id, turn, line_id, 1, 2, li - 1, 'line', 'document', NULL, li, 0, li, length(line), line_at, line_at + length(line), false, 0
  FROM line_ids
  UNION ALL
  SELECT t.conv_id, t.turn, l.line_id + t.j, l.line_id, 3, t.j - 1, 'token', 'line', t.tok, t.li, t.col, t.li, t.col + length(t.tok),
    l.line_at + t.col, l.line_at + t.col + length(t.tok), true,
    CASE WHEN t.j = t.n_toks THEN CASE WHEN t.li = t.n_lines THEN 2 ELSE 1 END ELSE 0 END
  FROM tok_start t JOIN line_ids l ON t.conv_id = l.conv_id AND t.turn = l.turn AND t.li = l.li)
"""
)

# The derived syntax trees: a line is as large as its tokens, and every second token is a
# method with an identifier below it.
SYNTAX = (
    _text_tree("conversations", "conv_id, turn")
    + """,
sized AS (
  SELECT *, n_toks + n_toks // 2 AS below FROM line_start),
placed AS (
  SELECT *, 2 + coalesce(sum(1 + below) OVER (PARTITION BY conv_id, turn ORDER BY li ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_id,
    ['ERROR','class_declaration','expression_statement','interface_declaration'][(li % 4) + 1] AS line_kind
  FROM sized),
toks AS (
  SELECT t.conv_id, t.turn, t.li, t.j, t.tok, p.line_id, p.line_kind, p.line_id + t.j + (t.j - 1) // 2 AS tok_id,
    CASE WHEN t.j = t.n_toks THEN CASE WHEN t.li = t.n_lines THEN 2 ELSE 1 END ELSE 0 END AS ends,
    CASE WHEN t.j = 1 THEN CASE WHEN t.li % 5 = 0 THEN 'word' ELSE 'identifier' END
         WHEN t.j % 2 = 0 THEN 'method_definition' ELSE 'punct' END AS kind
  FROM worded t JOIN placed p ON t.conv_id = p.conv_id AND t.turn = p.turn AND t.li = p.li),
tree AS (
  SELECT conv_id, turn, 1 AS node_id, NULL AS parent_id, 1 AS depth, 0 AS ordinal, 'program' AS kind, NULL AS parent_kind,
    true AS is_named, NULL AS field_name, NULL AS text, NULL AS start_line, NULL AS start_col, NULL AS end_line, NULL AS end_col,
    false AS is_leaf, 0 AS closes
  FROM conversations
  UNION ALL
  SELECT conv_id, turn, line_id, 1, 2, li - 1, line_kind, 'program', true, NULL, NULL, li, 0, li, length(line), false, 0 FROM placed
  UNION ALL
  SELECT conv_id, turn, tok_id, line_id, 3, j - 1, kind, line_kind, kind <> 'punct',
    CASE WHEN j = 1 AND li % 3 <> 0 AND li % 5 <> 0 THEN 'name' END, CASE WHEN j % 2 = 1 THEN tok END,
    li, j - 1, li, j - 1 + length(tok), j % 2 = 1, CASE WHEN j % 2 = 1 THEN ends ELSE 0 END
  FROM toks
  UNION ALL
  SELECT conv_id, turn, tok_id + 1, tok_id, 4, 0, 'identifier', 'method_definition', true, NULL, tok,
    li, j - 1, li, j - 1 + length(tok), true, ends + 1
  FROM toks WHERE j % 2 = 0)
"""
)

# Named nodes only: unnamed leaves vanish and their siblings move up.
NAMED = (
    SYNTAX
    + """,
kept AS (
  SELECT *, CASE depth WHEN 3 THEN row_number() OVER (PARTITION BY conv_id, turn, parent_id ORDER BY node_id) - 1 ELSE ordinal END AS place,
    row_number() OVER (PARTITION BY conv_id, turn ORDER BY node_id) AS number
  FROM tree WHERE is_named)
"""
)

RUNS = """
measured_runs AS (
  SELECT user_id::VARCHAR AS repo, CASE event_id % 2 WHEN 0 THEN 'generic' ELSE 'native' END AS engine, ts, event_id AS run_id,
    (props->>'$.k')::BIGINT AS k, round(value * 100)::BIGINT * 10000 AS parse_ns
  FROM events),
shown AS (
  SELECT *, floor(parse_ns / 1e6 + 0.5)::BIGINT AS ms, floor(parse_ns * 2 / 1e6 + 0.5)::BIGINT AS total_ms,
    row_number() OVER (PARTITION BY repo, engine ORDER BY ts, run_id) AS run_no
  FROM measured_runs),
pairs AS (
  SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.run_no, b.run_no) AS run_no,
    CASE WHEN a.repo IS NULL THEN 'generic' WHEN b.repo IS NULL THEN 'native' END AS missing_side,
    a.k AS ak, b.k AS bk, a.ms AS ams, b.ms AS bms, a.total_ms AS atms, b.total_ms AS btms, a.run_id AS aid, b.run_id AS bid
  FROM (SELECT * FROM shown WHERE engine = 'generic') a
  FULL JOIN (SELECT * FROM shown WHERE engine = 'native') b ON a.repo = b.repo AND a.run_no = b.run_no)
"""

EVENT_FILES = """
event_files AS (
  SELECT user_id::VARCHAR AS repo, event_type AS language, ts, (props->>'$.k')::BIGINT AS k,
    round(value * 100)::BIGINT * 10000 AS parse_ns,
    (props->>'$.k')::BIGINT * 1048576 + event_id AS rss, (props->>'$.k')::BIGINT * 524288 + event_id AS heap
  FROM events),
run_totals AS (
  SELECT repo, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp, count(*)::BIGINT AS files, sum(k)::BIGINT AS loc,
    (sum(k) * 7)::BIGINT AS nodes, max(k % 20 + 1)::INT AS max_depth, sum(parse_ns)::BIGINT AS ns, max(parse_ns * 2)::BIGINT AS total_ns,
    max(rss) AS rss, max(heap) AS heap
  FROM event_files GROUP BY repo),
run_langs AS (
  SELECT repo, language, count(*)::BIGINT AS files, sum(k)::BIGINT AS loc, (sum(k) * 7)::BIGINT AS nodes,
    max(k % 20 + 1)::INT AS max_depth, sum(parse_ns)::BIGINT AS ns
  FROM event_files GROUP BY repo, language)
"""


def _sec(ns: str) -> str:
    return f"floor({ns} / 1e6 + 0.5)::BIGINT / 1000.0::DOUBLE"


def _mb(size: str) -> str:
    return f"coalesce(floor({size} / 1048576.0::DOUBLE * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE, 0.0)"


def _round(x: str, scale: str) -> str:
    return f"floor(({x}) * {scale}::DOUBLE + 0.5) / {scale}::DOUBLE"


def _history(engines: str = "('generic')") -> str:
    return f"""
WITH {EVENT_FILES}, engines AS (SELECT unnest({engines.replace("(", "[").replace(")", "]")}) AS {ENGINE_COLUMN})
SELECT t.timestamp, p.{ENGINE_COLUMN}, t.repo, l.language, l.files, l.loc, l.nodes, l.max_depth,
  {_sec("l.ns")} AS parse_sec, {_sec("t.total_ns")} AS total_sec, {_mb("t.rss")} AS peak_rss_mb, {_mb("t.heap")} AS peak_heap_mb
FROM run_totals t JOIN run_langs l USING (repo) CROSS JOIN engines p
"""


PAGE_PATHS = r"""
paths AS (
  SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/*([?#].*)?$', '') AS folder,
    len(string_split(html, chr(10))) AS loc
  FROM pages),
up AS (
  SELECT page_id, loc, string_split(folder, '/') AS parts, unnest(generate_series(1, len(string_split(folder, '/')))) AS depth
  FROM paths),
dirs AS (
  SELECT page_id, loc, depth, array_to_string(parts[1:depth], '/') AS dir_path,
    CASE WHEN depth > 1 THEN array_to_string(parts[1:depth - 1], '/') END AS parent_path, parts[depth] AS name
  FROM up)
"""

RESPONSE = rf"""WITH {PAGE_PATHS},
            d AS (SELECT DISTINCT dir_path AS path, coalesce(parent_path, '') AS above, name FROM dirs),
            f AS (SELECT folder || '/' || page_id || '.html' AS path, folder AS above, page_id || '.html' AS name, page_id, loc FROM paths),
            e AS (SELECT path, above, name, true AS is_dir, NULL AS page_id, NULL AS loc FROM d
              UNION ALL SELECT path, above, name, false, page_id, loc FROM f),
            n AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY above ORDER BY name) = 1 THEN '' ELSE ',' END AS comma,
              '0:' || replace(path, '/', '/0:') AS spot FROM e)
            SELECT 'web' AS repo, spot AS place, comma || CASE WHEN is_dir
                THEN '{{"type":"directory","name":"' || name || '","filePath":"' || path || '","children":['
              WHEN page_id % 9 = 0 THEN '{{"type":"file","name":"' || name || '","filePath":"' || path || '","error":"unreadable"}}'
              ELSE '{{"type":"file","name":"' || name || '","filePath":"' || path || '","ast":{{"loc":' || loc || '}}}}' END AS fragment FROM n
            UNION ALL SELECT 'web', spot || '/1:', ']}}' FROM n WHERE is_dir
            UNION ALL SELECT 'web', '', '{{"nodes":[{{"type":"directory","name":"web","filePath":"","children":['
            UNION ALL SELECT 'web', '1:', ']}}],"timestamp":"2024-01-01T00:00:00.000Z","benchmark":{{"files":' || count(*) || ',"loc":' || sum(loc)::BIGINT || '}}}}' FROM paths"""

DUMPED = """
lines AS (
  SELECT source AS repo, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
  FROM documents),
waved AS (
  SELECT *, i + 2 AS node_id, CASE WHEN i % 6 <= 3 THEN i % 6 + 2 ELSE 8 - i % 6 END AS depth,
    ['DeclStmt','asm label','CallExpr'][(i % 3) + 1] AS kind
  FROM lines),
rising AS (
  SELECT w.*, CASE WHEN w.depth = 2 THEN 1 ELSE p.node_id END AS parent_id, CASE WHEN w.depth = 2 THEN 'TranslationUnit' ELSE p.kind END AS parent_kind
  FROM waved w ASOF LEFT JOIN waved p ON w.doc_id = p.doc_id AND w.depth - 1 = p.depth AND w.node_id > p.node_id)
"""


# A node's own piece of its document.
PIECE = """
pieces AS (
  SELECT conv_id, turn, node_id::INT AS node_id, CASE WHEN ordinal = 0 THEN '' ELSE ',' END || '{"type":"' || kind || '","isNamed":true,"range":{"start":{"line":'
    || start_line || ',"col":' || start_col || '},"end":{"line":' || end_line || ',"col":' || end_col || '}}'
    || CASE WHEN is_leaf THEN ',"text":' || to_json(text) || '}' || repeat(']}', closes::INT) ELSE ',"children":[' END AS fragment
  FROM all_nodes)
"""

# Every file that the analysis packs into archives, and what it makes of it.
ANALYSED = f"""
dumps AS (
  SELECT event_id, event_type, CASE event_type WHEN 'error' THEN '  ' || substring(props, 1, length(props) - 1) || chr(10)
    WHEN 'signup' THEN '{{"error":"at ' || user_id || '"}}' ELSE props END AS content FROM events),
per_page AS (SELECT page_id, count(*) AS nodes, max(depth) AS depth FROM page_nodes GROUP BY page_id),
analysed AS (
  SELECT 'docs-' || (d.doc_id // 500) AS repo, d.source || '/' || d.doc_id || '.' || d.lang AS file_path, {LANG} AS language, 'ok' AS status, d.text AS content,
    CASE WHEN d.text = '' THEN 1 ELSE 2 + len(string_split(d.text, chr(10))) + length(regexp_replace(d.text, '[^ \n]', '', 'g')) END AS nodes,
    CASE WHEN d.text = '' THEN 1 ELSE 3 END AS max_depth
  FROM documents d
  UNION ALL
  SELECT 'pages-' || (page_id // 200), 'web/' || page_id || '.html', '.html', 'ok', html, coalesce(nodes, 0), coalesce(depth, 0)
  FROM pages LEFT JOIN per_page USING (page_id)
  UNION ALL
  SELECT 'events-' || (event_id // 2000), event_type || '/' || event_id || '.json', '.json', CASE event_type WHEN 'error' THEN 'error' ELSE 'ok' END, content,
    CASE event_type WHEN 'error' THEN 0 ELSE 1 END, CASE event_type WHEN 'error' THEN 0 ELSE 1 END
  FROM dumps),
analysed_files AS (
  SELECT *, CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) END AS loc, length(content) AS chars, strlen(content) AS size FROM analysed)
"""


ANALYSIS = f"""WITH {MARKUP}, {ANALYSED},
    runs AS (SELECT repo, max(chars) * 20000 AS total, max(size) * 100 AS rss, max(chars) * 100 AS heap FROM analysed_files GROUP BY repo),
    langs AS (SELECT repo, language, count(*)::BIGINT AS files, sum(loc)::BIGINT AS loc, sum(nodes)::BIGINT AS nodes, max(max_depth)::INT AS max_depth,
      coalesce(sum(chars) FILTER (status = 'ok'), 0)::BIGINT * 10000 AS ns FROM analysed_files GROUP BY repo, language)
    SELECT '2024-01-01T00:00:00.000Z' AS timestamp, 'generic' AS {ENGINE_COLUMN}, repo, language, files, loc, nodes, max_depth, {_sec("ns")} AS parse_sec,
      {_sec("total")} AS total_sec, {_mb("rss")} AS peak_rss_mb, {_mb("heap")} AS peak_heap_mb FROM langs JOIN runs USING (repo)"""


def oracle_sql() -> dict[str, str]:
    return {
        "outline_json": f"""WITH {SYNTAX},
            methods AS (SELECT conv_id, turn, li, string_agg('{{"type":"METHOD","name":' || to_json(tok) || ',"range":{{"start":{{"line":' || li || ',"col":' || (j - 1)
              || '}},"end":{{"line":' || li || ',"col":' || (j - 1 + length(tok)) || '}}}},"children":[]}}', ',' ORDER BY j) AS js FROM toks WHERE j % 2 = 0 GROUP BY 1, 2, 3),
            firsts AS (SELECT conv_id, turn, li, CASE WHEN kind = 'identifier' THEN tok ELSE 'anonymous' END AS name FROM toks WHERE j = 1),
            parts AS (SELECT p.conv_id, p.turn, p.li, CASE WHEN p.line_kind IN ('class_declaration', 'interface_declaration')
              THEN '{{"type":"' || CASE p.line_kind WHEN 'class_declaration' THEN 'CLASS' ELSE 'INTERFACE' END || '","name":' || to_json(f.name)
                || ',"range":{{"start":{{"line":' || p.li || ',"col":0}},"end":{{"line":' || p.li || ',"col":' || length(p.line) || '}}}},"children":[' || coalesce(m.js, '') || ']}}'
              ELSE m.js END AS js
              FROM placed p JOIN firsts f USING (conv_id, turn, li) LEFT JOIN methods m USING (conv_id, turn, li))
            SELECT conv_id::VARCHAR AS repo, turn::VARCHAR AS file_path, '[' || coalesce(string_agg(js, ',' ORDER BY li), '') || ']' AS outline FROM parts GROUP BY 1, 2""",
        "page_outline": f"""WITH RECURSIVE {MARKUP},
            classes AS (SELECT unnest(['article','section','div','nav','footer','header']) AS kind,
              unnest(['ARTICLE','SECTION','BLOCK','MENU','FOOTER','HEADER']) AS class),
            climb AS (
              SELECT page_id, node_id, parent_id AS at FROM page_nodes WHERE kind IN (SELECT kind FROM classes)
              UNION ALL
              SELECT c.page_id, c.node_id, p.parent_id FROM climb c JOIN page_nodes p ON p.page_id = c.page_id AND p.node_id = c.at
              WHERE p.kind NOT IN (SELECT kind FROM classes)),
            nearest AS (SELECT c.page_id, c.node_id, max(CASE WHEN p.kind IN (SELECT kind FROM classes) THEN c.at END) AS up FROM climb c
              LEFT JOIN page_nodes p ON p.page_id = c.page_id AND p.node_id = c.at GROUP BY 1, 2),
            headings AS (SELECT page_id, parent_id AS node_id, arg_min(text, node_id) AS name FROM page_nodes WHERE kind IN ('h1','h2','h3','title') GROUP BY 1, 2)
            SELECT page_id, node_id, n.up AS outline_parent_id, class, coalesce(name, 'anonymous') AS name
            FROM nearest n JOIN page_nodes USING (page_id, node_id) JOIN classes USING (kind) LEFT JOIN headings USING (page_id, node_id)""",
        "dump_outline": r"""WITH g AS (
              SELECT source, doc_id, string_split(text, chr(10)) AS ls, unnest(generate_series(0, (len(string_split(text, chr(10))) - 1) // 6)) AS g FROM documents),
            s AS (SELECT source, doc_id, g, len(ls) - 6 * g AS n, ls[6 * g + 1:6 * g + 6] AS l,
              [',"range":{"start":{"line":' || (6 * g + k + 2) || ',"col":0},"end":{"line":0,"col":0}},"children":[' for k in [0, 1, 2, 3, 4, 5]] AS r FROM g),
            t AS (SELECT *, CASE WHEN n < 2 THEN 'anonymous' WHEN n = 2 THEN l[2] WHEN n = 3 THEN l[3] WHEN n = 4 THEN l[4] ELSE l[4] || l[5] END AS name FROM s),
            o AS (SELECT source, doc_id, g, '{"type":"CLASS","name":' || to_json(name) || r[1]
              || CASE WHEN n > 2 THEN '{"type":"METHOD","name":"anonymous"' || r[3] || CASE WHEN n > 3 THEN '{"type":"CLASS","name":"anonymous"' || r[4] || ']}' ELSE '' END || ']}' ELSE '' END
              || CASE WHEN n > 5 THEN ',{"type":"METHOD","name":"anonymous"' || r[6] || ']}' ELSE '' END || ']}' AS js FROM t)
            SELECT source AS repo, doc_id::VARCHAR AS file_path, '[' || string_agg(js, ',' ORDER BY g) || ']' AS outline FROM o GROUP BY 1, 2""",
        "offset_nodes": f"""WITH {_text_tree("conversations", "conv_id, turn")},
            l AS (SELECT *, 2 + coalesce(sum(1 + n_toks) OVER (PARTITION BY conv_id, turn ORDER BY li ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_id FROM line_start),
            n AS (SELECT conv_id, turn, 1 AS node_id, NULL AS parent_id, 1 AS depth, 0 AS ordinal, 'SourceFile' AS kind, NULL AS parent_kind, NULL AS text,
                0 AS start_off, 9 AS end_off, false AS is_leaf FROM conversations
              UNION ALL SELECT conv_id, turn, line_id, 1, 2, li - 1, 'Block', 'SourceFile', NULL, (li - 1) * 1000, (li - 1) * 1000 + length(line), false FROM l
              UNION ALL SELECT t.conv_id, t.turn, l.line_id + t.j, l.line_id, 3, t.j - 1, 'Identifier', 'Block', t.tok, (t.li - 1) * 1000 + t.j - 1,
                (t.li - 1) * 1000 + t.j - 1 + length(t.tok), true FROM worded t JOIN l USING (conv_id, turn, li))
            SELECT conv_id::VARCHAR AS repo, turn::VARCHAR AS file_path, node_id::INT AS node_id, parent_id::INT AS parent_id, depth::INT AS depth, ordinal::INT AS ordinal,
              kind, parent_kind, text, NULL::INT AS start_line, start_off::INT AS start_off, end_off::INT AS end_off, is_leaf FROM n""",
        "offset_stats": """WITH s AS (SELECT conv_id, turn, len(string_split(text, chr(10))) AS ls,
              length(regexp_replace(text, '[^ \n]', '', 'g')) + 1 AS ts FROM conversations)
            SELECT conv_id::VARCHAR AS repo, turn::VARCHAR AS file_path, (1 + ls + ts)::BIGINT AS nodes, 3::INT AS max_depth, (1 + ls + 2 * ts)::BIGINT AS compat_nodes,
              4::INT AS compat_max_depth, (1 + ls + 2 * ts)::BIGINT AS walked_nodes, 4::INT AS walked_depth FROM s""",
        "shifted_nodes": f"""WITH {_text_tree("conversations", "conv_id, turn")},
            l AS (SELECT *, 2 + coalesce(sum(1 + n_toks) OVER (PARTITION BY conv_id, turn ORDER BY li ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_id FROM line_start),
            n AS (SELECT conv_id, turn, 1 AS node_id, NULL AS parent_id, 1 AS depth, 0 AS ordinal, 'program' AS kind, NULL AS parent_kind, NULL AS text,
                NULL AS line, NULL AS start_col, NULL AS end_col, false AS is_leaf FROM conversations
              UNION ALL SELECT conv_id, turn, line_id, 1, 2, li - 1, 'line', 'program', NULL, li, 0, length(line), false FROM l
              UNION ALL SELECT t.conv_id, t.turn, l.line_id + t.j, l.line_id, 3, t.j - 1, 'word', 'line', t.tok, t.li, t.j - 1, t.j - 1 + length(t.tok), true
                FROM worded t JOIN l USING (conv_id, turn, li))
            SELECT conv_id::VARCHAR AS repo, turn::VARCHAR AS file_path, node_id::INT AS node_id, parent_id::INT AS parent_id, depth::INT AS depth, ordinal::INT AS ordinal,
              kind, parent_kind, text, line::INT AS start_line, start_col::INT AS start_col, line::INT AS end_line, end_col::INT AS end_col, is_leaf FROM n""",
        "response_trees": f"""WITH {LINES}, {PIECE},
            c AS (SELECT conv_id::VARCHAR AS dir, turn || '.txt' AS name, conv_id, turn, (conv_id + turn) % 7 = 0 AS bad FROM conversations),
            d AS (SELECT DISTINCT dir FROM c),
            every AS (
              SELECT 0 AS a, '' AS dir, 0 AS b, '' AS name, 0 AS seq, '{{"nodes":[{{"type":"directory","name":"talk","filePath":"","children":[' AS fragment
              UNION ALL SELECT 1, dir, 0, '', 0, CASE WHEN row_number() OVER (ORDER BY dir) = 1 THEN '' ELSE ',' END
                || '{{"type":"directory","name":"' || dir || '","filePath":"' || dir || '","children":[' FROM d
              UNION ALL SELECT 1, dir, 1, name, 0, CASE WHEN row_number() OVER (PARTITION BY dir ORDER BY name) = 1 THEN '' ELSE ',' END
                || '{{"type":"file","name":"' || name || '","filePath":"' || dir || '/' || name || CASE WHEN bad THEN '","error":"unreadable"}}' ELSE '","ast":' END FROM c
              UNION ALL SELECT 1, dir, 1, name, node_id, fragment FROM c JOIN pieces USING (conv_id, turn) WHERE NOT bad
              UNION ALL SELECT 1, dir, 1, name, 2147483647, '}}' FROM c WHERE NOT bad
              UNION ALL SELECT 1, dir, 2, '', 0, ']}}' FROM d
              UNION ALL SELECT 2, '', 0, '', 0, ']}}],"timestamp":"2024-01-01T00:00:00.000Z","benchmark":{{"files":' || count(*) || '}}}}' FROM c)
            SELECT 'talk' AS repo, row_number() OVER (ORDER BY a, dir, b, name, seq) AS position, fragment FROM every""",
        "text_dumps": f"""WITH {DUMPED},
            n AS (SELECT doc_id, node_id, depth FROM rising UNION ALL SELECT doc_id, 1, 1 FROM documents),
            f AS (SELECT *, coalesce(lead(depth) OVER (PARTITION BY doc_id ORDER BY node_id), 0) <= depth AS is_leaf FROM n)
            SELECT doc_id::VARCHAR AS file_path, count(*)::BIGINT AS nodes, max(depth)::INT AS max_depth, count(*) FILTER (is_leaf)::BIGINT AS leaves, 0::BIGINT AS errors
            FROM f GROUP BY doc_id""",
        "dumps_read": f"SELECT {LANG} AS language, d.source || '/' || d.doc_id || '.' || d.lang AS file_path, d.text AS content FROM documents d",
        "analyse_files": f"""WITH {MARKUP}, {ANALYSED} SELECT repo, file_path, language, status, loc::BIGINT AS loc, nodes::BIGINT AS nodes, max_depth::INT AS max_depth
            FROM analysed_files""",
        "analyse_history": ANALYSIS,
        "stream_analyse": ANALYSIS,
        "snapshot_diff": """WITH s AS (SELECT conv_id, turn, string_split(text, chr(10)) AS ls, (conv_id + turn) % 5 AS part, (conv_id * 3 + turn) % 11 = 0 AS gone,
              length(regexp_replace(text, '[^ \\n]', '', 'g')) + 1 AS ts FROM conversations),
            d AS (
              SELECT conv_id, turn, '0' AS path, 'removed' AS status, 1 + len(ls) + ts AS l, NULL AS r FROM s WHERE gone
              UNION ALL SELECT conv_id, turn, '0/' || (len(ls) - 1) || '/' || len(string_split(ls[-1], ' ')), 'added', NULL, 1 FROM s WHERE NOT gone AND part = 0
              UNION ALL SELECT conv_id, turn, '0/0/0', 'changed', 1, 1 FROM s WHERE NOT gone AND part = 1
              UNION ALL SELECT conv_id, turn, '0/' || (len(ls) - 1), 'removed', 1 + len(string_split(ls[-1], ' ')), NULL FROM s WHERE NOT gone AND part = 2 AND len(ls) > 1
              UNION ALL SELECT conv_id, turn, '0', 'changed', 2 + ts, 1 FROM s WHERE NOT gone AND part = 2 AND len(ls) = 1)
            SELECT conv_id, turn, path, status, l::INT AS left_nodes, r::INT AS right_nodes FROM d""",
        "stream_newest": f"""SELECT 'docs-' || (d.doc_id // 200) AS repo, {LANG} AS language, count(*)::BIGINT AS files,
            sum(CASE WHEN d.text = '' THEN 0 ELSE len(string_split(d.text, chr(10))) END)::BIGINT AS loc FROM documents d
            WHERE (d.doc_id // 200) % 2 = 1 OR d.doc_id % 2 = 0 GROUP BY ALL""",
        "language_stats": f"WITH {MEASURED} SELECT language, {TOTALS} FROM measured GROUP BY language",
        "corpus_totals": f"WITH {MEASURED} SELECT {TOTALS} FROM measured",
        "language_rollup": f"""WITH {MEASURED} SELECT repo, language, grouping(language)::INT AS is_total, {TOTALS}
            FROM measured GROUP BY GROUPING SETS ((repo, language), (repo))""",
        "prune_paths": f"""WITH {CODE} SELECT repo, file_path FROM code
            WHERE folder NOT IN ('node_modules', 'lib/.git', 'dist', 'pkg/__pycache__')""",
        "prune_glob": f"""WITH {CODE} SELECT repo, file_path FROM code
            WHERE NOT (folder = 'node_modules' OR contains(folder, '.git') OR contains(name, '.git'))""",
        "supported_files": f"""WITH {CODE} SELECT repo, file_path, ext, engine FROM code JOIN
            (SELECT unnest(['.java','.py','.ts','.js','.cpp','.h']) AS ext, 'generic' AS engine
             UNION ALL SELECT unnest(['.java','.ts','.js','.py','.c']), 'native') USING (ext)""",
        "file_dims": f"WITH {CODE} SELECT file_path, name, folder || '/' || doc_id AS dir_path, ext FROM code",
        "language_label": f"WITH {CODE} SELECT file_path, ext, {LABEL} AS language FROM code",
        "repo_name": """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'body-' || event_type
            WHEN event_id % 4 = 0 THEN 'query-' || event_type WHEN event_id % 5 = 0 THEN 'unknown' ELSE event_type END AS repo FROM events""",
        "loc_by_file": """SELECT source || '/' || doc_id || '.' || lang AS file_path,
            CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS loc FROM documents""",
        "run_tag": """SELECT event_id, event_type || '_a_b_' || user_id || '_' || strftime(ts, '%Y-%m-%dT%H-%M-%S-%gZ') AS tag FROM events""",
        "mb_convert": f"""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 0.0::DOUBLE
            ELSE {_mb("round(o_totalprice * 100)::BIGINT")} END AS mb FROM orders""",
        "preview": "SELECT doc_id, substring(text, 1, 500) AS head, substring(text, 1, 200) AS short_head FROM documents",
        "json_tree_nodes": f"""WITH {SYNTAX} SELECT conv_id::VARCHAR AS repo, turn::VARCHAR AS file_path, node_id::INT AS node_id,
            parent_id::INT AS parent_id, depth::INT AS depth, ordinal::INT AS ordinal, kind, parent_kind, is_named, field_name, text,
            start_line::INT AS start_line, start_col::INT AS start_col, end_line::INT AS end_line, end_col::INT AS end_col,
            is_leaf, kind = 'ERROR' AS is_error, closes::INT AS closes FROM tree""",
        "named_nodes": f"""WITH {NAMED} SELECT conv_id::VARCHAR AS repo, turn::VARCHAR AS file_path, number::INT AS node_id,
            CASE depth WHEN 2 THEN 1 WHEN 3 THEN min(number) OVER (PARTITION BY conv_id, turn, depth, parent_id) - 1 WHEN 4 THEN number - 1 END::INT AS parent_id,
            depth::INT AS depth, place::INT AS ordinal, kind, parent_kind, field_name, text FROM kept""",
        "outline": f"""WITH {SYNTAX},
            declared AS (SELECT li, conv_id, turn, line_id FROM placed WHERE line_kind IN ('class_declaration', 'interface_declaration')),
            first_tok AS (SELECT conv_id, turn, li, tok, kind FROM toks WHERE j = 1)
            SELECT conv_id::VARCHAR AS repo, turn::VARCHAR AS file_path, p.line_id::INT AS node_id, NULL::INT AS outline_parent_id,
              CASE p.line_kind WHEN 'class_declaration' THEN 'CLASS' ELSE 'INTERFACE' END AS class,
              CASE WHEN f.kind = 'identifier' THEN f.tok ELSE 'anonymous' END AS name,
              p.li::INT AS start_line, 0::INT AS start_col, p.li::INT AS end_line, length(p.line)::INT AS end_col
            FROM placed p JOIN first_tok f USING (conv_id, turn, li) WHERE p.line_kind IN ('class_declaration', 'interface_declaration')
            UNION ALL
            SELECT t.conv_id::VARCHAR, t.turn::VARCHAR, t.tok_id::INT, d.line_id::INT, 'METHOD', t.tok, t.li::INT, (t.j - 1)::INT, t.li::INT,
              (t.j - 1 + length(t.tok))::INT
            FROM toks t LEFT JOIN declared d USING (conv_id, turn, li) WHERE t.kind = 'method_definition'""",
        "deep_tree_stats": """WITH d AS (SELECT o_orderstatus, o_orderkey, o_orderkey % 40 + 1 + CASE WHEN o_orderkey % 500 = 0 THEN 700 ELSE 0 END AS n FROM orders)
            SELECT o_orderstatus AS repo, o_orderkey::VARCHAR AS file_path, n::BIGINT AS nodes, n::INT AS max_depth, 1::BIGINT AS leaves, 0::BIGINT AS errors FROM d""",
        "json_or_raw": """SELECT event_type AS repo, event_id || '.json' AS file_path,
            CASE WHEN event_type NOT IN ('error', 'signup') THEN (props->>'$.k')::BIGINT END AS k,
            CASE WHEN event_type = 'error' THEN substring(props, 1, length(props) - 1) END AS raw_dump,
            CASE event_type WHEN 'error' THEN 'raw' WHEN 'signup' THEN 'error' ELSE 'ok' END AS status FROM events""",
        "generic_tree_stats": """SELECT l_orderkey, l_linenumber, l_partkey, (11 + 2 * l_linenumber + l_partkey % 12 + 1)::BIGINT AS nodes,
            greatest(5, l_partkey % 12 + 2)::INT AS max_depth FROM lineitem""",
        "indent_dump_nodes": f"""WITH {DUMPED},
            every AS (SELECT repo, doc_id, node_id, parent_id, depth, kind, parent_kind, line AS text FROM rising
              UNION ALL SELECT source, doc_id, 1, NULL, 1, 'TranslationUnit', NULL, doc_id::VARCHAR FROM documents)
            SELECT repo, doc_id::VARCHAR AS file_path, node_id::INT AS node_id, parent_id::INT AS parent_id, depth::INT AS depth,
              (row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY node_id) - 1)::INT AS ordinal, kind, parent_kind, text,
              node_id::INT AS start_line FROM every""",
        "dump_node_estimate": """WITH n AS (SELECT source AS repo, doc_id, len(string_split(text, chr(10))) AS n FROM documents)
            SELECT repo, doc_id::VARCHAR AS file_path, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE (n + 1) // 2 END::BIGINT AS nodes,
              least(n, 5)::INT AS max_depth, CASE WHEN doc_id % 7 = 0 THEN 'error' ELSE 'ok' END AS status FROM n""",
        "markup_nodes": f"WITH {MARKUP} SELECT * FROM page_nodes",
        "tree_stats": f"""WITH {MARKUP} SELECT page_id, count(*)::BIGINT AS nodes, max(depth)::INT AS max_depth,
            count(*) FILTER (is_leaf)::BIGINT AS leaves, count(*) FILTER (is_error)::BIGINT AS errors FROM page_nodes GROUP BY page_id""",
        "tree_stats_compat": f"""WITH {MARKUP} SELECT page_id, count(*)::BIGINT AS nodes, max(depth)::INT AS max_depth,
            (count(*) + 3 * count(*) FILTER (is_leaf))::BIGINT AS compat_nodes, (max(depth) + 2)::INT AS compat_max_depth
            FROM page_nodes GROUP BY page_id""",
        "error_nodes": f"WITH {MARKUP} SELECT page_id, final::BIGINT AS error_nodes FROM finals",
        "kind_histogram": f"WITH {MARKUP} SELECT kind, count(*)::BIGINT AS nodes FROM page_nodes GROUP BY kind",
        "parent_kind_pairs": f"""WITH {MARKUP} SELECT p.kind AS parent_kind, c.kind, count(*)::BIGINT AS pairs FROM page_nodes c
            LEFT JOIN page_nodes p ON c.page_id = p.page_id AND c.parent_id = p.node_id GROUP BY 1, 2""",
        "line_nodes": f"""WITH {LINES} SELECT conv_id, turn, node_id::INT AS node_id, parent_id::INT AS parent_id, depth::INT AS depth,
            ordinal::INT AS ordinal, kind, parent_kind, text, start_line::INT AS start_line, start_col::INT AS start_col,
            end_line::INT AS end_line, end_col::INT AS end_col, start_off::INT AS start_off, end_off::INT AS end_off, is_leaf,
            closes::INT AS closes FROM all_nodes""",
        "dispatch_nodes": f"""WITH {MARKUP}
            SELECT '.' || lang AS ext, 'ok' AS status, count(*)::BIGINT AS files, count(DISTINCT source)::BIGINT AS repos,
              sum(CASE WHEN text = '' THEN 1 ELSE 2 + len(string_split(text, chr(10)))
                + length(regexp_replace(text, '[^ \n]', '', 'g')) END)::BIGINT AS nodes,
              max(CASE WHEN text = '' THEN 1 ELSE 3 END)::INT AS max_depth
            FROM documents GROUP BY lang
            UNION ALL SELECT '.html', 'ok', (SELECT count(*) FROM pages), 1, count(*), max(depth) FROM page_nodes
            UNION ALL SELECT '.json', CASE event_type WHEN 'error' THEN 'error' ELSE 'ok' END AS s, count(*), count(DISTINCT event_type),
              CASE s WHEN 'ok' THEN count(*) ELSE 0 END, CASE s WHEN 'ok' THEN 1 ELSE 0 END FROM events WHERE event_id % 2 = 0 GROUP BY s
            UNION ALL SELECT '.c', 'ok', count(*), count(DISTINCT event_type), count(*), 1 FROM events WHERE event_id % 2 = 1""",
        "dir_tree": f"WITH {PAGE_PATHS} SELECT DISTINCT 'web' AS repo, dir_path, parent_path, name, depth::INT AS depth FROM dirs",
        "dir_rollup": f"""WITH {PAGE_PATHS} SELECT 'web' AS repo, dir_path, count(*)::BIGINT AS files, sum(loc)::BIGINT AS loc
            FROM dirs GROUP BY dir_path""",
        "renest_json": f"WITH {LINES}, {PIECE} SELECT conv_id, turn, string_agg(fragment, '' ORDER BY node_id) AS json FROM pieces GROUP BY conv_id, turn",
        "response_body": RESPONSE,
        "snapshot_json": f"SELECT repo, row_number() OVER (ORDER BY string_split(place, '/')) AS position, fragment FROM ({RESPONSE})",
        "status_counts": f"""WITH s AS (SELECT CASE event_type WHEN 'error' THEN 'raw' WHEN 'signup' THEN 'error' ELSE 'ok' END AS status,
              CASE event_type WHEN 'error' THEN 2 ELSE 1 END AS loc, CASE WHEN event_type <> 'error' THEN 1 END AS nodes,
              CASE WHEN event_type <> 'error' THEN 1 END AS max_depth,
              CASE WHEN event_type <> 'error' THEN round(value * 100)::BIGINT * 10000 END AS parse_ns FROM events)
            SELECT status, {TOTALS} FROM s GROUP BY status""",
        "throughput": f"""WITH {EVENT_FILES} SELECT language,
            {_round("sum(k)::DOUBLE / (sum(parse_ns)::BIGINT / 1e9)", "100.0")} AS loc_per_sec,
            {_round("count(*)::DOUBLE / (sum(parse_ns)::BIGINT / 1e9)", "100.0")} AS files_per_sec FROM event_files GROUP BY language""",
        "success_rate": f"""SELECT user_id::VARCHAR AS repo,
            {_round("100.0::DOUBLE * count(*) FILTER (event_type <> 'error') / count(*)", "100.0")} AS success_pct FROM events GROUP BY user_id""",
        "peak_metrics": f"WITH {EVENT_FILES} SELECT repo, {_mb('rss')} AS peak_rss_mb, {_mb('heap')} AS peak_heap_mb FROM run_totals",
        "run_numbers": f"WITH {RUNS} SELECT repo, engine, run_id, run_no::BIGINT AS run_no FROM shown",
        "engine_compare": f"""WITH {RUNS},
            m AS (SELECT repo, run_no, missing_side, unnest([
              {{'metric': 'files', 'a': (ak + 1)::DOUBLE, 'b': (bk + 1)::DOUBLE}},
              {{'metric': 'loc', 'a': (ak * 100)::DOUBLE, 'b': (bk * 100)::DOUBLE}},
              {{'metric': 'nodes', 'a': (ak * 700)::DOUBLE, 'b': (bk * 700)::DOUBLE}},
              {{'metric': 'max_depth', 'a': (ak % 20 + 1)::DOUBLE, 'b': (bk % 20 + 1)::DOUBLE}},
              {{'metric': 'parse_sec', 'a': ams / 1000.0::DOUBLE, 'b': bms / 1000.0::DOUBLE}},
              {{'metric': 'total_sec', 'a': atms / 1000.0::DOUBLE, 'b': btms / 1000.0::DOUBLE}},
              {{'metric': 'peak_rss_mb', 'a': CASE WHEN aid IS NOT NULL THEN {_mb("(ak * 1048576 + aid)")} END,
                'b': CASE WHEN bid IS NOT NULL THEN {_mb("(bk * 1048576 + bid)")} END}},
              {{'metric': 'peak_heap_mb', 'a': CASE WHEN aid IS NOT NULL THEN {_mb("(ak * 524288 + aid)")} END,
                'b': CASE WHEN bid IS NOT NULL THEN {_mb("(bk * 524288 + bid)")} END}}]) AS s FROM pairs)
            SELECT repo, run_no::BIGINT AS run_no, missing_side, s.metric, s.a AS generic, s.b AS native FROM m""",
        "engine_speedup": f"""WITH {RUNS}, t AS (SELECT repo, run_no, ams / 1000.0::DOUBLE AS a, bms / 1000.0::DOUBLE AS b FROM pairs WHERE ams > 0 AND bms > 0)
            SELECT repo, run_no::BIGINT AS run_no, a AS a_parse_sec, b AS b_parse_sec, CASE WHEN b / a > 1 THEN 'generic' ELSE 'native' END AS faster,
              {_round("CASE WHEN b / a > 1 THEN b / a ELSE 1 / (b / a) END", "100.0")} AS times_faster FROM t""",
        "mean_speedup": f"""WITH {RUNS}, s AS (SELECT repo, count(*)::BIGINT AS runs, count(*) FILTER (missing_side IS NULL) AS paired,
              sum(ams)::DOUBLE AS a, sum(bms)::DOUBLE AS b FROM pairs GROUP BY repo)
            SELECT repo, runs, {_round("b / a", "100.0")} AS speedup, CASE WHEN b / a > 1 THEN 'faster' ELSE 'slower' END AS direction
            FROM s WHERE runs > 1 AND runs = paired AND a > 0""",
        "run_stats": f"""WITH {RUNS}, s AS (SELECT repo, engine, count(*)::BIGINT AS runs, sum(ms)::HUGEINT AS t, sum(ms * ms)::HUGEINT AS q,
              median(ms) AS mid, min(ms) AS lo, max(ms) AS hi FROM shown GROUP BY repo, engine)
            SELECT repo, engine, runs, {_round("t::DOUBLE / runs / 1000.0::DOUBLE", "10000.0")} AS mean_sec,
              {_round("sqrt((runs * q - t * t)::DOUBLE) / runs / 1000.0::DOUBLE", "10000.0")} AS std_sec,
              {_round("mid / 1000.0::DOUBLE", "10000.0")} AS median_sec, {_round("lo / 1000.0::DOUBLE", "10000.0")} AS min_sec,
              {_round("hi / 1000.0::DOUBLE", "10000.0")} AS max_sec FROM s WHERE runs > 1""",
        "runs_read": f"""WITH {EVENT_FILES} SELECT 'generic' AS {ENGINE_COLUMN}, t.repo, t.timestamp, t.files, t.loc, t.nodes AS totalNodes, t.max_depth AS maxDepth,
            {_sec("t.ns")} AS parseTimeSec, {_sec("t.total_ns")} AS totalTimeSec, {_mb("t.rss")} AS peakRssMB, {_mb("t.heap")} AS peakHeapMB,
            l.language, l.files AS lang_files, l.loc AS lang_loc, {_sec("l.ns")} AS lang_parse_sec
            FROM run_totals t JOIN run_langs l USING (repo)""",
        "history_read": _history(),
        "history_union": _history("('generic','native')"),
        "history_head": _history() + f" ORDER BY timestamp, {ENGINE_COLUMN}, repo, language LIMIT 20",
        "stream_history": _history(),
        "scan_archives": """SELECT 'docs-' || (doc_id // 500) AS repo, source || '/' || doc_id || '.' || lang AS file_path, text AS content,
            'ok' AS status FROM documents""",
        "scan_tree": """SELECT source || '/' || doc_id || '.' || lang AS path, 'file' AS kind, text AS content FROM documents
            UNION ALL SELECT source || '/empty/' || doc_id, 'empty', NULL FROM documents WHERE doc_id % 5 = 0
            UNION ALL SELECT source || '/bare/' || doc_id, 'empty', NULL FROM documents WHERE doc_id % 5 = 0""",
        "snapshot_write": f"""WITH {SYNTAX} SELECT 'generic' AS engine, 'r' || (conv_id % 10) AS repo, conv_id::VARCHAR AS conv, turn::VARCHAR AS file_path,
            node_id::INT AS node_id, parent_id::INT AS parent_id, depth::INT AS depth, kind, text, start_line::INT AS start_line, end_col::INT AS end_col,
            closes::INT AS closes FROM tree""",
        "stream_ingest": f"""SELECT 'docs-' || (d.doc_id // 500) AS repo, {LANG} AS language, count(*)::BIGINT AS files,
            sum(CASE WHEN d.text = '' THEN 0 ELSE len(string_split(d.text, chr(10))) END)::BIGINT AS loc FROM documents d GROUP BY ALL""",
    }
