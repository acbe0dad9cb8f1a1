"""DuckDB SQL of the registered queries."""

import re

from ragspark.packs import STOP_WORDS

#: Domain words of the test tables' invented languages.
TEST_TERMS = ("tion", "sch", "que", "ción")

_FOLD = "replace(lower({x}), 'ß', 'ss')"


def fold(x: str) -> str:
    return _FOLD.format(x=x)


def trimmed(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def collapsed(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\p{{Z}}]+', ' ', 'g'))"


def tokens(x: str) -> str:
    return rf"regexp_extract_all({fold(x)}, '[\p{{L}}\p{{N}}_]+')"


def spaced(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '[\s\p{{Z}}]+'), lambda t: t <> '')"


HEADING = r"^[\s\p{Z}]{0,3}(#{1,6})[\s\p{Z}]+(.+?)[\s\p{Z}]*$"
RULE_ROW = r"\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)*"


def spans(text: str, size: str, overlap: int) -> str:
    """Where the windows of a text begin, from 0."""
    step = f"greatest(1, {size} - {overlap})"
    return f"range(0, greatest(0, ceil((length({text}) - {size}) / ({step})::DOUBLE))::BIGINT * ({step}) + 1, {step})"


def chunked(n: str, source: str, size: int, overlap: int) -> str:
    """The tables of a chunker over source (key, text); {n} (key, no, b, sub, text, title, level, path) are its chunks.

    Sections by headings; of those over the size, blocks (tables, paragraphs), a greedy fold of the blocks and one of
    the rows of long tables, windows of long paragraphs; the heading line before each piece. For WITH RECURSIVE.
    """
    return rf"""
{n}_ls AS (SELECT key, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {source} WHERE text <> ''),
{n}_heads AS (SELECT *, CASE WHEN title <> '' THEN length(regexp_extract(line, '{HEADING}', 1)) END AS level FROM (
  SELECT *, CASE WHEN contains(line, '#') THEN trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(line, '{HEADING}', 2), '<[^>]+>', ' ', 'g'), '[*_`]+', '', 'g'), '\s+', ' ', 'g'), ' #') ELSE '' END AS title FROM {n}_ls)),
{n}_numbered AS (SELECT *, count(level) OVER (PARTITION BY key ORDER BY pos) AS no FROM {n}_heads),
{n}_tops AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) AS h FROM {n}_numbered WHERE level IS NOT NULL),
{n}_paths AS (SELECT t.key, t.no, any_value(t.title) AS title, any_value(t.level) AS level, any_value(t.line) AS line, string_agg(a.title, ' > ' ORDER BY a.pos) AS path FROM {n}_tops t JOIN {n}_tops a ON a.key = t.key AND a.pos <= t.pos
  WHERE NOT EXISTS (SELECT 1 FROM {n}_tops b WHERE b.key = t.key AND b.pos > a.pos AND b.pos <= t.pos AND b.level <= a.level) GROUP BY t.key, t.no),
{n}_bodies AS (SELECT key, no, {trimmed("coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE level IS NULL), '')")} AS body FROM {n}_numbered GROUP BY key, no),
{n}_sections AS (SELECT *, {size} - length(head) AS room FROM (
  SELECT b.key, b.no, b.body, coalesce(p.title, '') AS title, p.level, coalesce(p.path, '') AS path, CASE WHEN p.line IS NULL OR length({trimmed("p.line")}) + 2 >= {size} THEN '' ELSE {trimmed("p.line")} || chr(10) || chr(10) END AS head
  FROM {n}_bodies b LEFT JOIN {n}_paths p ON p.key = b.key AND p.no = b.no) WHERE body <> ''),
{n}_big AS (SELECT * FROM {n}_sections WHERE length(body) > room),
{n}_rows AS (SELECT *, {trimmed("line")} AS s FROM (SELECT key, no, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM {n}_big)),
{n}_barred AS (SELECT *, length(s) >= 2 AND starts_with(s, '|') AND ends_with(s, '|') AS barred, coalesce(regexp_full_match(trim(lead(s) OVER line, '|'), '{RULE_ROW}'), false) AS ruled FROM {n}_rows WINDOW line AS (PARTITION BY key, no ORDER BY i)),
{n}_runs AS (SELECT *, sum((NOT goes_on)::INT) OVER (PARTITION BY key, no ORDER BY i) AS run FROM (
  SELECT *, barred AND ruled AS opens, barred OR coalesce(lag(barred AND ruled) OVER (PARTITION BY key, no ORDER BY i), false) AS goes_on FROM {n}_barred)),
{n}_kinds AS (SELECT *, CASE WHEN goes_on AND i >= first_open THEN 'table' WHEN s = '' THEN 'blank' ELSE 'paragraph' END AS kind FROM (
  SELECT *, min(CASE WHEN opens AND goes_on THEN i END) OVER (PARTITION BY key, no, run, goes_on) AS first_open FROM {n}_runs)),
{n}_marked AS (SELECT *, sum(starts) OVER (PARTITION BY key, no ORDER BY i) AS b FROM (
  SELECT *, (kind <> 'blank' AND kind <> coalesce(lag(kind) OVER (PARTITION BY key, no ORDER BY i), ''))::INT AS starts FROM {n}_kinds) WHERE kind <> 'blank'),
{n}_blocks AS (SELECT m.key, m.no, m.b::BIGINT AS b, any_value(kind) AS kind, any_value(g.room) AS room, {trimmed("string_agg(CASE WHEN kind = 'table' THEN s ELSE line END, chr(10) ORDER BY i)")} AS text, list(s ORDER BY i) AS lines
  FROM {n}_marked m JOIN {n}_big g ON g.key = m.key AND g.no = m.no GROUP BY m.key, m.no, m.b),
{n}_fold AS (
  SELECT key, no, b, CASE WHEN length(text) <= room THEN b END AS start, length(text) AS filled FROM {n}_blocks WHERE b = 1
  UNION ALL SELECT k.key, k.no, k.b, CASE WHEN length(k.text) > k.room THEN NULL WHEN f.start IS NOT NULL AND f.filled + 2 + length(k.text) <= k.room THEN f.start ELSE k.b END,
    CASE WHEN f.start IS NOT NULL AND f.filled + 2 + length(k.text) <= k.room THEN f.filled + 2 + length(k.text) ELSE length(k.text) END
  FROM {n}_fold f JOIN {n}_blocks k ON k.key = f.key AND k.no = f.no AND k.b = f.b + 1),
{n}_tables AS (SELECT key, no, b, room, lines, length(lines[1]) + 1 + length(lines[2]) AS base FROM {n}_blocks WHERE kind = 'table' AND length(text) > room),
{n}_table_fold AS (
  SELECT key, no, b, 2::BIGINT AS i, 1::BIGINT AS part, 0::BIGINT AS filled, room, base, lines FROM {n}_tables
  UNION ALL SELECT key, no, b, i + 1, CASE WHEN filled > 0 AND base + filled + 1 + length(lines[i + 1]) > room THEN part + 1 ELSE part END,
    CASE WHEN filled > 0 AND base + filled + 1 + length(lines[i + 1]) > room THEN 0 ELSE filled END + 1 + length(lines[i + 1]), room, base, lines FROM {n}_table_fold WHERE i < len(lines)),
{n}_pieces AS (
  SELECT key, no, 1::BIGINT AS b, 0::BIGINT AS sub, body AS piece FROM {n}_sections WHERE length(body) <= room
  UNION ALL SELECT f.key, f.no, f.start, 0, string_agg(k.text, chr(10) || chr(10) ORDER BY k.b) FROM {n}_fold f JOIN {n}_blocks k ON k.key = f.key AND k.no = f.no AND k.b = f.b WHERE f.start IS NOT NULL GROUP BY f.key, f.no, f.start
  UNION ALL SELECT key, no, b, spot, {trimmed("substr(text, spot + 1, room)")} FROM (SELECT *, unnest({spans("text", "room", overlap)}) AS spot FROM {n}_blocks WHERE kind = 'paragraph' AND length(text) > room)
  UNION ALL SELECT key, no, b, part, any_value(lines[1]) || chr(10) || any_value(lines[2]) || coalesce(string_agg(chr(10) || lines[i], '' ORDER BY i) FILTER (WHERE i > 2), '') FROM {n}_table_fold GROUP BY key, no, b, part),
{n} AS (SELECT * FROM (SELECT p.key, p.no, p.b, p.sub, {trimmed("s.head || p.piece")} AS text, s.title, s.level, s.path FROM {n}_pieces p JOIN {n}_sections s ON s.key = p.key AND s.no = p.no WHERE p.piece <> '') WHERE text <> '')"""


def chunks(bodies: str) -> str:
    """Parents and children of documents, a table (key, text)."""
    return f"""{chunked("pc", bodies, 900, 150)},
parents AS (SELECT *, doc_key || '::parent-' || parent_index AS parent_id FROM (SELECT key AS doc_key, title, level, path, text, row_number() OVER (PARTITION BY key ORDER BY no, b, sub) - 1 AS parent_index FROM pc)),
shown AS (SELECT parent_id AS key, text FROM parents),{chunked("cc", "shown", 450, 75)},
fitted AS (SELECT key, no, b, sub, spot, title, level, path, {trimmed("substr(text, spot + 1, 450)")} AS text FROM (SELECT *, unnest(CASE WHEN length(text) <= 450 THEN [0] ELSE {spans("text", "450", 75)} END) AS spot FROM cc)),
children AS (SELECT *, parent_id || '::child-' || child_index AS chunk_id FROM (
  SELECT p.doc_key, p.parent_id, p.parent_index, row_number() OVER (PARTITION BY p.parent_id ORDER BY f.no, f.b, f.sub, f.spot) - 1 AS child_index, coalesce(f.text, p.text) AS text,
    CASE WHEN coalesce(f.title, '') <> '' THEN f.title ELSE p.title END AS heading, CASE WHEN coalesce(f.path, '') <> '' THEN f.path ELSE p.path END AS section_path
  FROM parents p LEFT JOIN (SELECT * FROM fitted WHERE text <> '') f ON f.key = p.parent_id))"""


CHUNKS = f"""
bodies AS (SELECT 'doc-' || doc_id || '.txt' AS key, coalesce(text, '') AS text FROM documents),{chunks("bodies")}"""


def index(chunks: str, key: str) -> str:
    return f"""
words AS (SELECT {key} AS chunk_id, {tokens("coalesce(text, '')")} AS w FROM {chunks}),
statistics AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM words),
postings AS (SELECT term, chunk_id, count(*) AS tf, dl FROM (SELECT chunk_id, len(w) AS dl, unnest(w) AS term FROM words) GROUP BY term, chunk_id, dl),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM postings, statistics GROUP BY term),
terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""


def bm25(queries: str, k: int) -> str:
    """Ranking by BM25 of queries (query_id, query)."""
    return f"""
asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens("coalesce(query, '')")}) AS term FROM {queries}) GROUP BY query_id, term),
keyword AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT query_id, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
  FROM postings JOIN asked USING (term) JOIN terms USING (term), statistics GROUP BY query_id, chunk_id) WHERE score > 0 QUALIFY rank <= {k})"""


def embedded(name: str, source: str, key: str, text: str) -> str:
    return f"""
{name}_sums AS (SELECT {key}, dim, sum(sign) AS w FROM (
  SELECT {key}, ('0x' || substr(sha256(t), 1, 8))::UBIGINT % 384 AS dim, 1 - 2 * (('0x' || substr(sha256(t), 9, 2))::INT % 2) AS sign
  FROM (SELECT {key}, unnest({spaced(f"lower(coalesce({text}, ''))")}) AS t FROM {source})) GROUP BY {key}, dim HAVING sum(sign) <> 0),
{name} AS (SELECT {key}, dim::INT AS dim, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight FROM {name}_sums)"""


STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
TRIM_QUERY = "trim({x}, ' ,:;.!?-')"
QUESTIONS = f"""
questions AS (SELECT conv_id || '-' || turn AS query_id, text AS question, {collapsed(fold("text"))} AS plain FROM conversations WHERE role = 'user'),
asked_rows AS (SELECT query_id, question, plain <> '' AND regexp_matches(plain, '{"|".join(TEST_TERMS)}') AS allowed,
  CASE WHEN {TRIM_QUERY.format(x="plain")} <> '' THEN {TRIM_QUERY.format(x="plain")} ELSE {collapsed("question")} END AS query FROM questions),
variant_rows AS (SELECT query_id, 0 AS pos, query FROM asked_rows WHERE allowed UNION ALL
  SELECT query_id, 1, list_aggregate(list_filter({tokens("query")}, lambda w: w NOT IN ({STOP})), 'string_agg', ' ') FROM asked_rows WHERE allowed),
variant_once AS (SELECT query_id, pos, v FROM (SELECT query_id, pos, trim({collapsed("query")}, ' `"''-') AS v FROM variant_rows WHERE query IS NOT NULL) WHERE v <> ''
  QUALIFY row_number() OVER (PARTITION BY query_id, {fold("v")} ORDER BY pos) = 1),
variants AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS variant, substr(v, 1, 500) AS query FROM variant_once),
qv AS (SELECT query_id || '#' || variant AS query_id, query FROM variants)"""

SEARCHED = QUESTIONS.replace("WHERE role = 'user'", "WHERE role = 'user' AND conv_id % 50 = 0")


def once(ctes: str) -> str:
    """The tables of a WITH clause, each made once however often it is read."""
    return re.sub(r"(?m)^(\w+) AS \(", r"\1 AS MATERIALIZED (", ctes)


RANKINGS = f"""{CHUNKS}, {SEARCHED}, {index("children", "chunk_id")}, {bm25("qv", 48)}, {embedded("ce", "children", "chunk_id", "text")}, {embedded("qe", "qv", "query_id", "query")},
dots AS (SELECT query_id, chunk_id, sum(qe.weight * ce.weight) AS dot FROM qe JOIN ce USING (dim) GROUP BY query_id, chunk_id),
near AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT q.query_id, c.chunk_id, round(coalesce(dot, 0), 6) + 0 AS score FROM (SELECT DISTINCT query_id FROM qe) q CROSS JOIN (SELECT DISTINCT chunk_id FROM ce) c LEFT JOIN dots d ON d.query_id = q.query_id AND d.chunk_id = c.chunk_id)
  QUALIFY rank <= 48),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(vr, 1000000000), coalesce(kr, 1000000000), chunk_id) AS rank FROM (
  SELECT coalesce(n.query_id, k.query_id) AS query_id, coalesce(n.chunk_id, k.chunk_id) AS chunk_id, n.rank AS vr, k.rank AS kr, n.score AS vector_score, k.score AS bm25_score,
    round(coalesce(0.65::DOUBLE / (60 + n.rank), 0) + coalesce((1.0::DOUBLE - 0.65::DOUBLE) / (60 + k.rank), 0), 9) AS score
  FROM near n FULL JOIN keyword k ON n.query_id = k.query_id AND n.chunk_id = k.chunk_id) QUALIFY rank <= 48)"""

COLLAPSED = RANKINGS + """,
grouped AS (SELECT query_id, parent_id, max(score) AS score, max(vector_score) AS vector_score, max(bm25_score) AS bm25_score, arg_min(chunk_id, rank) AS chunk_id,
  count(*) AS matched_child_count, string_agg(chunk_id, ',' ORDER BY rank) AS matched_child_ids, min(rank) AS first_rank
  FROM fused JOIN (SELECT chunk_id, parent_id FROM children) USING (chunk_id) GROUP BY query_id, parent_id),
collapsed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, matched_child_count DESC, first_rank) AS rank FROM grouped QUALIFY rank <= 12)"""

FUSED = COLLAPSED + """,
multi AS (SELECT split_part(query_id, '#', 1) AS query_id, split_part(query_id, '#', 2)::INT AS variant, parent_id, score, vector_score, bm25_score, chunk_id, rank FROM collapsed),
summed AS (SELECT query_id, parent_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, count(*) AS query_hits, max(vector_score) AS vector_score, max(bm25_score) AS bm25_score,
  arg_max(chunk_id, score * 1000000000000 - variant * 100 - rank) AS chunk_id, min(variant * 1000 + rank) AS first FROM multi GROUP BY query_id, parent_id),
candidates AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, query_hits DESC, first) AS rank FROM summed QUALIFY rank <= 12)"""

RERANKED = FUSED + f""",
scaled AS (SELECT c.*, a.query, p.text, coalesce(c.vector_score, 0) AS v, coalesce(c.bm25_score, 0) AS b, list_distinct({tokens("a.query")}) AS qt, {tokens("p.text")} AS pt
  FROM candidates c JOIN parents p USING (parent_id) JOIN asked_rows a ON a.query_id = c.query_id),
normed AS (SELECT *, min(v) OVER q AS v0, max(v) OVER q AS v1, min(b) OVER q AS b0, max(b) OVER q AS b1, len(list_intersect(qt, pt)) / greatest(len(qt), 1) AS cover FROM scaled WINDOW q AS (PARTITION BY query_id)),
scored AS (SELECT *, round(0.45 * CASE WHEN v0 = v1 THEN (v > 0)::INT::DOUBLE ELSE (v - v0) / (v1 - v0) END + 0.35 * CASE WHEN b0 = b1 THEN (b > 0)::INT::DOUBLE ELSE (b - b0) / (b1 - b0) END + 0.20 * cover, 6) AS rerank_score FROM normed),
contexts AS (SELECT query_id, parent_id, chunk_id, text, score AS rrf_score, rerank_score, vector_score, bm25_score, query_hits, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS rank FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) <= 4),
gates AS (SELECT a.query_id, a.allowed, coalesce(bool_or(vector_score >= 0.30 OR bm25_score >= 2.0), false) AS strong_context FROM asked_rows a LEFT JOIN contexts c ON a.query_id = c.query_id GROUP BY a.query_id, a.allowed)"""

MARKDOWN = r"""
marked AS (SELECT doc_id, list_aggregate(list_transform(string_split(text, chr(10)), lambda x, i: CASE
  WHEN (i - 1) % 7 = 0 THEN repeat('#', ((i - 1) % 3 + 1)::INT) || ' ' || substr(x, 1, 24) || chr(10) || chr(10) || x || chr(10)
  WHEN (i - 1) % 11 = 5 THEN '| a | b |' || chr(10) || '|---|:--|' || chr(10) || '| ' || x || ' | ' || i || ' |' ELSE x END), 'string_agg', chr(10)) AS text FROM documents)"""

MARKDOWN_CHUNKS = MARKDOWN + f""",
bodies AS (SELECT 'doc-' || doc_id || '.md' AS key, text FROM marked),{chunks("bodies")}"""

SECTIONS = "WITH " + MARKDOWN + rf""",
ls AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\n$', ''), chr(10)), 1) - 1 AS pos FROM marked),
heads AS (SELECT *, CASE WHEN title <> '' THEN length(regexp_extract(line, '^[\s\p{{Z}}]{{0,3}}(#{{1,6}})[\s\p{{Z}}]+(.+?)[\s\p{{Z}}]*$', 1)) END AS level FROM (
  SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(line, '^[\s\p{{Z}}]{{0,3}}(#{{1,6}})[\s\p{{Z}}]+(.+?)[\s\p{{Z}}]*$', 2), '<[^>]+>', ' ', 'g'), '[*_`]+', '', 'g'), '\s+', ' ', 'g'), ' #') AS title FROM ls)),
numbered AS (SELECT *, count(level) OVER (PARTITION BY doc_id ORDER BY pos) AS no FROM heads),
tops AS (SELECT h.doc_id, h.no, h.title, h.level, (SELECT string_agg(a.title, ' > ' ORDER BY a.pos) FROM numbered a WHERE a.doc_id = h.doc_id AND a.level IS NOT NULL AND a.pos <= h.pos
  AND NOT EXISTS (SELECT 1 FROM numbered b WHERE b.doc_id = h.doc_id AND b.level IS NOT NULL AND b.pos > a.pos AND b.pos <= h.pos AND b.level <= a.level)) AS path FROM numbered h WHERE level IS NOT NULL),
bodies AS (SELECT doc_id, no, {trimmed("string_agg(line, chr(10) ORDER BY pos)")} AS text FROM numbered GROUP BY doc_id, no)
SELECT b.doc_id, row_number() OVER (PARTITION BY b.doc_id ORDER BY b.no) - 1 AS section, coalesce(t.title, '') AS heading, t.level::INT AS heading_level, coalesce(t.path, '') AS section_path, md5(b.text) AS text_md5
FROM bodies b LEFT JOIN tops t ON b.doc_id = t.doc_id AND b.no = t.no WHERE b.text <> ''"""

KNOWN = """
known AS (SELECT item_id, text AS query FROM benchmark)"""

#: The budget walk over the newest six turns of each conversation, newest first.
HISTORIES = f"""WITH RECURSIVE recent AS (SELECT conv_id, turn, role, {trimmed("coalesce(text, '')")} AS said FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6 AND role IN ('user', 'assistant')),
said AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM recent WHERE said <> ''),
walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS k, 1200::BIGINT AS room, '' AS role, '' AS content FROM said
  UNION ALL SELECT conv_id, k, room - length(cut), role, cut FROM (
    SELECT s.conv_id, s.k, w.room, s.role, CASE WHEN length(s.said) <= w.room THEN s.said ELSE regexp_replace(substr(s.said, 1, w.room), '[\\s\\p{{Z}}]+$', '') END AS cut
    FROM walk w JOIN said s ON s.conv_id = w.conv_id AND s.k = w.k + 1))
SELECT conv_id, count(*) AS turns, sum(length(content))::BIGINT AS chars, string_agg(role || ':' || md5(content), ',' ORDER BY k DESC) AS digest FROM walk WHERE content <> '' GROUP BY conv_id"""


#: The same walk for each user turn over the six turns before it, with the default budget.
HISTORIES_BEFORE = f"""WITH RECURSIVE asked AS (SELECT conv_id, turn AS place, text FROM conversations WHERE role = 'user'),
recent AS (SELECT conv_id, place, turn, role, {trimmed("coalesce(text, '')")} AS said FROM (
  SELECT c.*, a.place, row_number() OVER (PARTITION BY a.conv_id, a.place ORDER BY c.turn DESC) AS n FROM asked a JOIN conversations c ON c.conv_id = a.conv_id AND c.turn < a.place) WHERE n <= 6 AND role IN ('user', 'assistant')),
said AS (SELECT *, row_number() OVER (PARTITION BY conv_id, place ORDER BY turn DESC) AS k FROM recent WHERE said <> ''),
walk AS (
  SELECT DISTINCT conv_id, place, 0::BIGINT AS k, 6000::BIGINT AS room, '' AS role, '' AS content FROM said
  UNION ALL SELECT conv_id, place, k, room - length(cut), role, cut FROM (
    SELECT s.conv_id, s.place, s.k, w.room, s.role, CASE WHEN length(s.said) <= w.room THEN s.said ELSE regexp_replace(substr(s.said, 1, w.room), '[\\s\\p{{Z}}]+$', '') END AS cut
    FROM walk w JOIN said s ON s.conv_id = w.conv_id AND s.place = w.place AND s.k = w.k + 1)),
held AS (SELECT conv_id, place, count(*) AS turns, sum(length(content))::BIGINT AS chars, string_agg(role || ':' || md5(content), ',' ORDER BY k DESC) AS digest FROM walk WHERE content <> '' GROUP BY conv_id, place)"""
