"""SQL counterparts of the core queries."""

from __future__ import annotations

import string
import unicodedata

# Latin letters with marks whose plain letter is ASCII, by their decomposition
MARKED = "".join(c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if c.islower() and unicodedata.normalize("NFD", c)[0] in string.ascii_lowercase and c not in string.ascii_lowercase)
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in MARKED)

P1_FOUND = r"""
WITH f AS (
  SELECT project_id, CASE WHEN ref IS NULL OR ref = '' THEN 'HEAD' ELSE ref END AS ref,
         regexp_replace(path, '^\./', '') AS path, lower(sha) AS sha, snapshot_no, loaded_at
  FROM files),
m AS (
  SELECT project_id, ref, snapshot_no,
         row_number() OVER (PARTITION BY project_id, ref ORDER BY snapshot_no) AS seq
  FROM (SELECT DISTINCT project_id, CASE WHEN ref IS NULL OR ref = '' THEN 'HEAD' ELSE ref END AS ref, snapshot_no
        FROM index_meta WHERE state = 'complete')),
d AS (
  SELECT f.project_id, f.ref, f.path, f.sha, m.seq FROM f JOIN m
    ON f.project_id IS NOT DISTINCT FROM m.project_id AND f.ref = m.ref AND f.snapshot_no = m.snapshot_no
  QUALIFY row_number() OVER (PARTITION BY f.project_id, f.ref, f.path, m.seq
                             ORDER BY f.loaded_at DESC NULLS LAST, f.sha DESC NULLS LAST) = 1),
moves AS (
  SELECT b.project_id, b.ref, b.path, b.seq, CASE WHEN a.path IS NULL THEN 'added' ELSE 'changed' END AS change_type
  FROM d b LEFT JOIN d a ON a.project_id IS NOT DISTINCT FROM b.project_id AND a.ref = b.ref AND a.path = b.path AND a.seq = b.seq - 1
  WHERE b.seq > 1 AND (a.path IS NULL OR a.sha IS DISTINCT FROM b.sha)
  UNION ALL
  SELECT a.project_id, a.ref, a.path, a.seq + 1, 'removed'
  FROM d a LEFT JOIN d b ON a.project_id IS NOT DISTINCT FROM b.project_id AND a.ref = b.ref AND a.path = b.path AND b.seq = a.seq + 1
  WHERE b.path IS NULL)
SELECT moves.project_id, moves.ref, moves.path, m.snapshot_no, moves.change_type
FROM moves JOIN m ON moves.project_id IS NOT DISTINCT FROM m.project_id AND moves.ref = m.ref AND moves.seq = m.seq
"""

P4_FOUND = r"""
WITH last AS (
  SELECT request_id, sarif FROM gate_requests
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY received_at DESC NULLS LAST, sarif DESC NULLS LAST) = 1),
once AS (
  SELECT request_id, CASE WHEN json_valid(sarif) THEN sarif::JSON END AS j FROM last),
doc AS (
  SELECT request_id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j->>'$') THEN (j->>'$')::JSON END ELSE j END AS j FROM once),
runs AS (
  SELECT request_id, r.i - 1 AS run_no, j->'runs'->(r.i - 1)::INT AS run
  FROM doc, range(1, coalesce(json_array_length(j, '$.runs'), 0)::BIGINT + 1) AS r(i)),
rules AS (
  SELECT request_id, run_no, k.i AS rule_no, run->'tool'->'driver'->'rules'->(k.i - 1)::INT AS rule
  FROM runs, range(1, coalesce(json_array_length(run, '$.tool.driver.rules'), 0)::BIGINT + 1) AS k(i)),
levels AS (
  SELECT request_id, run_no, rule->>'id' AS rule_id, arg_max(coalesce(rule->'defaultConfiguration'->>'level', ''), rule_no) AS level
  FROM rules WHERE rule->>'id' IS NOT NULL GROUP BY ALL),
results AS (
  SELECT request_id, run_no, run, k.i - 1 AS result_no, run->'results'->(k.i - 1)::INT AS res
  FROM runs, range(1, coalesce(json_array_length(run, '$.results'), 0)::BIGINT + 1) AS k(i)),
named AS (
  SELECT *, coalesce(nullif(res->>'ruleId', ''), nullif(res->'rule'->>'id', ''),
      CASE WHEN TRY_CAST(res->>'ruleIndex' AS INT) >= 0 THEN nullif(run->'tool'->'driver'->'rules'->TRY_CAST(res->>'ruleIndex' AS INT)->>'id', '') END, '') AS rule_id
  FROM results),
leveled AS (
  SELECT n.*, coalesce(nullif(n.res->>'level', ''), nullif(l.level, ''), 'warning') AS eff_level,
         coalesce(json_array_length(n.res, '$.locations'), 0)::BIGINT AS n_locations
  FROM named n LEFT JOIN levels l ON l.request_id = n.request_id AND l.run_no = n.run_no AND l.rule_id = n.rule_id AND n.rule_id <> ''),
places AS (
  SELECT *, k.i AS location_no, res->'locations'->(k.i)::INT->'physicalLocation'->'artifactLocation' AS a
  FROM leveled, range(0, n_locations) AS k(i))
SELECT request_id, run_no::INT AS run_no, result_no::INT AS result_no, location_no::INT AS location_no, rule_id, eff_level,
       coalesce(nullif(a->>'uri', ''), CASE WHEN TRY_CAST(a->>'index' AS INT) >= 0 THEN nullif(run->'artifacts'->TRY_CAST(a->>'index' AS INT)->'location'->>'uri', '') END, '') AS uri
FROM places
UNION ALL
SELECT request_id, run_no::INT, result_no::INT, -1, rule_id, eff_level, '' FROM leveled WHERE n_locations = 0
"""


SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
HEAD = "CASE WHEN ref IS NULL OR ref = '' THEN 'HEAD' ELSE ref END"
FILES = "(SELECT doc_id, source AS project_id, coalesce(path, 'doc/' || doc_id || '.txt') AS path, text FROM documents)"

LINE_WINDOWS = rf"""
WITH f AS (
  SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g'), '\n$', ''), chr(10)) AS lines
  FROM documents WHERE text <> ''),
w AS (SELECT doc_id, s.i AS start_line, lines[s.i:s.i + 119] AS block FROM f, range(1, len(lines) + 1, 120) AS s(i))
SELECT doc_id, start_line, start_line + len(block) - 1 AS end_line, array_to_string(block, chr(10)) AS text
FROM w WHERE length(regexp_replace(array_to_string(block, ''), '{SPACE}', '', 'g')) > 0
"""

CONTENT_SHA = r"SELECT doc_id, sha1(regexp_replace(text, '\r\n?', chr(10), 'g')) AS sha FROM documents"

FILE_FILTER = r"""
SELECT doc_id, path FROM documents
WHERE path IS NOT NULL AND n_chars <= 20000
  AND NOT list_has_any(string_split(path, '/'), ['.git', '.venv', 'venv', 'node_modules', '__pycache__', 'build', 'dist', '.mypy_cache', '.pytest_cache', '.ruff_cache', '.tox', '.eggs', 'site-packages'])
  AND regexp_extract(path, '[^/](\.[^./]+)$', 1) IN ('.py', '.go', '.java', '.ts', '.js', '.rb', '.rs', '.cs', '.kt')
"""

URL_HOSTS = r"""
WITH u AS (SELECT DISTINCT project_id, CASE WHEN regexp_matches(project_id, '^(https?://|git@)') THEN project_id ELSE 'https://gitlab.com/' || project_id || '.git' END AS url FROM files)
SELECT project_id, url, nullif(lower(CASE WHEN url LIKE 'git@%' THEN regexp_extract(url, '^git@([^:]*)', 1) ELSE regexp_extract(url, '^https?://(?:[^/@]*@)?([^/:]*)', 1) END), '') AS host FROM u
"""

HOST_ALLOWLIST = f"SELECT project_id, coalesce(host IN ('gitlab.com', 'git.tarnfield.example'), false) AS allowed FROM ({URL_HOSTS})"


def _snapshot(back: int) -> str:
    return rf"""
  SELECT f.project_id, {HEAD.replace("ref", "f.ref", 2).replace("ELSE ref", "ELSE f.ref")} AS ref, regexp_replace(f.path, '^\./', '') AS path, lower(f.sha) AS sha
  FROM files f JOIN (
    SELECT project_id, ref, snapshot_no FROM (SELECT DISTINCT project_id, {HEAD} AS ref, snapshot_no FROM index_meta WHERE state = 'complete')
    QUALIFY row_number() OVER (PARTITION BY project_id, ref ORDER BY snapshot_no DESC) = {back}) m
    ON f.project_id = m.project_id AND {HEAD.replace("ref", "f.ref", 2).replace("ELSE ref", "ELSE f.ref")} = m.ref AND f.snapshot_no = m.snapshot_no
  QUALIFY row_number() OVER (PARTITION BY f.project_id, {HEAD.replace("ref", "f.ref", 2).replace("ELSE ref", "ELSE f.ref")}, regexp_replace(f.path, '^\./', '') ORDER BY f.loaded_at DESC, lower(f.sha) DESC NULLS LAST) = 1"""


SNAPSHOT_PATHS = f"""
WITH cur AS ({_snapshot(1)}), old AS ({_snapshot(2)})
SELECT c.project_id, c.ref, c.path, 'changed' AS change FROM cur c LEFT JOIN old o USING (project_id, ref, path)
WHERE o.path IS NULL OR c.sha IS DISTINCT FROM o.sha
UNION ALL
SELECT project_id, ref, path, 'removed' FROM old WHERE NOT EXISTS (SELECT 1 FROM cur c WHERE c.project_id = old.project_id AND c.ref = old.ref AND c.path = old.path)
"""

APPLY_DIFF_COUNTS = f"""
WITH touched AS ({SNAPSHOT_PATHS})
SELECT project_id, ref, count(*) AS n_kept FROM chunks c
WHERE NOT EXISTS (SELECT 1 FROM touched t WHERE t.project_id = c.project_id AND t.ref = c.ref AND t.path = c.path)
GROUP BY ALL
"""

FILE_SHA_UPSERT = f"""
WITH cur AS ({_snapshot(1)}), old AS ({_snapshot(2)})
SELECT * FROM cur UNION ALL
SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM cur c WHERE c.project_id = old.project_id AND c.ref = old.ref AND c.path = old.path)
"""

META_UPSERT = f"""
WITH m AS (SELECT project_id, {HEAD} AS ref, snapshot_no, commit_sha, embed_sig FROM index_meta),
a AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY project_id, ref ORDER BY snapshot_no, commit_sha NULLS FIRST, embed_sig NULLS FIRST) = 1),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY project_id, ref ORDER BY snapshot_no DESC, commit_sha DESC NULLS LAST, embed_sig DESC NULLS LAST) = 1)
SELECT project_id, ref, coalesce(b.commit_sha, a.commit_sha) AS commit_sha, coalesce(b.embed_sig, a.embed_sig) AS embed_sig FROM a JOIN b USING (project_id, ref)
"""

CHUNK_COUNTS = "SELECT project_id, ref, count(*) AS n_chunks, count(DISTINCT path) AS n_files FROM chunks GROUP BY ALL"

INDEX_STATUS = f"""
WITH m AS (SELECT project_id, {HEAD} AS ref, snapshot_no, commit_sha, n_files FROM index_meta WHERE state = 'complete'
           QUALIFY row_number() OVER (PARTITION BY project_id, {HEAD} ORDER BY snapshot_no DESC, commit_sha DESC NULLS LAST) = 1),
n AS (SELECT project_id, {HEAD} AS ref, count(*) AS n FROM chunks GROUP BY ALL)
SELECT project_id, ref, coalesce(commit_sha, '') AS commit_sha, n_files::BIGINT AS n_files, coalesce(n, 0) AS n_chunks, coalesce(n, 0) > 0 AS indexed
FROM m LEFT JOIN n USING (project_id, ref)
"""

VALIDATE_QUERIES = rf"""
WITH q AS (
  SELECT item_id AS query_id, text AS query FROM bench_items UNION ALL SELECT doc_id, text FROM documents UNION ALL
  SELECT * FROM (VALUES (-1, ''), (-2, '   '), (-3, chr(9) || chr(10)), (-4, repeat('x', 2001)), (-5, 'nul' || chr(0) || 'l'), (-6, 'bell' || chr(7)),
                        (-7, 'tab' || chr(9) || 'and' || chr(10) || 'line'), (-8, 'del' || chr(127)), (-9, NULL)))
SELECT query_id,
  CASE WHEN query IS NULL OR length(regexp_replace(query, '{SPACE}', '', 'g')) = 0 THEN 'empty' WHEN length(query) > 2000 THEN 'too long'
       WHEN regexp_matches(query, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]') THEN 'control characters' END AS query_problem,
  CASE WHEN query IS NULL OR length(regexp_replace(query, '{SPACE}', '', 'g')) = 0 THEN 'empty' WHEN length(query) > 512 THEN 'too long'
       WHEN regexp_matches(query, '[\x00-\x1F\x7F]') THEN 'control characters' END AS project_problem
FROM q
"""

SELECT_MODE = rf"""
WITH q AS (
  SELECT item_id AS query_id, text AS query FROM bench_items UNION ALL SELECT doc_id, text FROM documents WHERE text IS NOT NULL UNION ALL
  SELECT * FROM (VALUES (-1, 'acquire_lock()'), (-2, 'Saga.compensate'), (-3, '"exactly this"'), (-4, 'src/lock'), (-5, 'find iPhone'),
                        (-6, 'ACQUIRE_LOCK now please run it'), (-7, 'version 3.5 of the thing'), (-8, 'where do we take the lock')))
SELECT query_id, CASE WHEN regexp_matches(query, '[a-z0-9]_[a-z0-9]|[a-z][A-Z]|[\p{{L}}\p{{N}}_]+\(|[\p{{L}}\p{{N}}_]+\.[\p{{L}}\p{{N}}_]+|/|["\x27][^\n]+["\x27]') THEN 'hybrid'
  WHEN len(list_filter(regexp_split_to_array(query, '{SPACE}+'), lambda x: x <> '')) >= 5 THEN 'semantic' ELSE 'hybrid' END AS mode
FROM q
"""


def _terms(query: str) -> str:
    """The list of terms of a query, where look-behind is not at hand."""
    words = f"regexp_extract_all({query}, '[A-Za-z_][A-Za-z0-9_]{{1,}}')"
    parts = rf"flatten(list_transform({words}, lambda w: string_split(regexp_replace(w, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '_')))"
    return f"list_sort(list_distinct(list_transform(list_concat({words}, list_filter({parts}, lambda p: length(p) > 1)), lambda t: lower(t))))"


def _tokens(text: str) -> str:
    return rf"list_filter(string_split(regexp_replace(translate(lower(coalesce({text}, '')), '{MARKED}', '{PLAIN}'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '')"


QUERY_TERMS = f"""
WITH q AS (SELECT item_id AS query_id, text AS query FROM bench_items UNION ALL
  SELECT * FROM (VALUES (-1, 'HTTPServer getHTTPResponse a1B2'), (-2, '!!!'), (-3, '__init__ Über acquire_lock')))
SELECT query_id, array_to_string({_terms("query")}, ' ') AS terms FROM q
"""

TOKEN_STATS = f"""
WITH t AS (SELECT list_concat({_tokens("text")}, {_tokens("symbol")}) AS w FROM chunks)
SELECT (SELECT count(*) FROM t) AS n_chunks, (SELECT sum(len(w))::BIGINT FROM t) AS n_tokens, (SELECT count(DISTINCT u) FROM (SELECT unnest(w) AS u FROM t)) AS n_terms
"""

FENCE_LENGTH = r"""
WITH s AS (SELECT doc_id, CASE WHEN length(text) > 1500 THEN substring(text, 1, 1500) || chr(10) || '…(truncated)' ELSE text END AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, greatest(3, coalesce(list_max(list_transform(regexp_extract_all(s, '`+'), lambda x: length(x))), 0) + 1)::BIGINT AS n FROM s
"""

RENDER_SNIPPET = "SELECT doc_id, CASE WHEN length(text) > 1500 THEN substring(text, 1, 1500) || chr(10) || '…(truncated)' ELSE text END AS snippet FROM documents WHERE text IS NOT NULL"

ITEMS = "SELECT item_id AS query_id, text AS query FROM bench_items"


def _bm25(queries: str) -> str:
    """CTEs down to scored(query_id, chunk_pos, score)."""
    return f"""
q AS ({queries}),
tok AS (SELECT chunk_pos, 0 AS field, {_tokens("text")} AS w FROM chunks UNION ALL SELECT chunk_pos, 1, {_tokens("symbol")} FROM chunks),
stats AS (SELECT chunk_pos, sum(len(w)) AS n_tokens FROM tok GROUP BY ALL),
total AS (SELECT count(*)::DOUBLE AS total, avg(n_tokens) AS mean FROM stats),
pos AS (SELECT chunk_pos, field, unnest(w) AS term, generate_subscripts(w, 1) AS place FROM tok),
phrases AS (SELECT query_id, phrase, count(*) AS times FROM (
  SELECT query_id, array_to_string({_tokens("term")}, ' ') AS phrase FROM (SELECT query_id, unnest({_terms("query")}) AS term FROM q)) WHERE phrase <> '' GROUP BY ALL),
parts AS (SELECT phrase, n, unnest(w) AS term, generate_subscripts(w, 1) AS part FROM (SELECT DISTINCT phrase, string_split(phrase, ' ') AS w, len(string_split(phrase, ' ')) AS n FROM phrases)),
counts AS (SELECT phrase, chunk_pos, count(*) AS f FROM (
  SELECT phrase, n, chunk_pos, field, place - part AS start FROM pos JOIN parts USING (term) GROUP BY ALL HAVING count(*) = n) GROUP BY ALL),
weights AS (SELECT phrase, mean, CASE WHEN ln((total - h + 0.5) / (h + 0.5)) > 0 THEN ln((total - h + 0.5) / (h + 0.5)) ELSE 1e-6 END AS idf
  FROM (SELECT phrase, count(*)::DOUBLE AS h FROM counts GROUP BY ALL), total),
scored AS (SELECT query_id, chunk_pos, round(sum(idf * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n_tokens / mean)) * times), 6) AS score
  FROM counts JOIN weights USING (phrase) JOIN stats USING (chunk_pos) JOIN phrases USING (phrase) GROUP BY ALL)"""


def _ranked(k: int, keep: str = "true") -> str:
    return f"""ranked AS (SELECT query_id, chunk_pos, path, start_line, end_line, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, start_line, chunk_pos) - 1 AS rank
  FROM scored JOIN chunks USING (chunk_pos) WHERE {keep} QUALIFY rank < {k})"""


def _search(queries: str, k: int, keep: str = "true") -> str:
    return f"WITH {_bm25(queries)}, {_ranked(k, keep)} SELECT query_id::BIGINT AS query_id, chunk_pos, score, rank FROM ranked"


LEXICAL_LIKE = f"""
WITH q AS (SELECT item_id AS query_id, list_extract({_terms("text")}, 1) AS term FROM bench_items)
SELECT query_id, chunk_pos, 1.0::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY path, start_line, chunk_pos) - 1 AS rank
FROM q JOIN chunks ON lower(text) LIKE '%' || term || '%' QUALIFY rank < 10
"""

TEXT_RANK = f"""
WITH q AS (SELECT DISTINCT query_id, array_to_string({_tokens("term")}, ' ') AS phrase
  FROM (SELECT item_id AS query_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]+'), lambda t: lower(t)))) AS term FROM bench_items)),
phrases AS (SELECT query_id, phrase, count(*) OVER (PARTITION BY query_id) AS asked FROM q WHERE phrase <> ''),
parts AS (SELECT phrase, n, unnest(w) AS term, generate_subscripts(w, 1) AS part FROM (SELECT DISTINCT phrase, string_split(phrase, ' ') AS w, len(string_split(phrase, ' ')) AS n FROM phrases)),
pos AS (SELECT chunk_pos, unnest(w) AS term, generate_subscripts(w, 1) AS place FROM (SELECT chunk_pos, {_tokens("text")} AS w FROM chunks)),
counts AS (SELECT phrase, chunk_pos, count(*) AS f FROM (
  SELECT phrase, n, chunk_pos, place - part AS start FROM pos JOIN parts USING (term) GROUP BY ALL HAVING count(*) = n) GROUP BY ALL),
scored AS (SELECT query_id, chunk_pos, round(sum(list_sum(list_transform(range(1, least(f, 255) + 1), lambda n: 1.0::DOUBLE / (n * n))) * 0.1::DOUBLE / 1.64493406685::DOUBLE) / any_value(asked), 6) AS score
  FROM counts JOIN phrases USING (phrase) GROUP BY query_id, chunk_pos),
{_ranked(10)} SELECT query_id::BIGINT AS query_id, chunk_pos, score, rank FROM ranked
"""

_COSINE = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
COSINE_TOPK = f"SELECT e.vec_id AS id, round({_COSINE}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, id LIMIT 10"
COSINE_FILTERED = f"SELECT e.vec_id AS id, round({_COSINE}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label = 3 ORDER BY score DESC, id LIMIT 10"
COSINE_BATCH = f"""
SELECT q.vec_id AS query_id, e.vec_id AS id, round({_COSINE}, 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COSINE}, 6) DESC, e.vec_id) - 1 AS rank
FROM embeddings e JOIN embeddings q ON q.vec_id % 50 = 0 QUALIFY rank < 10
"""

HYBRID_SEARCH = f"""
WITH {_bm25(ITEMS)}, {_ranked(30)},
v AS (SELECT chunk_pos, path, start_line, end_line, vector::DOUBLE[64] AS v FROM chunks
  WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
near AS (SELECT r.query_id, e.chunk_pos, e.path, e.start_line, e.end_line, row_number() OVER (PARTITION BY r.query_id ORDER BY round(array_cosine_similarity(e.v, q.v), 6) DESC, e.chunk_pos) - 1 AS place
  FROM ranked r JOIN v q USING (chunk_pos) JOIN v e ON true WHERE r.rank = 0 QUALIFY place < 30),
arms AS (SELECT 0 AS arm, query_id, chunk_pos, path, start_line, end_line, place AS rank FROM near UNION ALL SELECT 1, query_id, chunk_pos, path, start_line, end_line, rank FROM ranked),
fused AS (SELECT query_id, path, start_line, end_line, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, min({{'arm': arm, 'rank': rank, 'chunk_pos': chunk_pos}}) AS x FROM arms GROUP BY ALL)
SELECT query_id, x.chunk_pos AS chunk_pos, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, x.arm, x.rank, path, start_line) - 1 AS rank FROM fused QUALIFY rank < 10
"""

RRF_FUSE = """
WITH a(q, arm, rank, path) AS (VALUES (1, 0, 0, 'a'), (1, 0, 1, 'b'), (1, 0, 2, 'c'), (1, 1, 0, 'b'), (1, 1, 1, 'd'), (1, 1, 2, 'a'), (2, 0, 0, 'x'), (2, 0, 1, 'x'), (2, 0, 2, 'y')),
f AS (SELECT q, path, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, min(arm * 10 + rank) AS first FROM a GROUP BY ALL)
SELECT q::BIGINT AS query_id, path, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, first) - 1 AS rank FROM f
"""

RERANK_HEAD = f"""
WITH {_bm25(ITEMS)}, {_ranked(20)},
o AS (SELECT r.*, count(*) OVER (PARTITION BY r.query_id) AS n,
        len(list_intersect(list_distinct({_tokens("b.text")}), list_distinct({_tokens("c.text")})))::DOUBLE AS relevance
      FROM ranked r JOIN chunks c USING (chunk_pos) JOIN bench_items b ON b.item_id = r.query_id),
h AS (SELECT *, rank < 10 AND n > 1 AS head FROM o)
SELECT query_id, chunk_pos, CASE WHEN head THEN relevance ELSE score END AS score,
       row_number() OVER (PARTITION BY query_id ORDER BY head DESC, CASE WHEN head THEN -relevance END NULLS LAST, rank) - 1 AS rank FROM h
"""

OVERFETCH_ARMS = """
WITH a AS (SELECT i AS asked, greatest(1, least(i, 50)) AS n FROM range(-2, 61) AS r(i)), m(mode) AS (VALUES ('semantic'), ('lexical'), ('hybrid')), k(rerank_top_k) AS (VALUES (NULL), (20))
SELECT asked, mode, rerank_top_k, greatest(CASE WHEN mode = 'hybrid' THEN greatest(n * 3, 10) ELSE n END, coalesce(rerank_top_k, 0)) AS arm_k FROM a, m, k
"""

_JUDGED = """
paths AS (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), path) - 1 AS rank FROM ranked GROUP BY query_id, path),
judged AS (
  SELECT item_id AS query_id, unnest(map_keys(relevant)) AS key, unnest(map_values(relevant)) AS gain FROM bench_items WHERE cardinality(relevant) > 0
  UNION ALL SELECT item_id, expect, 1.0 FROM bench_items WHERE coalesce(cardinality(relevant), 0) = 0 AND expect IS NOT NULL),
gains AS (SELECT query_id, path, rank, max(gain) AS gain FROM paths JOIN judged USING (query_id) WHERE rank < 10 AND (path = key OR ends_with(path, '/' || key)) GROUP BY ALL),
dcg AS (SELECT query_id, sum(gain / log2(rank + 2)) AS dcg FROM gains GROUP BY ALL),
ideal AS (SELECT query_id, sum(gain / log2(r + 2)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC) - 1 AS r FROM judged) WHERE r < 10 GROUP BY ALL),
scores AS (SELECT query_id, CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END AS ndcg FROM ideal LEFT JOIN dcg USING (query_id))"""

NDCG_AT_10 = f"WITH {_bm25(ITEMS)}, {_ranked(10)}, {_JUDGED} SELECT query_id, round(ndcg, 6) AS ndcg FROM scores"

FOUND_PRECISION = f"""
WITH {_bm25(ITEMS)}, {_ranked(10)}, {_JUDGED},
best AS (SELECT query_id, min(rank) AS r FROM paths JOIN bench_items ON item_id = query_id WHERE rank < 5 AND contains(path, expect) GROUP BY ALL)
SELECT count(*) AS n, round(avg((r IS NOT NULL)::INT), 6) AS found_at_k, round(avg(coalesce((r = 0)::INT, 0)), 6) AS precision_at_1, round(avg(coalesce(ndcg, 0)), 6) AS ndcg
FROM bench_items LEFT JOIN best ON best.query_id = item_id LEFT JOIN scores ON scores.query_id = item_id
"""

# levels look rules up by ruleId alone
_LEVELS = P4_FOUND[: P4_FOUND.index("named AS (")].strip().rstrip(",") + """,
leveled AS (SELECT r.request_id, coalesce(nullif(r.res->>'level', ''), nullif(l.level, ''), 'warning') AS level
  FROM results r LEFT JOIN levels l ON l.request_id = r.request_id AND l.run_no = r.run_no AND l.rule_id = r.res->>'ruleId')"""

SARIF_LEVELS = f"{_LEVELS} SELECT request_id, level, count(*) AS n FROM leveled GROUP BY ALL"


def _decisions(block: str, warn: str, most: str) -> str:
    """Decisions; block and warn are lists, most a number, all may use the columns of p (the request's policy)."""
    return f"""{_LEVELS},
p AS (SELECT d.request_id, {block} AS block, {warn} AS warn, {most} AS most
  FROM doc d JOIN (SELECT request_id, arg_max(TRY_CAST(policy AS JSON), (received_at, coalesce(policy, ''))) AS pol, arg_max(policy, (received_at, sarif)) AS raw FROM gate_requests GROUP BY ALL) g USING (request_id)
  WHERE j IS NOT NULL AND json_type(j) <> 'VARCHAR'),
c AS (SELECT p.request_id, any_value(block) AS block, any_value(most) AS most, count(l.level) FILTER (list_contains(block, l.level)) AS blocking, count(l.level) FILTER (list_contains(warn, l.level)) AS warnings, count(l.level) AS total
  FROM p LEFT JOIN leveled l USING (request_id) GROUP BY p.request_id),
r AS (SELECT *, list_filter([
    CASE WHEN blocking > 0 THEN blocking || ' finding(s) at blocking level [' || chr(39) || array_to_string(block, chr(39) || ', ' || chr(39)) || chr(39) || ']' END,
    CASE WHEN total > most THEN total || ' findings exceeds max_findings=' || most END], lambda x: x IS NOT NULL) AS reasons FROM c)
SELECT request_id, CASE WHEN len(reasons) > 0 THEN 'failed' ELSE 'success' END AS state, blocking, warnings, total, array_to_string(reasons, '; ') AS reasons FROM r
"""


GATE_DECISIONS = _decisions("['error']", "['warning']", "NULL::INT")
GATE_MAX = _decisions("[]::VARCHAR[]", "['warning']", "3")
GATE_OVERRIDE = _decisions(
    "coalesce(TRY_CAST(raw::JSON->'block_on' AS VARCHAR[]), ['error'])", "coalesce(TRY_CAST(raw::JSON->'warn_on' AS VARCHAR[]), ['warning'])", "TRY_CAST(raw::JSON->>'max_findings' AS INT)"
)

DASHBOARD_RECENT = """
SELECT id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS ts, project_id, sha, state, blocking::BIGINT AS blocking, warnings::BIGINT AS warnings, total::BIGINT AS total,
       array_to_string(coalesce(reasons, []), '; ') AS reasons
FROM gate_decisions ORDER BY id DESC LIMIT 100
"""

DASHBOARD_TOTALS = f"SELECT count(*) AS runs, count(*) FILTER (state = 'failed') AS failed, sum(blocking)::BIGINT AS blocking, sum(warnings)::BIGINT AS warnings FROM ({DASHBOARD_RECENT})"

P4_RESULTS = P4_FOUND[: P4_FOUND.index("places AS (")].strip().rstrip(",") + """
SELECT request_id, request_id || '/' || run_no || '/' || result_no AS pk, request_id || '/' || run_no AS parent_pk, run_no::INT AS run_no, result_no::INT AS result_no, rule_id,
       nullif(res->>'level', '') AS level, eff_level, coalesce(res->'message'->>'text', '') AS message, n_locations::INT AS n_locations
FROM leveled
"""

_TO_RESULTS = P4_FOUND[: P4_FOUND.index("named AS (")].strip().rstrip(",")
P4_RULES = _TO_RESULTS + """
SELECT request_id, request_id || '/' || run_no || '/rule/' || (rule_no - 1) AS pk, request_id || '/' || run_no AS parent_pk, run_no::INT AS run_no, (rule_no - 1)::INT AS rule_no,
       coalesce(rule->>'id', '') AS rule_id, nullif(rule->'defaultConfiguration'->>'level', '') AS default_level
FROM rules
"""
P4_LINKS = _TO_RESULTS + """
SELECT 'report' AS tag, request_id::VARCHAR AS pk, NULL::VARCHAR AS parent_pk FROM doc WHERE json_type(j) = 'OBJECT'
UNION ALL SELECT 'run', request_id || '/' || run_no, request_id::VARCHAR FROM runs
UNION ALL SELECT 'rule', request_id || '/' || run_no || '/rule/' || (rule_no - 1), request_id || '/' || run_no FROM rules
UNION ALL SELECT 'artifact', request_id || '/' || run_no || '/artifact/' || k.i, request_id || '/' || run_no FROM runs, range(0, coalesce(json_array_length(run, '$.artifacts'), 0)::BIGINT) AS k(i)
UNION ALL SELECT 'result', request_id || '/' || run_no || '/' || result_no, request_id || '/' || run_no FROM results
UNION ALL SELECT 'location', request_id || '/' || run_no || '/' || result_no || '/' || k.i, request_id || '/' || run_no || '/' || result_no
  FROM results, range(0, coalesce(json_array_length(res, '$.locations'), 0)::BIGINT) AS k(i)
"""

_PHRASES = "SELECT * FROM (VALUES (1, 'anchor_token'), (2, 'the index_span of __init__'), (3, 'refresh_token nested_volume')) AS t(query_id, query)"
_SYMBOLS = "SELECT * FROM (VALUES (1, 'InnerSpan'), (2, 'pad_loose_lathe'), (3, 'demoteOrphanStream')) AS t(query_id, query)"

WINDOW_CHUNKS = LINE_WINDOWS.replace("SELECT doc_id, string_split", "SELECT source AS project_id, coalesce(path, 'doc/' || doc_id || '.txt') AS path, string_split").replace(
    "WHERE text <> ''", "WHERE text <> '' AND NOT coalesce(path, '') LIKE '%.py'"
).replace("doc_id", "project_id, path").replace("|| project_id, path ||", "|| doc_id ||")
HASH_EMBED_NORMS = "SELECT sha1(text) AS sha, 64::BIGINT AS size, 1.0::DOUBLE AS norm, 1::BIGINT AS vectors, count(*) AS texts FROM chunks WHERE text IS NOT NULL GROUP BY text"
REST_SOURCE = "SELECT 'pkg/m' || i || '.py' AS path, 'def f():' || chr(10) || '    return 1' || chr(10) AS text FROM range(1, 3) AS r(i)"
_FILTERED = _search(ITEMS, 10, "project_id = 'meridian/atlas-core' AND ref = 'HEAD'")

ORACLES = {
    "p1_found": P1_FOUND, "p4_found": P4_FOUND, "p4_results": P4_RESULTS, "p4_rules": P4_RULES, "p4_links": P4_LINKS, "line_windows": LINE_WINDOWS, "window_chunks": WINDOW_CHUNKS, "hash_embed_norms": HASH_EMBED_NORMS, "rest_source": REST_SOURCE, "content_sha": CONTENT_SHA, "file_filter": FILE_FILTER,
    "url_hosts": URL_HOSTS, "host_allowlist": HOST_ALLOWLIST, "snapshot_paths": SNAPSHOT_PATHS, "apply_diff_counts": APPLY_DIFF_COUNTS,
    "file_sha_upsert": FILE_SHA_UPSERT, "meta_upsert": META_UPSERT, "chunk_counts_by_key": CHUNK_COUNTS, "index_status": INDEX_STATUS,
    "validate_queries": VALIDATE_QUERIES, "select_mode": SELECT_MODE, "query_terms": QUERY_TERMS, "token_stats": TOKEN_STATS, "fence_length": FENCE_LENGTH,
    "render_snippet": RENDER_SNIPPET, "lexical_batch_topk": _search(ITEMS, 10), "lexical_phrase": _search(_PHRASES, 10),
    "lexical_filtered": _FILTERED, "stored_search": _FILTERED, "lexical_like": LEXICAL_LIKE, "lexical_text_rank": TEXT_RANK, "symbol_lookup": _search(_SYMBOLS, 5),
    "cosine_topk": COSINE_TOPK, "cosine_topk_filtered": COSINE_FILTERED, "cosine_batch_topk": COSINE_BATCH, "hybrid_search": HYBRID_SEARCH, "rrf_fuse": RRF_FUSE,
    "rerank_head": RERANK_HEAD, "overfetch_arms": OVERFETCH_ARMS, "ndcg_at_10": NDCG_AT_10, "found_precision": FOUND_PRECISION, "sarif_levels": SARIF_LEVELS,
    "gate_decisions": GATE_DECISIONS, "gate_max_findings": GATE_MAX, "gate_policy_override": GATE_OVERRIDE, "dashboard_recent": DASHBOARD_RECENT,
    "dashboard_totals": DASHBOARD_TOTALS,
}
