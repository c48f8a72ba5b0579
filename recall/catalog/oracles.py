"""The registered queries once more, as SQL over the same tables.

Written in other ways than the jobs where there is a choice (joins on scope
conditions instead of grouping, recursion instead of a grouped function), so
that agreement means something.
"""

from __future__ import annotations

# Fixed values, written once more so that a mistake in the jobs' lists shows: characters of the Unicode White_Space property by number.
WHITESPACE = "".join(map(chr, (9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)))

# Words between subject and object, with the predicate they stand for, in the order of their tests.
MARKERS = (
    (" uses ", "uses"),
    (" depends on ", "depends_on"),
    (" is a ", "is_a"),
    (" is an ", "is_a"),
    (" created ", "created"),
    (" built ", "created"),
    (" works with ", "works_with"),
    (" replaced ", "supersedes"),
    (" migrated to ", "supersedes"),
    (" switched to ", "supersedes"),
    (" is part of ", "part_of"),
    (" belongs to ", "part_of"),
    (" implemented ", "created"),
    (" added ", "created"),
    (" configured ", "configured"),
    (" prefers ", "prefers"),
    (" chose ", "prefers"),
)

# Names that make an entity a technology, for a regular expression.
TECHNOLOGIES = (
    "react|go|python|rust|docker|kubernetes|postgres|redis|nginx|node|typescript|javascript|vue|angular|django|flask|fastapi|"
    "grpc|graphql|rest|api|sdk|cli|mcp|openai|gemini|ollama|pgvector|git"
)

NOW = "TIMESTAMP '2024-01-08 00:00:00'"
SINCE = "TIMESTAMP '2024-01-02 00:00:00'"
UNTIL = "TIMESTAMP '2024-01-20 12:00:00'"
LOW = "0.30"

MEM = """
mem AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id, d.text AS content,
    CASE e.event_type WHEN 'view' THEN 'fact' WHEN 'click' THEN 'conversation'
      WHEN 'purchase' THEN 'decision' WHEN 'signup' THEN 'code_pattern'
      WHEN 'error' THEN 'correction' END AS memory_type,
    CASE WHEN e.user_id % 5 = 0 THEN '' ELSE 'u' || (e.user_id % 20) END AS user_id,
    CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE d.lang END AS agent_id,
    CASE WHEN d.doc_id % 4 = 0 THEN '' ELSE d.source END AS app_id,
    CASE WHEN d.doc_id % 2 = 0 THEN '' ELSE 'run' || (d.doc_id % 7) END AS run_id,
    replace(e.props, '"k"', '"access_count"') AS metadata,
    sha256(d.text) AS content_hash,
    CAST(v.embedding AS DOUBLE[]) AS embedding,
    e.ts AS created_at, e.ts + to_hours(e.event_id % 240) AS updated_at, d.doc_id
  FROM documents d JOIN events e ON d.doc_id = e.event_id
  LEFT JOIN embeddings v ON v.vec_id = d.doc_id)
"""

VECTORS = "vectors AS (SELECT CAST(vec_id AS VARCHAR) AS query_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings)"


def _near(queries: str, memories: str, k: int, condition: str = "TRUE") -> str:
    """CTE of the k nearest memories ``m`` per query ``q``."""
    return f"""
near AS (
  SELECT q.query_id, m.id, d AS distance, 1 - d AS score,
    row_number() OVER (PARTITION BY q.query_id ORDER BY d, m.id) AS rank
  FROM {queries} q JOIN {memories} m ON m.embedding IS NOT NULL AND ({condition}),
    LATERAL (SELECT round(1 - list_cosine_similarity(q.vector, m.embedding), 12) AS d)
  QUALIFY rank <= {k})
"""


HITS = "SELECT query_id, id, rank, round(score, 6) AS score, round(distance, 6) AS distance FROM near"

_SCOPED = """
asked AS (SELECT id AS query_id, embedding AS vector, agent_id, created_at FROM mem WHERE embedding IS NOT NULL)
"""
_OWN_EARLIER = "(q.agent_id = '' OR m.agent_id = q.agent_id) AND m.created_at <= q.created_at"

_WS = f"'{WHITESPACE}'"


def _clean(c: str) -> str:
    """Name cleaning over a trimmed expression."""
    t = f"trim({c}, {_WS})"
    pair = " OR ".join(f"(starts_with({t}, '{q}') AND ends_with({t}, '{q}'))" for q in ('"', "''"))
    bare = f"CASE WHEN strlen({t}) >= 2 AND ({pair}) THEN substring({t}, 2, length({t}) - 2) ELSE {t} END"
    return f"trim(rtrim({bare}, '.,;:!?'), {_WS})"


_MARKER_ROWS = ", ".join(f"({i}, '{m}', '{p}')" for i, (m, p) in enumerate(MARKERS))


def _triples(texts: str) -> str:
    """CTEs ending in ``triples`` over a relation with memory_id and content."""
    return f"""
markers(pattern_pos, marker, predicate) AS (VALUES {_MARKER_ROWS}),
pieces AS (
  SELECT memory_id, trim(unnest(regexp_extract_all(content, '[^.!?\\n]*[.!?\\n]|[^.!?\\n]+$')), {_WS}) AS sentence
  FROM {texts}),
found AS (
  SELECT p.memory_id, m.predicate,
    substring(p.sentence, 1, strpos(lower(p.sentence), m.marker) - 1) AS s,
    substring(p.sentence, strpos(lower(p.sentence), m.marker) + length(m.marker)) AS o
  FROM pieces p JOIN markers m ON contains(lower(p.sentence), m.marker)
  WHERE strlen(p.sentence) >= 5),
cleaned AS (SELECT memory_id, {_clean("s")} AS subject, predicate, {_clean("o")} AS object FROM found),
triples AS (
  SELECT * FROM cleaned
  WHERE strlen(subject) BETWEEN 2 AND 100 AND strlen(object) BETWEEN 2 AND 100)
"""


def _entity(name: str) -> str:
    return f"('ent_' || substring(sha256(lower({name})), 1, 16))"


def _type(name: str) -> str:
    low = f"lower({name})"
    return f"""CASE WHEN contains({low}, '.') AND (contains({low}, '/') OR contains({low}, '\\')) THEN 'file'
      WHEN regexp_matches({low}, '[.](go|ts|py|js)$') THEN 'file'
      WHEN regexp_matches({low}, '{TECHNOLOGIES}') THEN 'technology' ELSE 'concept' END"""


TEXTS = "texts AS (SELECT CAST(doc_id AS VARCHAR) AS memory_id, text AS content FROM documents)"

STAR_LINES = """
lines AS (
  SELECT c_name || ' belongs to ' || n_name || '.' AS content FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL
  SELECT s_name || ' belongs to ' || n_name || '.' FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL
  SELECT n_name || ' is part of ' || r_name || '.' FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT DISTINCT s_name || ' created ' || p_name || '.' FROM lineitem
    JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
star AS (SELECT substring(sha256(content), 1, 16) AS memory_id, content FROM lines)
"""

STAR = f"""
{STAR_LINES}, {_triples("star")},
ends AS (SELECT memory_id, subject AS name FROM triples UNION ALL SELECT memory_id, object FROM triples),
entities AS (
  SELECT {_entity("name")} AS id, arg_max(name, memory_id) AS name, {_type("arg_max(name, memory_id)")} AS type
  FROM ends GROUP BY 1),
written AS (
  SELECT {_entity("subject")} AS from_id, {_entity("object")} AS to_id, predicate AS type, memory_id FROM triples),
relations AS (
  SELECT 'rel_' || substring(sha256(from_id || ':' || type || ':' || to_id), 1, 16) AS id,
    from_id, to_id, type, max(memory_id) AS memory_ids
  FROM written GROUP BY ALL)
"""

# Undirected steps and shortest distances by min over all walks.
_STEPS = """
steps AS (SELECT from_id AS a, to_id AS b FROM relations UNION SELECT to_id, from_id FROM relations)
"""


def _walk(starts: str, depth: int) -> str:
    parts = [f"walk0 AS (SELECT DISTINCT id AS start_id, id FROM {starts})"]
    for d in range(1, depth + 1):
        parts.append(
            f"walk{d} AS (SELECT DISTINCT w.start_id, s.b AS id FROM walk{d - 1} w JOIN steps s ON s.a = w.id)"
        )
    union = " UNION ALL ".join(f"SELECT start_id, id, {d} AS distance FROM walk{d}" for d in range(depth + 1))
    parts.append(f"reach AS (SELECT start_id, id, min(distance) AS distance FROM ({union}) GROUP BY 1, 2)")
    return _STEPS + ", " + ", ".join(parts)


NATIONS = f"nations AS (SELECT {_entity('n_name')} AS id FROM nation)"
REGIONS = f"regions AS (SELECT {_entity('r_name')} AS id FROM region)"

TRAITS = """
traits AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id, event_type AS key,
    CAST(arg_max(value, (ts, event_id)) AS VARCHAR) AS value,
    count(*) AS occurrences, min(ts) AS first_seen, max(ts) AS last_seen
  FROM events GROUP BY 1, 2)
"""

# Incoming batch: turns, then all documents scoped by language.
INCOMING = """
incoming AS (
  SELECT text AS content, 'conversation' AS memory_type, role AS agent_id, CAST(conv_id AS VARCHAR) AS run_id,
    0 AS part, conv_id, turn FROM conversations
  UNION ALL
  SELECT text, 'fact', lang, '', 1, doc_id, 0 FROM documents),
numbered AS (
  SELECT *, sha256(content) AS content_hash, row_number() OVER (ORDER BY part, conv_id, turn) AS seq
  FROM incoming WHERE content <> ''),
stored_match AS (
  SELECT i.seq, arg_min(m.id, (m.created_at, m.id)) AS id
  FROM numbered i JOIN mem m ON m.content_hash = i.content_hash
    AND (i.agent_id = '' OR i.agent_id = m.agent_id) AND (i.run_id = '' OR i.run_id = m.run_id)
  GROUP BY 1),
repeats AS (
  SELECT i.*, s.id AS stored_id,
    s.id IS NOT NULL OR EXISTS (
      SELECT 1 FROM numbered j WHERE j.content_hash = i.content_hash AND j.seq < i.seq
        AND (i.agent_id = '' OR i.agent_id = j.agent_id) AND (i.run_id = '' OR i.run_id = j.run_id)) AS repeated
  FROM numbered i LEFT JOIN stored_match s ON s.seq = i.seq)
"""

CHANGES = """
changes AS (
  SELECT CAST(e.event_id AS VARCHAR) AS id,
    CASE WHEN e.event_type = 'view' THEN d.text WHEN e.event_type <> 'click' THEN 'updated ' || e.props END AS content,
    CASE WHEN e.event_type <> 'purchase' THEN '{"reviewed": true}' END AS metadata
  FROM events e LEFT JOIN documents d ON d.doc_id = e.event_id)
"""

def _seeds(scope: str, mem: str = "mem", count: int = 200, k: int = 10) -> str:
    """CTEs of the newest rows of each scope and their nearest memories."""
    return f"""
seeds AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY {scope} ORDER BY created_at DESC, id) AS position,
      count(*) OVER (PARTITION BY {scope}) AS peers
    FROM {mem})
  WHERE position <= {count} AND peers > 1),
asked AS (SELECT id AS query_id, embedding AS vector FROM seeds WHERE embedding IS NOT NULL AND content <> ''),
{_near("asked", mem, k)}
"""


def _clusters(scope: str, threshold: str) -> str:
    """The greedy pass as a walk over the seeds of each scope, one seed per step."""
    return f"""
lists AS (
  SELECT s.{scope}, s.id, list(n.id ORDER BY n.rank) AS close,
    row_number() OVER (PARTITION BY s.{scope} ORDER BY s.position) AS step
  FROM seeds s JOIN near n ON n.query_id = s.id AND n.score >= {threshold}
  GROUP BY s.{scope}, s.id, s.position),
pass({scope}, step, visited, seed_id, members) AS (
  SELECT DISTINCT {scope}, 0::BIGINT, []::VARCHAR[], ''::VARCHAR, []::VARCHAR[] FROM lists
  UNION ALL
  SELECT l.{scope}, l.step,
    CASE WHEN list_contains(p.visited, l.id) THEN p.visited
      ELSE list_concat(p.visited, [l.id], list_filter(l.close, lambda x: NOT list_contains(p.visited, x) AND x <> l.id)) END,
    l.id,
    CASE WHEN list_contains(p.visited, l.id) THEN []::VARCHAR[]
      ELSE list_concat([l.id], list_filter(l.close, lambda x: NOT list_contains(p.visited, x) AND x <> l.id)) END
  FROM pass p JOIN lists l ON l.{scope} = p.{scope} AND l.step = p.step + 1),
clusters AS (SELECT {scope}, seed_id, unnest(members) AS id FROM pass WHERE len(members) > 1)
"""


def _embedded(texts: str) -> str:
    """CTE ``vectors`` (key, vector) of a relation with key and content: signed word counts by MD5, unit length."""
    return f"""
tokens AS (SELECT key, md5(unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+'))) AS digest FROM {texts}),
sums AS (
  SELECT key, ('0x' || substring(digest, 1, 15))::BIGINT % 64 AS place,
    sum(CASE WHEN ('0x' || substring(digest, 16, 1))::INTEGER % 2 = 1 THEN 1 ELSE -1 END)::DOUBLE AS s
  FROM tokens GROUP BY ALL),
norms AS (SELECT key, sqrt(sum(s * s)) AS norm FROM sums GROUP BY key),
vectors AS (
  SELECT t.key, list(CASE WHEN norm > 0 THEN CAST(coalesce(s, 0) / norm AS FLOAT) ELSE 0 END ORDER BY r.i) AS vector
  FROM {texts} t CROSS JOIN range(64) r(i) LEFT JOIN sums u ON u.key = t.key AND u.place = r.i LEFT JOIN norms n ON n.key = t.key
  GROUP BY t.key)
"""


EVENT_MEM = """
mem AS (
  SELECT CAST(e.event_id AS VARCHAR) AS id, d.text AS content,
    CASE e.event_type WHEN 'view' THEN 'fact' WHEN 'click' THEN 'conversation'
      WHEN 'purchase' THEN 'decision' WHEN 'signup' THEN 'code_pattern'
      WHEN 'error' THEN 'correction' END AS memory_type, e.value,
    'u' || (e.user_id % 20) AS user_id, 'a' || (e.event_id % 2) AS agent_id, v.vec_id, e.ts AS created_at
  FROM events e JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)
  JOIN embeddings v ON v.vec_id = e.event_id % (SELECT count(*) FROM embeddings))
"""

# Texts by hash, their vectors, and the memories with these.
TEXT_MEM = f"""
{MEM},
distinct_texts AS (SELECT DISTINCT content_hash AS key, content FROM mem),
{_embedded("distinct_texts")},
embedded AS (SELECT m.* EXCLUDE (embedding), CAST(v.vector AS DOUBLE[]) AS embedding FROM mem m JOIN vectors v ON v.key = m.content_hash)
"""

SEEDS = _seeds("user_id")
CLUSTERS = _clusters("user_id", LOW)

EXCERPT = f"""CASE WHEN strlen(trim(content, {_WS})) <= 80 THEN trim(content, {_WS})
  ELSE list_aggregate(list_transform(range(0, 78), lambda n: CASE WHEN strlen(substring(trim(content, {_WS}), 1, n)) <= 77
    THEN substring(trim(content, {_WS}), 1, n) ELSE '' END), 'max') || '...' END"""

def _pairs(scope: str, cutoff: str) -> str:
    return f"""
pairs AS (
  SELECT c.{scope}, f.id AS fact_id, c.id AS correction_id,
    {EXCERPT.replace("content", "f.content")} AS fact_excerpt,
    {EXCERPT.replace("content", "c.content")} AS correction_excerpt, n.score
  FROM seeds c JOIN near n ON n.query_id = c.id AND n.rank <= 3 AND n.score > {cutoff}
    JOIN seeds f ON f.id = n.id AND f.{scope} = c.{scope}
  WHERE c.memory_type = 'correction' AND f.memory_type = 'fact' AND c.created_at >= f.created_at)
"""


PAIRS = _pairs("user_id", LOW)


def _go_quoted(c: str) -> str:
    out = f"replace({c}, '\\', '\\\\')"
    for raw, escaped in (("'\"'", '\\"'), ("chr(10)", "\\n"), ("chr(9)", "\\t"), ("chr(13)", "\\r"), ("chr(12)", "\\f"), ("chr(11)", "\\v"), ("chr(7)", "\\a"), ("chr(8)", "\\b")):
        out = f"replace({out}, {raw}, '{escaped}')"
    return f"'\"' || {out} || '\"'"


INSIGHTS = f"""
insights AS (
  SELECT c.user_id,
    'Consolidated from ' || count(*) || ' related memories. Latest: ' || arg_max(m.content, (m.created_at, m.id)) AS content,
    string_agg(m.id, ',' ORDER BY m.created_at, m.id) AS source_ids, 'summary' AS insight_type, 0.8::DOUBLE AS confidence
  FROM clusters c JOIN mem m ON m.id = c.id GROUP BY c.user_id, c.seed_id
  UNION ALL
  SELECT user_id, 'Potential contradiction: fact ' || {_go_quoted("fact_excerpt")}
      || ' may be superseded by correction ' || {_go_quoted("correction_excerpt")},
    fact_id || ',' || correction_id, 'contradiction', score
  FROM pairs)
"""

TRAIT_LINES = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY occurrences DESC, key) AS rank FROM traits)
"""

_TRIPLE_COLUMNS = "SELECT memory_id, subject, predicate, object FROM triples"
_TYPE_STATS = (
    "SELECT event_type AS memory_type, count(*) AS total, min(ts) AS oldest_at, max(ts) AS newest_at "
    "FROM events GROUP BY 1"
)

ORACLES: dict[str, str] = {
    "mem_scan": f"WITH {MEM} SELECT id, memory_type, user_id, agent_id, app_id, run_id, metadata, content_hash, created_at, updated_at FROM mem",
    "mem_filter_scope_time": f"""WITH {MEM} SELECT id, user_id, agent_id, memory_type, created_at FROM mem
        WHERE agent_id = 'en' AND memory_type = 'fact' AND created_at BETWEEN {SINCE} AND {UNTIL}""",
    "mem_filter_all": f"""WITH {MEM}, filters(filter, u, a, r) AS (VALUES (0, 'u4', '', 'run2'), (1, '', 'src1', 'run1'), (2, 'u8', 'src2', ''), (3, 'u12', '', ''))
        SELECT filter, id, user_id, app_id, run_id FROM mem, filters
        WHERE (u = '' OR user_id = u) AND (a = '' OR app_id = a) AND (r = '' OR run_id = r)""",
    "mem_lookup_ids": f"""WITH {MEM} SELECT CAST(e.event_id AS VARCHAR) AS id, m.id IS NOT NULL AS found, m.memory_type, m.content_hash
        FROM events e LEFT JOIN mem m ON m.id = CAST(e.event_id AS VARCHAR)""",
    "mem_lookup_hash": f"""WITH {MEM}, lookups AS (
          SELECT 'd' || doc_id AS lookup_id, sha256(text) AS content_hash, lang AS agent_id FROM documents
          UNION ALL SELECT 'c-' || conv_id || '-' || turn, sha256(text), '' FROM conversations)
        SELECT l.lookup_id, l.content_hash, l.agent_id, arg_min(m.id, (m.created_at, m.id)) AS id
        FROM lookups l LEFT JOIN mem m ON m.content_hash = l.content_hash AND (l.agent_id = '' OR l.agent_id = m.agent_id)
        GROUP BY ALL""",
    "mem_list_page": f"""WITH {MEM} SELECT id, memory_type, created_at FROM mem WHERE memory_type = 'fact'
        ORDER BY created_at DESC, id LIMIT 50 OFFSET 20""",
    "mem_list_deep": f"""WITH {EVENT_MEM} SELECT id, sha256(content) AS content_hash, created_at FROM mem
        ORDER BY created_at DESC, id LIMIT 700 OFFSET 4000""",
    "mem_list_total": f"WITH {MEM} SELECT count(*) AS total FROM mem WHERE memory_type = 'fact'",
    "mem_recent_per_scope": f"""WITH {MEM} SELECT user_id, id, created_at,
          row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS position
        FROM mem QUALIFY position <= 20""",
    "mem_stats_total": f"WITH {MEM} SELECT count(*) AS total FROM mem",
    "mem_stats_by_type": f"WITH {MEM} SELECT memory_type, count(*) AS total FROM mem GROUP BY 1",
    "mem_stats_by_user": f"WITH {MEM} SELECT user_id, count(*) AS total FROM mem GROUP BY 1",
    "mem_stats_range": f"""WITH {MEM} SELECT min(created_at) AS oldest_at, max(created_at) AS newest_at
        FROM mem WHERE agent_id = 'en'""",
    "mem_stats_summary": f"""WITH {MEM}, t AS (SELECT memory_type, count(*) AS n FROM mem GROUP BY 1)
        SELECT (SELECT CAST(sum(n) AS BIGINT) FROM t) AS total,
          (SELECT string_agg(memory_type || '=' || n, ',' ORDER BY memory_type) FROM t) AS by_type,
          (SELECT min(created_at) FROM mem) AS oldest_at, (SELECT max(created_at) FROM mem) AS newest_at""",
    "ingest_validate": """SELECT event_id,
          CASE event_type WHEN 'error' THEN 'unknown' WHEN 'view' THEN 'fact' ELSE 'correction' END AS memory_type,
          CASE WHEN event_type = 'error' THEN 'invalid memory type' WHEN value < 10 THEN 'content cannot be empty' END AS reason
        FROM events""",
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "dedup_scope": f"""WITH {MEM}
        SELECT i.doc_id, min(j.doc_id) = i.doc_id AS is_new, min(j.doc_id) AS first_doc_id
        FROM mem i JOIN mem j ON j.content_hash = i.content_hash
          AND (i.user_id = '' OR i.user_id = j.user_id) AND (i.agent_id = '' OR i.agent_id = j.agent_id)
          AND (i.app_id = '' OR i.app_id = j.app_id) AND (i.run_id = '' OR i.run_id = j.run_id)
        GROUP BY i.doc_id""",
    "ingest_new_rows": f"""WITH {MEM}, {INCOMING}
        SELECT content_hash, memory_type, '' AS user_id, agent_id, '' AS app_id, run_id, '{{}}' AS metadata,
          64 AS dimensions, {NOW} AS created_at
        FROM repeats WHERE NOT repeated""",
    "ingest_duplicates": f"WITH {MEM}, {INCOMING} SELECT part, conv_id, turn, stored_id FROM repeats WHERE repeated",
    "update_apply": f"""WITH {MEM}, {CHANGES}
        SELECT m.id, CASE WHEN c.content <> m.content THEN sha256(c.content) ELSE m.content_hash END AS content_hash,
          CASE WHEN c.metadata IS NULL THEN m.metadata
            ELSE CAST(json_merge_patch(CAST(m.metadata AS JSON), CAST(c.metadata AS JSON)) AS VARCHAR) END AS metadata,
          m.created_at, CASE WHEN c.id IS NULL THEN m.updated_at ELSE {NOW} END AS updated_at,
          CASE WHEN c.content <> m.content OR m.embedding IS NOT NULL THEN 64 ELSE 0 END AS dimensions
        FROM mem m LEFT JOIN changes c ON c.id = m.id""",
    "update_rejects": f"""WITH {MEM}, {CHANGES} SELECT id, 'memory not found' AS reason FROM changes
        WHERE id NOT IN (SELECT id FROM mem)""",
    "update_repeated": f"""WITH {MEM}, turns AS (SELECT CAST(conv_id AS VARCHAR) AS id,
          arg_max(text, turn) FILTER (WHERE role = 'user' AND text IS NOT NULL) AS content, max(turn) AS turn,
          max(turn) FILTER (WHERE turn % 3 = 0) AS k0, max(turn) FILTER (WHERE turn % 3 = 1) AS k1,
          max(turn) FILTER (WHERE turn % 3 = 2) AS k2
        FROM conversations GROUP BY 1)
        SELECT m.id, coalesce(sha256(t.content), m.content_hash) AS content_hash,
          CASE WHEN t.id IS NULL THEN m.updated_at ELSE {NOW} END AS updated_at,
          json_extract_string(m.metadata, '$.access_count') AS access_count, CAST(t.turn AS VARCHAR) AS turn,
          CAST(k0 AS VARCHAR) AS k0, CAST(k1 AS VARCHAR) AS k1, CAST(k2 AS VARCHAR) AS k2
        FROM mem m LEFT JOIN turns t ON t.id = m.id""",
    "metadata_merge": f"""WITH {MEM} SELECT id,
          CAST(json_merge_patch(CAST(metadata AS JSON), json_object('pinned', true, 'source', user_id)) AS VARCHAR) AS metadata
        FROM mem""",
    "delete_apply": f"""WITH {MEM} SELECT id, content_hash FROM mem
        WHERE id NOT IN (SELECT CAST(event_id AS VARCHAR) FROM events WHERE event_type = 'error')""",
    "embed_documents": "SELECT CAST(doc_id AS VARCHAR) AS memory_id, 64 AS dimensions, 1.0::DOUBLE AS norm FROM documents",
    "knn_topk": f"WITH {MEM}, {VECTORS}, {_near('vectors', 'mem', 5)} {HITS}",
    "knn_topk_filtered": f"""WITH {MEM}, {VECTORS}, {_near('vectors', 'mem', 5, "m.memory_type = 'fact'")}
        SELECT n.query_id, n.id, n.rank, round(n.score, 6) AS score, m.user_id, m.created_at FROM near n JOIN mem m ON m.id = n.id""",
    "knn_query_filters": f"WITH {MEM}, {_SCOPED}, {_near('asked', 'mem', 5, _OWN_EARLIER)} {HITS}",
    "knn_cells": f"WITH {MEM}, {_SCOPED}, {_near('asked', 'mem', 5, _OWN_EARLIER)} {HITS}",
    # Distances by pair of vectors, ranked among the memories of each scope.
    "knn_same_scope": f"""WITH {EVENT_MEM},
        away AS (SELECT a.vec_id AS q, b.vec_id, round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 12) AS d
          FROM embeddings a, embeddings b),
        asked AS (SELECT DISTINCT user_id, agent_id, vec_id AS q FROM mem),
        ranked AS (SELECT k.user_id, k.agent_id, k.q, m.id, d, row_number() OVER (PARTITION BY k.user_id, k.agent_id, k.q ORDER BY d, m.id) AS rank
          FROM asked k JOIN mem m USING (user_id, agent_id) JOIN away a ON a.q = k.q AND a.vec_id = m.vec_id QUALIFY rank <= 3)
        SELECT m.id AS query_id, r.id, r.rank, round(1 - d, 6) AS score, round(d, 6) AS distance
        FROM mem m JOIN ranked r ON r.user_id = m.user_id AND r.agent_id = m.agent_id AND r.q = m.vec_id""",
    "knn_min_score": f"WITH {MEM}, {VECTORS}, {_near('vectors', 'mem', 10)} {HITS} WHERE score >= {LOW}",
    "frequency_extract": """WITH given AS (
          SELECT event_id, CASE event_type WHEN 'click' THEN replace(props, '"k"', '"access_count"')
              WHEN 'view' THEN '{"access_count": "' || value || '"}' WHEN 'error' THEN props
              WHEN 'signup' THEN '{"access_count": ' || value || '}' ELSE substring(props, 1, 4) END AS metadata
          FROM events),
        read AS (SELECT event_id, TRY_CAST(metadata AS JSON) AS j FROM given)
        SELECT event_id, CASE WHEN json_type(j, '$.access_count') IN ('UBIGINT', 'BIGINT', 'DOUBLE')
            AND CAST(json_extract_string(j, '$.access_count') AS DOUBLE) > 0
          THEN CAST(json_extract_string(j, '$.access_count') AS DOUBLE) ELSE 1.0 END AS frequency
        FROM read""",
    "recency_score": f"""WITH {MEM} SELECT id,
          round(pow(2, -greatest(0, (epoch_us({NOW}) - epoch_us(updated_at)) / 3600000000.0) / 168), 6) AS recency FROM mem""",
    "hybrid_rank": f"""WITH {MEM}, {VECTORS}, {_near('vectors', 'mem', 10, "m.memory_type = 'fact'")},
        scored AS (SELECT n.query_id, n.id, n.score AS similarity_score,
            pow(2, -greatest(0, (epoch_us({NOW}) - epoch_us(m.updated_at)) / 3600000000.0) / 168) AS recency_score,
            greatest(CAST(json_extract_string(m.metadata, '$.access_count') AS DOUBLE), 0) AS uses
          FROM near n JOIN mem m ON m.id = n.id),
        shares AS (SELECT *, CASE WHEN uses > 0 THEN uses ELSE 1 END
            / greatest(1, max(CASE WHEN uses > 0 THEN uses ELSE 1 END) OVER (PARTITION BY query_id)) AS frequency_score FROM scored)
        SELECT query_id, id, round(similarity_score, 6) AS similarity_score, round(recency_score, 6) AS recency_score,
          round(frequency_score, 6) AS frequency_score,
          round(0.6 * similarity_score + 0.25 * recency_score + 0.15 * frequency_score, 6) AS final_score,
          row_number() OVER (PARTITION BY query_id ORDER BY 0.6 * similarity_score + 0.25 * recency_score + 0.15 * frequency_score
            DESC NULLS LAST, id) AS final_rank FROM shares""",
    "consolidate_clusters": f"WITH RECURSIVE {MEM}, {SEEDS}, {CLUSTERS} SELECT user_id, seed_id, id FROM clusters",
    "consolidate_insights": f"""WITH RECURSIVE {MEM}, {SEEDS}, {CLUSTERS}, {PAIRS}, {INSIGHTS}
        SELECT user_id, sha256(content) AS content_hash, source_ids, insight_type, round(confidence, 6) AS confidence FROM insights""",
    "consolidate_results": f"""WITH RECURSIVE {MEM}, {SEEDS}, {CLUSTERS}
        SELECT m.user_id, count(*) AS processed_count,
          (SELECT count(*) FROM clusters c WHERE c.user_id = m.user_id) AS merged_count
        FROM mem m GROUP BY m.user_id""",
    "consolidate_contradictions": f"""WITH {MEM}, {SEEDS}, {PAIRS}
        SELECT user_id, fact_id, correction_id, fact_excerpt, correction_excerpt, round(score, 6) AS score FROM pairs""",
    "text_excerpt": f"SELECT doc_id, {EXCERPT} AS excerpt FROM (SELECT doc_id, text AS content FROM documents)",
    "store_delete": f"""WITH {EVENT_MEM} SELECT id, sha256(content) AS content_hash, memory_type FROM mem WHERE value >= 10""",
    "ingest_rejects": """WITH turns AS (
          SELECT conv_id, turn, CASE WHEN conv_id % 9 = 0 THEN '' ELSE text END AS content, turn % 4 = 3 AS bad, role FROM conversations),
        usable AS (SELECT * FROM turns WHERE NOT bad AND content <> ''),
        fresh AS (
          SELECT u.* FROM usable u
          WHERE NOT EXISTS (SELECT 1 FROM usable x WHERE x.content = u.content AND x.role = u.role AND x.conv_id = u.conv_id AND x.turn < u.turn)
            AND sha256(u.content) NOT IN (SELECT sha256(text) FROM documents))
        SELECT conv_id, turn, CASE WHEN bad THEN 'invalid memory type' ELSE 'content cannot be empty' END AS reason
        FROM turns WHERE bad OR content = ''
        UNION ALL
        SELECT conv_id, turn, CASE WHEN length(content) % 5 = 0 THEN 'no embedding' ELSE 'wrong embedding size' END
        FROM fresh WHERE length(content) % 5 = 0 OR length(content) % 7 = 0""",
    "embed_vectors": f"""WITH texts AS (SELECT CAST(doc_id AS VARCHAR) AS key, text AS content FROM documents), {_embedded("texts")}
        SELECT key AS memory_id, array_to_string(list_transform(vector, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000000) AS BIGINT)), ',') AS vector
        FROM vectors""",
    "text_search": f"""WITH {TEXT_MEM},
        turns AS (SELECT conv_id || '-' || turn AS key, text AS content FROM conversations WHERE text <> ''),
        {_embedded("turns").replace("tokens", "tokens2").replace("sums", "sums2").replace("norms", "norms2").replace("vectors", "vectors2")},
        asked AS (SELECT key AS query_id, CAST(vector AS DOUBLE[]) AS vector FROM vectors2),
        {_near("asked", "embedded", 5)}
        SELECT n.query_id, n.id, n.rank, round(n.score, 6) AS score, m.memory_type FROM near n JOIN mem m ON m.id = n.id""",
    "hybrid_rank_half_life": f"""WITH {MEM}, {VECTORS}, {_near('vectors', 'mem', 5)}, lives(half_life, hours) AS (VALUES ('day', 24.0), ('default', 168.0)),
        scored AS (SELECT l.half_life, n.query_id, n.id, n.score,
            pow(2, -greatest(0, (epoch_us({NOW}) - epoch_us(m.updated_at)) / 3600000000.0) / l.hours) AS recency,
            greatest(CAST(json_extract_string(m.metadata, '$.access_count') AS DOUBLE), 0) AS given
          FROM near n JOIN mem m ON m.id = n.id, lives l),
        used AS (SELECT *, CASE WHEN given > 0 THEN given ELSE 1 END AS uses FROM scored),
        final AS (SELECT *, 0.6 * score + 0.25 * recency + 0.15 * uses / greatest(1, max(uses) OVER (PARTITION BY half_life, query_id)) AS total FROM used)
        SELECT half_life, query_id, id, round(recency, 6) AS recency_score,
          row_number() OVER (PARTITION BY half_life, query_id ORDER BY total DESC NULLS LAST, id) AS final_rank FROM final""",
    "consolidate_texts": f"""WITH RECURSIVE {TEXT_MEM}, {_seeds("agent_id", "embedded")}, {_clusters("agent_id", "0.85")}, {_pairs("agent_id", "0.7")}
        SELECT c.agent_id, string_agg(m.id, ',' ORDER BY m.created_at, m.id) AS source_ids, 'summary' AS insight_type, 0.8::DOUBLE AS confidence
        FROM clusters c JOIN mem m ON m.id = c.id GROUP BY c.agent_id, c.seed_id
        UNION ALL SELECT agent_id, fact_id || ',' || correction_id, 'contradiction', round(score, 6) FROM pairs""",
    # Nearest memories by distinct vector; the pass keeps one row for each scope.
    "consolidate_large": f"""WITH RECURSIVE {EVENT_MEM},
        seeds AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY created_at DESC, id) AS position FROM mem QUALIFY position <= 5000),
        away AS (SELECT a.vec_id AS q, b.vec_id, round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 12) AS d
          FROM embeddings a, embeddings b),
        near AS (SELECT q, m.id, d, row_number() OVER (PARTITION BY q ORDER BY d, m.id) AS rank
          FROM away JOIN mem m USING (vec_id) QUALIFY rank <= 30),
        lists AS (SELECT q, list(id ORDER BY rank) AS close FROM near WHERE 1 - d >= {LOW} GROUP BY q),
        steps AS (SELECT agent_id, position, id, close FROM seeds JOIN lists ON q = vec_id WHERE content <> ''),
        turns AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY position) AS step FROM steps),
        pass(agent_id, step, visited, found) USING KEY (agent_id) AS (
          SELECT DISTINCT agent_id, 0::BIGINT, []::VARCHAR[], []::STRUCT(seed_id VARCHAR, id VARCHAR)[] FROM turns
          UNION ALL
          SELECT t.agent_id, t.step,
            CASE WHEN list_contains(p.visited, t.id) THEN p.visited
              ELSE list_concat(p.visited, [t.id], list_filter(t.close, lambda x: NOT list_contains(p.visited, x) AND x <> t.id)) END,
            CASE WHEN list_contains(p.visited, t.id) THEN p.found
              ELSE list_concat(p.found, list_transform(list_filter(t.close, lambda x: NOT list_contains(p.visited, x) AND x <> t.id),
                lambda x: {{'seed_id': t.id, 'id': x}})) END
          FROM pass p JOIN turns t ON t.agent_id = p.agent_id AND t.step = p.step + 1),
        members AS (SELECT agent_id, unnest(found, recursive := true) FROM pass)
        SELECT agent_id, seed_id, id FROM members UNION SELECT agent_id, seed_id, seed_id FROM members""",
    "text_excerpt_wide": f"SELECT doc_id, {EXCERPT} AS excerpt FROM (SELECT doc_id, translate(text, 'aeiot', 'äé€𝄞ß') AS content FROM documents)",
    "graph_walk": f"""WITH {STAR}, {REGIONS}, {_walk('regions', 3)}
        SELECT a.asked, r.start_id, e.id, r.distance FROM reach r JOIN entities e ON e.id = r.id
        JOIN (VALUES (0, 1), (9, 3)) a(asked, most) ON r.distance <= a.most WHERE r.distance > 0""",
    "graph_add_stored": f"""WITH {STAR}, parts AS (
          SELECT {_entity('name')} AS id, min(memory_id < '8') AS late, max(memory_id < '8') AS early, bool_or(memory_id >= '8') AS again FROM ends GROUP BY 1)
        SELECT e.id, e.name, e.type, CASE WHEN early THEN {NOW} ELSE {UNTIL} END AS created_at, CASE WHEN again THEN {UNTIL} ELSE {NOW} END AS updated_at
        FROM entities e JOIN parts p ON p.id = e.id""",
    "graph_add_stream": f"""WITH {STAR}, mentions AS (SELECT {_entity('name')} AS entity_id, count(DISTINCT memory_id) AS memories FROM ends GROUP BY 1),
        started AS (SELECT from_id, count(*) AS started, max(memory_ids) AS last_memory FROM relations GROUP BY 1)
        SELECT e.id, e.name, e.type, m.memories, coalesce(s.started, 0) AS started, s.last_memory
        FROM entities e JOIN mentions m ON m.entity_id = e.id LEFT JOIN started s ON s.from_id = e.id""",
    "graph_roundtrip": f"""WITH {STAR}, mentions AS (SELECT {_entity('name')} AS entity_id, count(DISTINCT memory_id) AS memories FROM ends GROUP BY 1)
        SELECT r.id, r.from_id, r.to_id, r.type, r.memory_ids, m.memories FROM relations r JOIN mentions m ON m.entity_id = r.from_id""",
    "graph_triples": f"WITH {TEXTS}, {_triples('texts')} {_TRIPLE_COLUMNS}",
    "graph_triples_star": f"WITH {STAR_LINES}, {_triples('star')} {_TRIPLE_COLUMNS}",
    "graph_entities": f"WITH {STAR} SELECT id, name, type FROM entities",
    "graph_mentions": f"WITH {STAR} SELECT DISTINCT {_entity('name')} AS entity_id, memory_id FROM ends",
    "graph_relations": f"WITH {STAR} SELECT id, from_id, to_id, type, 1.0::DOUBLE AS weight, memory_ids FROM relations",
    "graph_upsert_entities": f"""WITH {STAR}, fresh AS (
          SELECT {_entity('p_name')} AS id, arg_max(upper(p_name), p_partkey) AS name FROM part GROUP BY 1)
        SELECT coalesce(f.id, e.id) AS id, coalesce(f.name, e.name) AS name,
          CASE WHEN f.id IS NULL THEN e.type ELSE 'part' END AS type,
          CASE WHEN e.id IS NULL THEN {UNTIL} ELSE {NOW} END AS created_at,
          CASE WHEN f.id IS NULL THEN {NOW} ELSE {UNTIL} END AS updated_at
        FROM entities e FULL JOIN fresh f ON f.id = e.id""",
    "graph_entity_types": f"""WITH names AS (SELECT url AS name FROM pages UNION ALL SELECT p_name FROM part)
        SELECT name, {_entity('name')} AS id, {_type('name')} AS type FROM names""",
    "graph_add_counts": f"""WITH {TEXTS}, {_triples('texts')}, ends AS (
          SELECT memory_id, lower(subject) AS name FROM triples UNION ALL SELECT memory_id, lower(object) FROM triples)
        SELECT t.memory_id, (SELECT count(*) FROM triples x WHERE x.memory_id = t.memory_id) AS triples_extracted,
          (SELECT count(DISTINCT name) FROM ends x WHERE x.memory_id = t.memory_id) AS entities_added,
          (SELECT count(*) FROM triples x WHERE x.memory_id = t.memory_id) AS relations_added
        FROM texts t""",
    "graph_lookup": f"""WITH {STAR}, {NATIONS}, asked AS (
          SELECT id FROM nations UNION ALL SELECT DISTINCT {_entity('o_orderpriority')} FROM orders)
        SELECT a.id, e.name, e.type FROM asked a LEFT JOIN entities e ON e.id = a.id""",
    "graph_find": f"""WITH {STAR}, asked AS (
          SELECT n_name AS query FROM nation UNION SELECT CAST(p_size AS VARCHAR) FROM part
          UNION SELECT upper(split_part(p_name, ' ', 1)) FROM part UNION SELECT '' FROM region)
        SELECT a.query AS query_id, e.id, e.name, row_number() OVER (PARTITION BY a.query ORDER BY e.name, e.id) AS rank
        FROM asked a JOIN entities e ON contains(lower(e.name), lower(a.query)) QUALIFY rank <= 10""",
    "graph_relations_of": f"""WITH {STAR}, asked AS (SELECT DISTINCT {_entity('s_name')} AS id FROM supplier)
        SELECT a.id AS entity_id, r.id, r.from_id, r.to_id, r.type FROM asked a JOIN relations r ON r.from_id = a.id
        UNION SELECT a.id, r.id, r.from_id, r.to_id, r.type FROM asked a JOIN relations r ON r.to_id = a.id""",
    "graph_khop2": f"""WITH {STAR}, {NATIONS}, {_walk('nations', 2)}
        SELECT r.start_id, e.id, e.name, r.distance FROM reach r JOIN entities e ON e.id = r.id WHERE r.distance > 0""",
    "graph_khop3": f"""WITH {STAR}, {REGIONS}, {_walk('regions', 3)}
        SELECT r.start_id, e.id, r.distance FROM reach r JOIN entities e ON e.id = r.id WHERE r.distance > 0""",
    "graph_khop_edges": f"""WITH {STAR}, {NATIONS}, {_walk('nations', 1)}
        SELECT DISTINCT w.start_id, r.id, r.from_id, r.to_id
        FROM reach w JOIN relations r ON r.from_id = w.id OR r.to_id = w.id""",
    "graph_stats": f"""WITH {STAR} SELECT (SELECT count(*) FROM entities) AS entity_count,
          (SELECT count(*) FROM relations) AS relation_count""",
    "profile_traits": f"WITH {TRAITS} SELECT * FROM traits",
    "profile_merge": f"WITH {TRAITS} SELECT * FROM traits",
    "profile_lookup": f"""WITH {TRAITS}, asked AS (
          SELECT CAST(c_custkey AS VARCHAR) AS user_id, CASE WHEN c_acctbal > 0 THEN 'purchase' ELSE 'refund' END AS key FROM customer)
        SELECT a.user_id, a.key, t.value, coalesce(t.occurrences, 0) AS occurrences FROM asked a
        LEFT JOIN traits t ON t.user_id = a.user_id AND t.key = a.key""",
    "profile_counts": f"WITH {TRAITS} SELECT user_id, count(*) AS traits FROM traits GROUP BY 1",
    "profile_top": f"WITH {TRAITS}, {TRAIT_LINES} SELECT user_id, key, occurrences, rank FROM ranked WHERE rank <= 2",
    "profile_summary": f"""WITH {TRAITS}, {TRAIT_LINES}, texts AS (
          SELECT user_id, 'Profile for ' || user_id || ':' || chr(10)
            || string_agg('- ' || key || ': ' || value || chr(10), '' ORDER BY rank) AS summary
          FROM ranked WHERE rank <= 10 GROUP BY user_id)
        SELECT CAST(c.c_custkey AS VARCHAR) AS user_id, coalesce(t.summary, 'No profile data yet.') AS summary
        FROM customer c LEFT JOIN texts t ON t.user_id = CAST(c.c_custkey AS VARCHAR)""",
    "stream_triples": f"WITH {TEXTS}, {_triples('texts')} {_TRIPLE_COLUMNS}",
    "stream_traits": f"WITH {TRAITS} SELECT * FROM traits",
    "stream_type_stats": _TYPE_STATS,
    "stream_ingest": """WITH first AS (SELECT DISTINCT text, lang FROM documents)
        SELECT sha256(text) AS content_hash, 'fact' AS memory_type, lang AS agent_id, 64 AS dimensions FROM first
        UNION ALL SELECT DISTINCT sha256(text), 'fact', '', 64 FROM conversations WHERE text NOT IN (SELECT text FROM first)""",
}
ORACLES["store_update"] = ORACLES["update_apply"]
ORACLES["graph_find_stored"] = ORACLES["graph_find"]
