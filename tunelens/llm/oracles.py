"""SQL counterparts of the corpus queries that SQL can express, for DuckDB."""

from __future__ import annotations

# Words are runs of other characters than the space and 0x09 to 0x0D.
_WORD = "[^ \\t\\n\\x0B\\f\\r]+"
_CONTROLS = "|".join(
    f"\\Q{c}\\E" for c in ("<<SYS>>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "</s>", "<s>", "<</SYS>>")
)

# Spans are chosen turn by turn; a conversation of this table lies in one bucket as long as no turn
# number reaches BUCKET_TURNS, which the first condition of ``begins`` restates.
CHAT_WINDOWS = f"""
WITH RECURSIVE given AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
        turn // 128 AS bucket,
        len(regexp_extract_all(text, '{_WORD}')) + 2 AS cost,
        CASE role WHEN 'system' THEN 8 WHEN 'user' THEN 7 WHEN 'assistant' THEN 8
            ELSE 17 + length(regexp_replace(role, '(\\\\*)({_CONTROLS})', '\\\\\\1\\2', 'g')) END
            + length(regexp_replace(text, '(\\\\*)({_CONTROLS})', '\\\\\\1\\2', 'g')) + 5 AS chars
    FROM given
),
systems AS (
    SELECT conv_id, cost AS s_cost, chars AS s_chars FROM placed WHERE i = 1 AND role = 'system'
),
rooms AS (
    SELECT p.*, greatest(1024 - 256 - coalesce(s_cost, 0), 256) AS room, coalesce(s_chars, 0) AS s_chars,
        s_chars IS NOT NULL AS led,
        sum(cost) OVER (PARTITION BY p.conv_id ORDER BY i) - cost AS before
    FROM placed p LEFT JOIN systems s ON p.conv_id = s.conv_id
),
begins AS (
    SELECT conv_id, i, bucket, cost::BIGINT AS used, true AS opens FROM rooms WHERE i = 1
    UNION ALL
    SELECT r.conv_id, r.i, r.bucket,
        CASE WHEN r.bucket <> b.bucket OR b.used + r.cost > r.room THEN r.cost ELSE b.used + r.cost END::BIGINT,
        r.bucket <> b.bucket OR b.used + r.cost > r.room
    FROM begins b JOIN rooms r ON r.conv_id = b.conv_id AND r.i = b.i + 1
),
priors AS (
    SELECT conv_id, bucket, lag(bucket) OVER (PARTITION BY conv_id ORDER BY bucket) AS prior
    FROM (SELECT DISTINCT conv_id, bucket FROM rooms)
),
repeated AS (
    SELECT o.conv_id, sum(CASE WHEN o.i > 1 THEN o.s_chars ELSE 0 END) + sum((
        SELECT coalesce(sum(h.chars), 0) FROM rooms h
        WHERE h.conv_id = o.conv_id AND h.i < o.i AND o.before - h.before <= 256
            AND NOT (h.i = 1 AND h.led) AND h.bucket IN (o.bucket, p.prior)
    )) AS chars
    FROM rooms o JOIN begins b ON b.conv_id = o.conv_id AND b.i = o.i AND b.opens
    JOIN priors p ON p.conv_id = o.conv_id AND p.bucket = o.bucket
    GROUP BY o.conv_id
),
told AS (
    SELECT conv_id, count(*) AS n_turns, sum(chars) AS chars,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS said,
        coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS targets
    FROM rooms GROUP BY conv_id
)
SELECT t.conv_id::BIGINT AS conv_id, n_turns::BIGINT AS n_turns, sha256(said) AS turns_sha256,
    length(targets)::BIGINT AS loss_chars, sha256(targets) AS loss_sha256,
    (t.chars + r.chars)::BIGINT AS formatted_chars
FROM told t JOIN repeated r ON t.conv_id = r.conv_id
"""

# Places of lines with words are paired with earlier places of the same line; pairs on one diagonal
# that follow each other are runs, and runs of 50 words or more go from their later place.
LINE_DEDUP = f"""
WITH lines AS (
    SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS s
    FROM documents WHERE text IS NOT NULL
),
worded AS (
    SELECT doc_id, line, s, len(regexp_extract_all(s, '{_WORD}')) AS n,
        row_number() OVER (PARTITION BY doc_id ORDER BY line) AS i,
        lead(line) OVER (PARTITION BY doc_id ORDER BY line) AS next_line
    FROM lines WHERE regexp_matches(s, '{_WORD}')
),
pairs AS (
    SELECT b.doc_id, b.line, b.next_line, b.n, b.i, a.doc_id AS other, b.i - a.i AS diagonal,
        b.i - row_number() OVER (PARTITION BY b.doc_id, a.doc_id, b.i - a.i ORDER BY b.i) AS island
    FROM worded a JOIN worded b ON a.s = b.s AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.i < b.i)
),
runs AS (
    SELECT *, sum(n) OVER (PARTITION BY doc_id, other, diagonal, island) AS total FROM pairs
),
gone AS (
    SELECT DISTINCT doc_id, unnest(range(line, coalesce(next_line, line + 1))) AS line FROM runs WHERE total >= 50
),
told AS (
    SELECT l.doc_id, count(*) AS n_lines, count(g.line) AS n_gone,
        coalesce(string_agg(s, chr(10) ORDER BY l.line) FILTER (g.line IS NULL), '') AS rest
    FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line = l.line GROUP BY l.doc_id
)
SELECT d.doc_id, t.rest AS text, coalesce(n_lines, 0)::INTEGER AS n_lines, coalesce(n_gone, 0)::INTEGER AS n_gone,
    coalesce(n_gone = 0 OR regexp_matches(rest, '{_WORD}'), true) AS kept
FROM documents d LEFT JOIN told t ON t.doc_id = d.doc_id
"""

_REACHED = """
reached AS (
    SELECT id, id AS root FROM nodes
    UNION
    SELECT r.id, CASE WHEN l.a = r.root THEN l.b ELSE l.a END FROM reached r JOIN links l ON l.a = r.root OR l.b = r.root
),
components AS (SELECT id, min(root) AS component_id FROM reached GROUP BY id)
"""

# Exact similarity of every two documents that share a shingle.
MINHASH_DEDUP = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w
    FROM documents
),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
    SELECT x.doc_id AS a, y.doc_id AS b
    FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id < y.doc_id
    JOIN sizes m ON m.doc_id = x.doc_id JOIN sizes n ON n.doc_id = y.doc_id
    GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 85 * (any_value(m.n) + any_value(n.n) - count(*))
),
nodes AS (SELECT doc_id AS id FROM documents),
{_REACHED}
SELECT c.id AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, c.id = component_id AS kept
FROM components c LEFT JOIN sizes s ON s.doc_id = c.id
"""

EMBEDDING_DEDUP = f"""
WITH RECURSIVE vectors AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM vectors x JOIN vectors y ON x.vec_id < y.vec_id AND len(x.v) = len(y.v)
    WHERE list_cosine_similarity(x.v, y.v) >= 0.9
),
nodes AS (SELECT vec_id AS id FROM embeddings),
{_REACHED}
SELECT c.id AS vec_id, (SELECT count(*) FROM links l WHERE l.a = c.id OR l.b = c.id) AS n_links,
    component_id, c.id = component_id AS kept
FROM components c
"""

ORACLES = {
    "op1_line_dedup": LINE_DEDUP,
    "op3_minhash_dedup": MINHASH_DEDUP,
    "op8_embedding_dedup": EMBEDDING_DEDUP,
    "op13_chat_windows": CHAT_WINDOWS,
}
