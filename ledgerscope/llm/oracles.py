"""DuckDB SQL for the queries that SQL can express: plain all-pairs and all-prefixes forms of the contracts."""

from __future__ import annotations

_FINITE = "coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)"

#: Links of a table ``e (a, b)`` over nodes ``v (id)``: each node's least reachable id.
_REACH = """reach AS (
    SELECT id, id AS r FROM v
    UNION
    SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.r
), least AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)"""

OP6 = rf"""WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
    FROM documents
), sets AS (
    SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s
    FROM w
), flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
    SELECT x.doc_id AS a, y.doc_id AS b FROM flat x JOIN flat y ON x.shingle = y.shingle AND x.doc_id < y.doc_id
    GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
v AS (SELECT doc_id AS id FROM documents),
{_REACH}
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id FROM sets s JOIN least l ON l.id = s.doc_id"""

OP11 = f"""WITH RECURSIVE u AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND {_FINITE} AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), links AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y
    ON x.label = y.label AND x.vec_id < y.vec_id AND list_cosine_similarity(x.x, y.x) >= 0.98
), e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
v AS (SELECT vec_id AS id FROM embeddings),
{_REACH}
SELECT l.id AS vec_id, CAST((SELECT count(*) FROM e WHERE e.a = l.id) AS BIGINT) AS n_links, l.component_id, l.id = l.component_id AS kept
FROM least l"""

# The unsigned CRC-32 of a decimal number, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
    range(1, length(CAST(conv_id AS VARCHAR)) + 1),
    lambda k: list_prepend(CAST(ascii(substr(CAST(conv_id AS VARCHAR), CAST(k AS INTEGER), 1)) AS BIGINT), [-1, -1, -1, -1, -1, -1, -1, -1])))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"""

OP12 = f"""WITH o AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT conv_id, list(length(role) || ':' || role || text ORDER BY turn NULLS FIRST) AS es, list(length(text) ORDER BY turn NULLS FIRST) AS ns
    FROM o GROUP BY conv_id
), h AS (SELECT *, CAST({_CRC} % 6 AS BIGINT) AS h FROM own),
path AS (
    SELECT x.conv_id, list_concat(coalesce(b.es[1:x.h], []), x.es[x.h + 1:]) AS p, list_concat(coalesce(b.ns[1:x.h], []), x.ns[x.h + 1:]) AS ns
    FROM h x LEFT JOIN own b ON b.conv_id = x.conv_id - x.conv_id % 100
), member AS (
    SELECT conv_id, d, CASE WHEN d = 0 THEN [] ELSE p[1:d] END AS k, CASE WHEN d = 0 THEN 0 ELSE ns[d] END AS size, d = len(p) AS ends
    FROM (SELECT *, unnest(range(0, len(p) + 1)) AS d FROM path)
), node AS (
    SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, min(size) AS size,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
    FROM member GROUP BY d, k
), kids AS (SELECT d - 1 AS d, CASE WHEN d = 1 THEN [] ELSE k[1:d - 1] END AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY 1, 2),
full_node AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM node n LEFT JOIN kids c ON c.d = n.d AND c.k = n.k),
sub AS (
    SELECT a AS d, CASE WHEN a = 0 THEN [] ELSE k[1:a] END AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * size) AS saved
    FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM full_node) GROUP BY 1, 2
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(n.n_children AS BIGINT) AS n_children,
    CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_node n JOIN sub s ON s.d = n.d AND s.k = n.k
LEFT JOIN node p ON p.d = n.d - 1 AND p.k = CASE WHEN n.d <= 1 THEN [] ELSE n.k[1:n.d - 1] END"""

OP13 = f"""WITH r AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND {_FINITE}
), scores AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score
    FROM r a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
), pos AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
    n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM pos p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
QUALIFY rank <= 5"""

ORACLES = {
    "op6_ngram_jaccard_join": OP6,
    "op11_embedding_near_dedup": OP11,
    "op12_conversation_prefix_trie": OP12,
    "op13_hard_negative_mining": OP13,
}
