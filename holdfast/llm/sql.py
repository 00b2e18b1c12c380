"""DuckDB oracles of the training-data queries that SQL can express."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NORMAL = r"regexp_replace(coalesce(text, ''), '[ \x09-\x0D]', '', 'g')"

ORACLES = {
    "op3_exact_dedup": f"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, {_NORMAL} AS norm FROM documents
), r AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
""",
    "op9_near_dedup": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
                                                   '[ \x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS shingles
  FROM d
), e AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM e x JOIN e y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
  WHERE 100 * common >= 80 * (len(x.shingles) + len(y.shingles) - common)
), links AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reached(doc_id, root) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT b, root FROM reached JOIN links ON a = doc_id
)
SELECT doc_id, CAST(len(any_value(shingles)) AS BIGINT) AS n_shingles, min(root) AS component_id,
       doc_id = min(root) AS kept
FROM s JOIN reached USING (doc_id) GROUP BY doc_id
""",
    "op12_prefix_trie": r"""
WITH o AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '')) || ':'
           || length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS turn
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, list(turn ORDER BY place) AS turns,
         CAST(xor(4294967295, list_reduce(
           [4294967295::UBIGINT] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT),
           lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0],
                                    lambda b, y: xor(b >> 1, 3988292384::UBIGINT * (b & 1))))) % 4 AS BIGINT) AS h
  FROM o GROUP BY conv_id
), r AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns
  FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 20
), p AS (
  SELECT conv_id, len(turns) AS n, unnest(range(0, len(turns) + 1)) AS depth, turns FROM r
), n AS (
  SELECT turns[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) = depth AS leaf,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '') AS ends
  FROM p GROUP BY 1, 2
), s AS (
  SELECT path[1:d] AS path, sum(CAST(leaf AS BIGINT)) AS n_leaves, sum(saved) AS saved_tokens,
         count(*) FILTER (WHERE depth = d + 1) AS n_children
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d,
               CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * CAST(split_part(path[depth], ':', 1) AS BIGINT) END AS saved
        FROM n)
  GROUP BY path[1:d]
)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, s.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN s ON s.path = n.path LEFT JOIN n u ON u.depth = n.depth - 1 AND u.path = n.path[1:n.depth - 1]
""",
}
