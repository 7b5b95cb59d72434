"""Query of the conversation prefix trie and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditlake.llm import prefix_trie
from auditlake.llm.registry import query, table

_SQL = """
WITH turns AS (
  SELECT conv_id, turn, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS t FROM conversations WHERE conv_id IS NOT NULL
),
own AS (SELECT conv_id, list(t ORDER BY turn NULLS FIRST, t) AS l FROM turns GROUP BY conv_id),
bits AS (
  SELECT conv_id, list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR x IN regexp_extract_all(conv_id::VARCHAR, '.')])),
    lambda crc, x: CASE WHEN xor(crc, x) & 1 = 1 THEN xor(xor(crc, x) >> 1, 3988292384) ELSE xor(crc, x) >> 1 END) AS crc
  FROM own
),
heads AS (SELECT conv_id, xor(crc, 4294967295) % 9 AS h FROM bits),
rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.l, [])[1:h], o.l[h + 1:len(o.l)]) AS l
  FROM own o JOIN heads USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5
),
prefixes AS (SELECT conv_id, len(l) AS n, d, l[1:d] AS k FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE strlen(k[d].text) END AS bytes,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '') AS ends
  FROM prefixes GROUP BY d, k
),
inner_nodes AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
kinds AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN inner_nodes USING (d, k)),
sums AS (
  SELECT up AS d, k[1:up] AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM kinds) GROUP BY up, k[1:up]
)
SELECT c.conv_id, c.d AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(c.ends) AS ends_sha256
FROM kinds c JOIN sums s ON s.d = c.d AND s.k = c.k LEFT JOIN nodes p ON p.d = c.d - 1 AND p.k = c.k[1:c.d - 1]
"""


@query("op13_prefix_trie", _SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turns_of(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.rebuilt(turns)).drop("p", "q")
