"""Query of line dedup and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from auditlake.llm import line_dedup
from auditlake.llm.registry import query, table

_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT r, doc_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS line FROM docs),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
),
owners AS (SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 AND doc_id IS NOT NULL GROUP BY k),
judged AS (SELECT r, doc_id, pos, line, coalesce(doc_id > owner, false) AS gone FROM keyed LEFT JOIN owners USING (k))
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r
"""


@query("op11_line_dedup", _SQL)
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
