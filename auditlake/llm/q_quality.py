"""Query of the quality rules and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditlake.llm import quality_rules
from auditlake.llm.registry import query, table

_STOPS = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l
  FROM docs
),
named AS (
  SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(w[1:len(w) - 2]) AS a, unnest(w[2:len(w) - 1]) AS b, unnest(w[3:len(w)]) AS c
  FROM split WHERE len(w) >= 3
),
twice AS (SELECT r, unnest(ps) AS i FROM (SELECT r, list(i) AS ps FROM named GROUP BY r, a, b, c HAVING count(*) > 1)),
covered AS (SELECT r, count(DISTINCT i + d) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS d) GROUP BY r),
measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
         len([x FOR x IN w IF lower(x) IN ({_STOPS})])::BIGINT AS n_stop_words
  FROM split LEFT JOIN covered USING (r)
),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * word_chars BETWEEN 200 * n_words AND 1200 * n_words AND 100 * n_symbols <= 20 * n_words
       AND 100 * n_stop_words >= 2 * n_words AND 100 * n_dup_lines <= 60 * n_lines AS kept
FROM based
"""


@query("op8_quality_rules", _SQL)
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_rules.judged(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
