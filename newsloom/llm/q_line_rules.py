"""Query and SQL of the quality rules."""

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm.common import table
from newsloom.llm.line_rules import quality_rules


def op4_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).drop("text", "clean_text")


_W = r"[^\x20\x09-\x0D]+"
SQL = rf"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '{_W}') AS ws FROM documents),
pos AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
tri AS (SELECT doc_id, i, w AS a, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c FROM pos WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) > 1 AS again FROM tri WHERE c IS NOT NULL),
marks AS (SELECT pos.doc_id, pos.i, coalesce(bool_or(t.again), false) AS again FROM pos LEFT JOIN twice t ON t.doc_id = pos.doc_id AND t.i BETWEEN pos.i - 2 AND pos.i GROUP BY ALL),
rep AS (SELECT doc_id, count(*) FILTER (again) AS n_repeat_words FROM marks GROUP BY ALL),
l0 AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d WHERE text IS NOT NULL),
l1 AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l0),
l2 AS (SELECT *, len(regexp_extract_all(line, '{_W}')) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS dup,
  len(regexp_extract_all(line, '[#*$%&|<>]')) AS sym, len(regexp_extract_all(line, '!!')) AS bangs,
  len(list_filter(regexp_extract_all(line, '{_W}'), lambda w: w IN ('|', '/', '>', '<', '-', '*', '•', '·', '»', '›'))) AS alone FROM l1),
l3 AS (SELECT *, NOT regexp_matches(line, '[\p{{L}}\p{{N}}]') OR 4 * sym > n OR 4 * bangs >= n OR (n < 8 AND NOT regexp_matches(line, '[.!?;:…。！？]'))
  OR (alone >= 3 AND 4 * alone >= n)
  OR regexp_matches(lower(line), 'all rights reserved|accept cookies|cookie policy|privacy policy|terms of use|terms of service|click here|enable javascript|sign up for our newsletter|subscribe to our newsletter|licensed under|lorem ipsum') AS fails FROM l2 WHERE n > 0),
ln AS (SELECT doc_id, count(*) FILTER (dup) AS n_dup_lines, count(*) FILTER (fails) AS n_lines_removed, CAST(coalesce(sum(n) FILTER (fails), 0) AS BIGINT) AS n_words_removed FROM l3 GROUP BY ALL),
base AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines_removed, 0) AS n_lines_removed, coalesce(n_words_removed, 0) AS n_words_removed
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - n_words_removed) >= 50 * n_words AS kept, n_lines_removed, n_words_removed FROM base
"""  # noqa: RUF001

QUERIES = {"op4_line_rules": op4_line_rules}
SQLS = {"op4_line_rules": SQL}
