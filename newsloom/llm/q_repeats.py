"""Queries of both kinds of substring removal."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import table
from newsloom.llm.substring import remove_repeats
from newsloom.llm.suffix import remove_repeated_bytes


def op2_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))


def op10_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


_W = r"[^\x20\x09-\x0D]+"
SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_W}') AS ws FROM documents),
windows AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 33, 1))) AS i, ws FROM d),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY array_to_string(ws[i : i + 34], ' ')) > 1 AS again FROM windows),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
marked AS (SELECT doc_id, i, w, coalesce(bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), false) AS gone FROM words LEFT JOIN again USING (doc_id, i)),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS k FROM marked GROUP BY ALL)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

QUERIES = {"op2_suffix_trees": op2_suffix_trees, "op10_suffix_sort": op10_suffix_sort}
SQLS = {"op2_suffix_trees": SQL}  # every byte's 200-byte string takes SQL minutes; tests compare op10 with plain Python
