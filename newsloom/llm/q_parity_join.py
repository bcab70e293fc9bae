"""Query and SQL of the n-gram Jaccard join."""

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm.common import scratch, stored, table
from newsloom.llm.parity_join import shingle_components


def op13_parity_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):
        return stored(shingle_components(table(spark, sf_dir, "documents")), keep=True)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
runs AS (SELECT doc_id, array_to_string(ws[i : i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(s) AS s FROM runs),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY ALL) USING (doc_id)
"""

QUERIES = {"op13_parity_sketch": op13_parity_sketch}
SQLS = {"op13_parity_sketch": SQL}
