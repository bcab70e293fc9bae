"""Query and SQL of the WARC round trip."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import delete_path, shared_dir, stored, table
from newsloom.llm.warc import page_of, read_warc, resolve_revisits, write_warc


def op9_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", F.col("html").alias("payload"))
    path = shared_dir(spark)
    write_warc(pages, path)
    rows = stored(read_warc(spark, path).drop("payload"))
    delete_path(spark, path)
    page, refers = page_of(F.col("record_id")).alias("page_id"), page_of(F.col("refers_to")).alias("refers_to")
    return resolve_revisits(rows).select(page, "payload_bytes", "payload_digest", "record_type", refers)


SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN top IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN top IS DISTINCT FROM page_id THEN top END AS refers_to FROM q
"""

QUERIES = {"op9_warc_segments": op9_warc_segments}
SQLS = {"op9_warc_segments": SQL}
