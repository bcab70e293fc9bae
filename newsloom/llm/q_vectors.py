"""Queries and SQL of vector codes and clusters."""

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm.common import scratch, stored, table
from newsloom.llm.dual_tree import cluster_vectors
from newsloom.llm.vector_codes import encode


def op11_partial_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):
        return stored(encode(table(spark, sf_dir, "embeddings")), keep=True)


def op12_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):
        return stored(cluster_vectors(table(spark, sf_dir, "embeddings")), keep=True)


_KEPT = "v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _lloyd(rounds: int) -> str:
    """Tables b1.. and a0..: books after each round and assignments to them, from x (r, p, x: vectors by part) and b0 (p, j, c: entries)."""
    far = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    assigned = "a{k} AS MATERIALIZED (SELECT r, x.p, min([CAST(" + far + " AS BIGINT), j]) AS best FROM x JOIN b{k} b ON b.p = x.p GROUP BY ALL)"
    moved = (
        "m{k} AS (SELECT p, j, list(q ORDER BY i) AS c FROM (SELECT p, j, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS q FROM (SELECT p, j, i, sum(y) AS s, count(*) AS n FROM "
        "(SELECT x.p, a.best[2] AS j, unnest(x.x) AS y, generate_subscripts(x.x, 1) AS i FROM x JOIN a{k} a ON a.r = x.r AND a.p = x.p) GROUP BY ALL)) GROUP BY ALL),\n"
        "b{n} AS MATERIALIZED (SELECT b.p, b.j, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m ON m.p = b.p AND m.j = b.j)"
    )
    steps = [part.format(k=k, n=k + 1) for k in range(rounds) for part in (assigned, moved)]
    return ",\n".join([*steps, assigned.format(k=rounds)])


CODES = f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, v FROM (SELECT vec_id, label, embedding AS v FROM embeddings) WHERE {_KEPT}),
x AS MATERIALIZED (SELECT r, p, list_transform(v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)], lambda y: CAST(floor(1024 * CAST(y AS DOUBLE)) AS BIGINT)) AS x FROM e, (SELECT unnest(range(4)) AS p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS j, x AS c FROM x WHERE r <= 256),
{_lloyd(4)},
coded AS (SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a4 GROUP BY ALL),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM b4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN e USING (r), digest
"""

CLUSTERS = f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) AS r, vec_id, v FROM (SELECT vec_id, embedding AS v FROM embeddings) WHERE len(v) = 64 AND {_KEPT}),
x AS MATERIALIZED (SELECT r, 0 AS p, list_transform(v, lambda y: CAST(floor(256 * CAST(y AS DOUBLE)) AS BIGINT)) AS x FROM e),
b0 AS MATERIALIZED (SELECT p, r - 1 AS j, x AS c FROM x WHERE r <= 40),
{_lloyd(5)}
SELECT vec_id, CAST(best[2] AS INTEGER) AS cluster, best[1] AS distance, CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia, CAST(sum(best[1]) OVER () AS BIGINT) AS inertia,
sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a5 JOIN e USING (r) JOIN b5 ON b5.j = best[2]
"""

QUERIES = {"op11_partial_distance": op11_partial_distance, "op12_dual_tree": op12_dual_tree}
SQLS = {"op11_partial_distance": CODES, "op12_dual_tree": CLUSTERS}
