import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same_rows(spark_df, duck_con, sql):
    """Asserts that both have the same columns and values, in any order."""

    def key(v):
        if v is None or v != v:
            return ""
        if isinstance(v, float):
            return repr(round(v, 6) + 0.0)
        if isinstance(v, bool):
            return str(int(v))
        return str(v).removesuffix(" 00:00:00")

    a = spark_df.toPandas()
    b = duck_con.execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    rows = lambda df: sorted(tuple(key(v if not hasattr(v, "item") else v.item()) for v in r) for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False))
    x, y = rows(a), rows(b)
    assert len(x) == len(y)
    norm = lambda r: tuple(v[:-2] if v.endswith(".0") else v for v in r)
    assert [r for r in map(norm, x)] == [r for r in map(norm, y)]
