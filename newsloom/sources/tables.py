"""Stored tables: a folder of Parquet versions each, and a pointer-free rule that the highest complete version counts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from newsloom.schemas import TABLES


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it doesn't exist."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def _versions(spark: SparkSession, path: str) -> list[int]:
    names = [n for n in folders(spark, path) if n.startswith("v") and n[1:].isdigit()]
    return sorted(int(n[1:]) for n in names if (at := _at(spark, f"{path}/{n}/_SUCCESS"))[0].exists(at[1]))


def create_all(spark: SparkSession, root: str) -> None:
    """Empty tables where there are none yet."""
    for name, schema in TABLES.items():
        if not _versions(spark, f"{root}/{name}"):
            spark.createDataFrame([], schema).write.parquet(f"{root}/{name}/v0")


def migrate(spark: SparkSession, root: str) -> dict[str, str]:
    """Brings all tables to the schemas of now; what was done to each: ``created``, ``current``, ``added`` columns (which are null in old rows), or ``rewritten`` for a changed type.

    Columns are added without touching old files. A changed type makes a new version, in which the values are cast.
    """
    done = {}
    for name, ddl in TABLES.items():
        versions = _versions(spark, f"{root}/{name}")
        if not versions:
            done[name] = "created"
            spark.createDataFrame([], ddl).write.parquet(f"{root}/{name}/v0")
            continue
        old = spark.read.parquet(f"{root}/{name}/v{versions[-1]}")
        have, want = dict(old.dtypes), dict(spark.createDataFrame([], ddl).dtypes)
        if any(c in have and have[c] != kind for c, kind in want.items()):
            done[name] = "rewritten"
            replace(old, root, name)
        else:
            missing = [c for c in want if c not in have]
            done[name] = "added " + ", ".join(missing) if missing else "current"
    return done


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The newest version; columns that came into the schema later are null in old files."""
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}/v{_versions(spark, f'{root}/{name}')[-1]}")


def replace(df: DataFrame, root: str, name: str) -> None:
    """A new version with these rows; readers of the old one are not disturbed."""
    known = _versions(df.sparkSession, f"{root}/{name}")
    _conformed(df, name).write.parquet(f"{root}/{name}/v{(known[-1] if known else -1) + 1}")


def append(df: DataFrame, root: str, name: str) -> None:
    _conformed(df, name).write.mode("append").parquet(f"{root}/{name}/v{_versions(df.sparkSession, f'{root}/{name}')[-1]}")


def _conformed(df: DataFrame, name: str) -> DataFrame:
    fields = df.sparkSession.createDataFrame([], TABLES[name]).schema.fields
    have = {c.lower() for c in df.columns}
    return df.select(*[(F.col(f.name) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


# --- tables by month: a merge rewrites only the months that it touches ---------------------------------------------------
def by_month(spark: SparkSession, path: str, schema: str, months: list[str] | None = None) -> DataFrame:
    """A table that :func:`merge_months` writes, or some months of it, which are all that is read."""
    x = spark.read.schema(f"{schema}, month STRING").parquet(path) if any(n.startswith("month=") for n in folders(spark, path)) else spark.createDataFrame([], f"{schema}, month STRING")
    return (x if months is None else x.where(F.col("month").isin(months))).drop("month")


def _put_months(spark: SparkSession, staged: str, path: str, schema: str) -> None:
    """The staged months in place of those of the table; may be repeated."""
    rows = spark.read.schema(f"{schema}, month STRING").parquet(staged)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    delete(spark, staged)


def finish_merge(spark: SparkSession, path: str, schema: str) -> None:
    """Ends a merge that was cut short: what was staged whole is put in place, anything else goes."""
    for name in [n for n in folders(spark, path) if n.startswith("_staged-")]:
        fs, done = _at(spark, f"{path}/{name}/_SUCCESS")
        if fs.exists(done):
            _put_months(spark, f"{path}/{name}", path, schema)
        else:
            delete(spark, f"{path}/{name}")


def merge_months(fresh: DataFrame, path: str, schema: str, date: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> dict[str, int]:
    """Merges rows into a table that is kept by month of ``date``; how many were inserted and updated.

    ``merge(stored, fresh)`` gives the new rows with the flags ``inserted`` and ``updated``. Only months that ``fresh`` has are read and rewritten, files of others stay.
    The new months are staged whole before the table changes, so a merge that is cut short loses nothing (:func:`finish_merge`). Rows without a date are not taken.
    The counts come from the pass that writes.
    """
    spark = fresh.sparkSession
    finish_merge(spark, path, schema)
    month = F.date_format(date, "yyyy-MM")
    fresh = fresh.where(F.col(date).isNotNull())
    months = [r["month"] for r in fresh.select(month.alias("month")).distinct().collect()]  # months, not rows
    if not months:
        return {"inserted": 0, "updated": 0}
    seen, staged = Observation(), f"{path}/_staged-{uuid.uuid4().hex}"
    merged = merge(by_month(spark, path, schema, months), fresh)
    merged = merged.observe(seen, F.count_if("inserted").alias("inserted"), F.count_if("updated").alias("updated"))
    fields = [F.col(f.name).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], schema).schema.fields if f.name in merged.columns]
    merged.select(*fields, month.alias("month")).write.partitionBy("month").parquet(staged)
    _put_months(spark, staged, path, schema)
    return seen.get


def to_json_rows(df: DataFrame) -> DataFrame:
    """Each row as a JSON object."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def work_dir(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``; a temporary one if that is unset and Spark runs on this machine alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="newsloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/work-{uuid.uuid4().hex}"
