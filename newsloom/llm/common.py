"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: At most so many keys are treated as hot, and only those with so many rows.
HOT_KEYS, HOT_ROWS = 500, 1000
#: Into so many parts a hot key is split.
SALTS = 32


#: Rows and bytes of an Arrow batch, unless the cluster sets them: texts are long, and buffers of batches count many times over.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


_created: list[str] = []
_kept: set[str] = set()


def reach_workers(spark: SparkSession) -> None:
    """Lets Python workers started on this machine import the package, and keeps batches small.

    On a cluster the package comes with ``--py-files`` or is installed there.
    """
    for name, value in BATCHES.items():
        if not spark.sparkContext.getConf().contains(name):
            spark.conf.set(name, value)
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def quoted(column: str) -> str:
    """The name so that dots and backticks in it are part of it."""
    return "`" + column.replace("`", "``") + "`"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path in ``spark.checkpoint.dir``, which all executors share.

    Where that is unset, as in tests on one machine, a temporary folder serves instead.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="newsloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    _created.append(path := f"{base.rstrip('/')}/newsloom-{uuid.uuid4().hex}")
    return path


def stored(df: DataFrame, keep: bool = False) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: its lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    if keep:
        _kept.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def stored_parts(parts: Iterable[DataFrame]) -> DataFrame:
    """The union of ``parts``, each computed and appended to one table in the shared folder before the next."""
    path = None
    for df in parts:
        path = path or shared_dir(df.sparkSession)
        df.write.mode("append").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query within it go when the query ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all that was written to the shared folder within it, but for what is kept.

    If nothing that is kept was written within it, results are still to be computed, and nothing is deleted.
    """
    before = len(_created)
    yield
    if _kept.intersection(_created[before:]):
        for path in [p for p in _created[before:] if p not in _kept]:
            _created.remove(path)
            delete_path(spark, path)


def drop_stored(df: DataFrame) -> None:
    """Deletes what :func:`stored` wrote, once nothing reads it any more."""
    delete_path(df.sparkSession, df.stored_path)


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_all_stored(spark: SparkSession) -> None:
    """Deletes all that this process has written to the shared folder. Results that haven't been written or collected yet are lost."""
    while _created:
        delete_path(spark, _created.pop())


def batch_map(df: DataFrame, columns: Sequence[str | Column], fn: Callable[[pa.RecordBatch], Iterable[dict] | dict], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` over the named columns; ``fn`` turns a batch into a dict of columns, or several."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    names = schema.names
    taken = df.select(*columns)
    given = taken.columns
    plain = taken.toDF(*[f"c{k}" for k in range(len(given))])  # mapInArrow can't take names with dots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            found = fn(batch.rename_columns(given))
            for out in [found] if isinstance(found, dict) else found:
                yield pa.RecordBatch.from_arrays([_arrow(out[n], arrow.field(n).type) for n in names], schema=arrow)

    return plain.mapInArrow(run, schema)


def packed_texts(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """id and the text compressed, so that less is shuffled."""

    def run(batch: pa.RecordBatch) -> dict:
        pack = zstandard.ZstdCompressor(level=1)
        return {"id": batch.column("id"), "packed": [pack.compress(t.encode()) for t in batch.column("text").to_pylist()]}

    return batch_map(docs.where(F.col(quoted(text)).isNotNull()), [F.col(quoted(id_column)).cast("long").alias("id"), F.col(quoted(text)).alias("text")], run, "id long, packed binary")


def _arrow(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on unsigned 64-bit integers whose output bits all depend on all input bits (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def salt_of(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def join_by_hot_key(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], how: str = "inner", sizes: DataFrame | None = None) -> DataFrame:
    """``left.join(right, keys, how)`` for a ``left`` where a key may hold a large share of the rows; ``right`` has each key once.

    The :data:`HOT_KEYS` keys with most rows, if they have :data:`HOT_ROWS` or more, are hot: any key with a share above
    ``1 / HOT_KEYS`` is among them, and the list that is broadcast has no more. Their rows are dealt to :data:`SALTS`
    parts by the columns ``spread``, and the matching rows of ``right`` are repeated for each part.
    ``sizes``: the keys with ``size``, the number of their rows in ``left``, where that is known; keys of a row may be missing.
    """
    if sizes is None:
        sizes = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    hot = sizes.where(F.col("size") >= HOT_ROWS)
    found = [r[:-1] for r in hot.select(*keys, "size").orderBy(F.desc("size")).limit(HOT_KEYS).collect()]
    if not found:
        return left.join(right, keys, how)
    hot = hot.select(*keys)
    hot = F.broadcast(left.sparkSession.createDataFrame(found, hot.schema).withColumn("_hot", F.lit(True)))
    salted = left.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), salt_of(*spread)).otherwise(0)).drop("_hot")
    spreads = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    repeated = right.join(hot, keys, "left").withColumn("_salt", F.explode(spreads)).drop("_hot")
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
