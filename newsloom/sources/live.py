"""A live feed as a Spark streaming source: a log of events in a shared folder, read from an offset and a bounded number at a time.

A publication is a folder of Parquet files below the log, one or more for each symbol, and counts once Spark has finished it. An offset is a file of the log and a row in it;
files are in the order of their paths, so later publications come later. The log is cut into numbered batches of ``maxEvents`` events at most, and a micro-batch takes
``maxBatches`` of them (one, if not told otherwise), so what a micro-batch costs besides its events can be shared by many. Each task reads rows of one symbol's file, which
holds a bounded number. Spark keeps the offsets in the checkpoint; a query without one starts at the ``earliest`` or the ``latest`` event.

Files are read with pyarrow, so the path is one that pyarrow's file systems know (local, hdfs, s3, gs).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from newsloom.functions.text import or_default
from newsloom.schemas import NEWS_EVENT
from newsloom.sources.feeds import event_filter
from newsloom.sources.tables import delete, folders

# Events of a batch, and events that the log keeps at least.
BATCH, RETAINED = 100, 100_000
#: Events of a file at most: what a task reads, and what it may have to pass over.
FILE = 50_000
EVENT = "payload STRING, symbol STRING, received_at TIMESTAMP"
_ARROW = pa.schema([("payload", pa.string()), ("symbol", pa.string()), ("received_at", pa.timestamp("us", tz="UTC")), ("batch", pa.int64())])


def events_of(payload: Column) -> Column:
    """The events of a frame, which is one event or a list of them, as an array of JSON texts."""
    return F.when(F.ltrim(payload).startswith("["), F.from_json(payload, "ARRAY<STRING>")).otherwise(F.array(payload))


def publish(frames: DataFrame, path: str, received_at: Column) -> None:
    """Appends the news events of frames (a ``payload`` each) to the log, as one publication. There is one publisher at a time."""
    events = frames.withColumn("received_at", received_at).select(F.explode(events_of(F.col("payload"))).alias("payload"), "received_at")
    events = events.withColumn("e", F.from_json("payload", NEWS_EVENT)).where(event_filter(F.col("payload"), F.col("e")))
    first = F.upper(or_default(F.get("e.symbols", F.lit(0)), "unknown"))
    spark = frames.sparkSession
    number = max([int(n.partition("=")[2]) for n in folders(spark, path) if n.startswith("publication=")], default=-1) + 1
    events.select("payload", "received_at", first.alias("symbol")).write.option("maxRecordsPerFile", FILE).partitionBy("symbol").parquet(f"{path}/publication={number:012d}")


def publications(spark: SparkSession, path: str) -> DataFrame:
    """Number of events of each publication."""
    return spark.read.schema(f"{EVENT}, publication STRING").parquet(path).groupBy("publication").agg(F.count(F.lit(1)).alias("n"))


def trim(spark: SparkSession, path: str, keep: int = RETAINED) -> int:
    """Deletes the oldest publications as long as ``keep`` events remain; how many. The newest one always stays.

    Events are counted by publication in one aggregation; what reaches the driver are the names of those to delete.
    """
    newer = F.sum("n").over(Window.orderBy(F.desc("publication")).rowsBetween(Window.unboundedPreceding, -1))  # a row for each publication
    old = publications(spark, path).withColumn("newer", newer).where(F.col("newer") >= keep).select("publication").collect()
    for row in old:
        delete(spark, f"{path}/publication={row['publication']}")
    return len(old)


@dataclass
class Rows(InputPartition):
    """Rows of one file; ``before``: rows of the micro-batch that come before them. ``batch``: the number of its first batch."""

    file: str
    start: int
    end: int
    before: int = 0
    batch: int = 0
    most: int = BATCH


class EventReader(DataSourceStreamReader):
    """Plans batches on the driver from names and footers of files; tasks read the rows."""

    def __init__(self, path: str, most: int, latest: bool, batches: int = 1):
        self.uri, self.most, self.latest, self.batches = path, most, latest, batches
        self._at: dict | None = None
        self._rows: dict[str, int] = {}

    def _system(self) -> tuple[pafs.FileSystem, str]:
        if "://" not in self.uri:
            self.uri = self.uri.removeprefix("file:")
        return pafs.FileSystem.from_uri(self.uri)

    def _files(self, since: str) -> Iterator[str]:
        """The files of finished publications, from that of the file ``since`` on, in order; paths are relative to the log. Publications are listed as they are asked for."""
        system, base = self._system()
        first = since.partition("/")[0]
        tops = system.get_file_info(pafs.FileSelector(base, allow_not_found=True))
        for top in sorted(t.base_name for t in tops if t.type == pafs.FileType.Directory and t.base_name.startswith("publication=")):
            if top >= first:
                inside = [f.path for f in system.get_file_info(pafs.FileSelector(f"{base}/{top}", recursive=True)) if f.is_file]
                if any(f.endswith("/_SUCCESS") for f in inside):
                    yield from sorted(f.removeprefix(f"{base}/") for f in inside if f.endswith(".parquet"))

    def _size(self, file: str) -> int:
        if file not in self._rows:
            system, base = self._system()
            with system.open_input_file(f"{base}/{file}") as f:
                self._rows[file] = pq.ParquetFile(f).metadata.num_rows
        return self._rows[file]

    def _after(self, at: dict, most: int | None, upto: dict | None = None) -> list[Rows]:
        """The rows after an offset, ``most`` at most (None: all), and none after the offset ``upto``."""
        out, n = [], 0
        for file in self._files(at["file"]):
            if n == most or (upto and file > upto["file"]):
                break
            if file < at["file"]:
                continue
            start = at["row"] if file == at["file"] else 0
            end = upto["row"] if upto and file == upto["file"] else self._size(file)
            end = end if most is None else min(end, start + most - n)
            if end > start:
                out.append(Rows(file, start, end, n))
                n += end - start
        return out

    def initialOffset(self) -> dict:
        self._at = {"file": "", "row": 0, "batch": 0}
        if self.latest and (rows := self._after(self._at, None)):
            self._at |= {"file": rows[-1].file, "row": rows[-1].end}
        return self._at

    def latestOffset(self) -> dict:
        at = self._at or self.initialOffset()
        rows = self._after(at, self.most * self.batches)
        if not rows:
            return at
        n = rows[-1].before + rows[-1].end - rows[-1].start
        return {"file": rows[-1].file, "row": rows[-1].end, "batch": at.get("batch", 0) + -(-n // self.most), "most": self.most}

    def partitions(self, start: dict, end: dict) -> list[Rows]:
        self._at = end  # after a restart, Spark asks for nothing from the last offset on
        rows = self._after(start, None, end) if (start["file"], start["row"]) < (end["file"], end["row"]) else []
        return [replace(r, batch=start.get("batch", 0), most=end.get("most", self.most)) for r in rows]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        system, base = self._system()
        symbol, at = unquote(partition.file.split("symbol=", 1)[1].partition("/")[0]), 0
        with system.open_input_file(f"{base}/{partition.file}") as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=["payload", "received_at"]):
                rows = batch.slice(max(partition.start - at, 0), max(partition.end - max(partition.start, at), 0))
                if rows.num_rows:
                    when = rows.column("received_at")
                    when = when.cast(pa.timestamp("us")).cast(_ARROW.field("received_at").type) if when.type.tz is None else when.cast(_ARROW.field("received_at").type)
                    place = partition.before + max(at - partition.start, 0) + np.arange(rows.num_rows)  # in the micro-batch
                    yield pa.RecordBatch.from_arrays([rows.column("payload"), pa.array([symbol] * rows.num_rows), when, pa.array(partition.batch + place // partition.most)], schema=_ARROW)
                at += batch.num_rows
                if at >= partition.end:
                    break

    def commit(self, end: dict) -> None:
        """Files before the offset's are not looked at again."""
        self._rows = {f: n for f, n in self._rows.items() if f >= end["file"]}


class EventSource(DataSource):
    """Format ``newsloom_events``; options ``path``, ``maxEvents`` (100) of a batch, ``maxBatches`` (1) of a micro-batch, and ``startingOffset`` (``latest`` or ``earliest``)."""

    @classmethod
    def name(cls) -> str:
        return "newsloom_events"

    def schema(self) -> str:
        return f"{EVENT}, batch LONG"

    def streamReader(self, schema) -> EventReader:
        start = self.options.get("startingOffset", "latest")
        if start not in ("latest", "earliest"):
            raise ValueError("startingOffset is latest or earliest")
        return EventReader(self.options["path"], int(self.options.get("maxEvents", BATCH)), start == "latest", int(self.options.get("maxBatches", 1)))


def read_live(spark: SparkSession, path: str, start: str = "latest", most: int = BATCH, batches: int = 1) -> DataFrame:
    """The log as a stream of :data:`EVENT` and the number of its ``batch``: ``most`` events a batch at most, and so many batches a micro-batch."""
    spark.dataSource.register(EventSource)
    return spark.readStream.format("newsloom_events").option("path", path).option("startingOffset", start).option("maxEvents", most).option("maxBatches", batches).load()
