"""WARC files: writing with continuation records, reading with segment reassembly.

Writing: every payload becomes an HTTP response whose body has chunked transfer framing. A response block longer than
``segment_chars`` is cut at character borders into segments: a ``response`` record (segment 1) and ``continuation`` records that
name the first by ``WARC-Segment-Origin-ID``; the last gives ``WARC-Segment-Total-Length``. Spark's text writer writes the records, compressed by gzip:
each file has at most ``records_per_file`` of them and so is of bounded size. Of equal payloads of at least ``revisit_bytes``, that with
the largest id is written whole; the others are ``revisit`` records that refer to it.

Reading: files are parsed by ``Content-Length``, and records with a segment number are grouped by their origin, ordered by number
and joined; numbers must be gapless from 1 and the total length must be right, else the reader fails. Then the chunked framing
is decoded, and length and SHA-1 are taken from the payload that was decoded; for a revisit they are taken from what it refers to.

* A null payload is written as an empty one.
* Repeated and null ids: each row has a record id of its own (:func:`numbered`), so each makes one response or revisit. Rows with
  the largest id of equal payloads are all written whole; null ids count as less than all others.
* Very long payloads become many segments, in any number of files. An empty table gives no records and an empty table.
* Only the columns ``id``, ``url`` and ``payload`` are read; others don't matter.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import batch_map, drop_stored, join_by_hot_key, stored

#: Payloads at least this long (in bytes) are written once.
REVISIT_BYTES = 1000
SEGMENT_CHARS = 16_384
CHUNK_CHARS = 4_096
RECORDS_PER_FILE = 1_000
END = "\r\n\r\n"
HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def record_id(page_id: Column, row: Column | None = None) -> Column:
    """A URN made from the id, empty if null, and from the row's number where ids don't tell rows apart."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), *([F.lit(":row:"), row.cast("string")] if row is not None else []), F.lit(">"))


def page_of(record: Column) -> Column:
    """The id that :func:`record_id` was made from, as a number."""
    return F.regexp_extract(record, "^<urn:page:(.*?)(:row:[0-9]+)?>$", 1).try_cast("long")


def _frame(text: str) -> str:
    """``text`` with chunked transfer framing."""
    parts = [text[i : i + CHUNK_CHARS] for i in range(0, len(text), CHUNK_CHARS)]
    return "".join(f"{len(p.encode()):x}\r\n{p}\r\n" for p in parts) + "0\r\n\r\n"


def unframe(raw: bytes) -> bytes:
    """The body that chunked transfer framing holds."""
    out, at = [], 0
    while True:
        end = raw.index(b"\r\n", at)
        size = int(raw[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(raw[end + 2 : end + 2 + size])
        if len(out[-1]) != size or raw[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("chunked framing is broken")
        at = end + 4 + size


def _header(kind: str, rid: str, url: str, digest: str, length: int, **more: str) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {' '.join(url.split())}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}"] if digest else []
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in more.items()]
    return "\r\n".join([*lines, f"Content-Type: {'application/http; msgtype=response' if kind != 'continuation' else 'application/octet-stream'}", f"Content-Length: {length}"]) + END


def numbered(pages: DataFrame) -> DataFrame:
    """id, url, payload and ``rid``, a record id for each row.

    If any id is null or repeated, rows are numbered. Numbers are given once and so are stored, since rows are read twice.
    """
    full = pages.select("id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("payload", F.lit("")).alias("payload"))
    if pages.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("id IS NULL OR n > 1").isEmpty():
        return full.withColumn("rid", record_id(F.col("id")))
    return stored(full.withColumn("rid", record_id(F.col("id"), F.monotonically_increasing_id())))


def plan_records(rows: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``rows`` with ``digest``, and ``refers``: a record that has an equal payload and the largest id, where that isn't the row's own id, else null."""
    full = rows.withColumn("digest", F.sha1(F.encode("payload", "utf-8"))).withColumn("n", F.octet_length("payload"))
    slim = full.where(F.col("n") >= revisit_bytes).select("digest", "n", "id", "rid")
    first = slim.groupBy("digest", "n").agg(F.max(F.struct("id", "rid")).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    revisits = join_by_hot_key(slim, first, ["digest", "n"], ["rid"]).where("NOT id <=> first.id").select("rid", F.col("first.rid").alias("refers"))
    return full.join(revisits, "rid", "left")


def write_warc(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES, segment_chars: int = SEGMENT_CHARS, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes ``id, url, payload`` rows to WARC files in the folder ``path``."""

    def records(batch: pa.RecordBatch) -> Iterator[dict]:
        for rid, url, payload, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("rid", "url", "payload", "digest", "refers")), strict=True):
            if refers:
                head = HEAD.replace("Transfer-Encoding: chunked\r\n", "")
                yield {"value": [_header("revisit", rid, url, digest, len(head), WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", WARC_Refers_To=refers) + head]}
                continue
            block = HEAD + _frame(payload)
            parts = [block[i : i + segment_chars] for i in range(0, len(block), segment_chars)]
            total = len(block.encode())
            for k, part in enumerate(parts, 1):
                more = {"WARC_Segment_Number": str(k)} if len(parts) > 1 else {}
                more |= {"WARC_Segment_Origin_ID": rid} if k > 1 else {}
                more |= {"WARC_Segment_Total_Length": str(total)} if k == len(parts) > 1 else {}
                yield {"value": [_header("response" if k == 1 else "continuation", rid if k == 1 else f"{rid[:-1]}:{k}>", url, digest if k == 1 else "", len(part.encode()), **more) + part]}

    rows = numbered(pages)
    lines = batch_map(plan_records(rows, revisit_bytes), ["rid", "url", "payload", "digest", "refers"], records, "value string")
    lines.write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path)
    if hasattr(rows, "stored_path"):
        drop_stored(rows)


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        version, *lines = raw[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        block = raw[end + 4 : end + 4 + size]
        if len(block) != size or raw[end + 4 + size : end + 8 + size] != END.encode():
            raise ValueError(f"record at byte {at} is cut short")
        yield fields, block
        at = end + 8 + size


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the WARC files in a folder, a row each."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        names = {"record_id": "warc-record-id", "record_type": "warc-type", "url": "warc-target-uri", "digest": "warc-payload-digest", "refers_to": "warc-refers-to", "origin": "warc-segment-origin-id", "number": "warc-segment-number", "total": "warc-segment-total-length"}
        for raw in batch.column("content"):
            found = list(parse_warc(gzip.decompress(raw.as_py())))
            out = {k: [f.get(v) for f, _ in found] for k, v in names.items()}
            yield out | {k: [int(x) if x else None for x in out[k]] for k in ("number", "total")} | {"block": [b for _, b in found]}

    files = spark.read.format("binaryFile").load(path)
    return batch_map(files, ["content"], run, "record_id string, record_type string, url string, digest string, refers_to string, origin string, number long, total long, block binary")


def _joined(parts: list, rid: str) -> bytes:
    parts = sorted(parts, key=lambda p: p["number"])
    block = b"".join(p["block"] for p in parts)
    if [p["number"] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] != len(block):
        raise ValueError(f"segments of {rid} are not whole")
    return block


def reassemble(records: DataFrame) -> DataFrame:
    """One row for each response or revisit: its segments joined, its framing decoded into ``payload`` (null for a revisit)."""
    whole = records.where("number IS NULL").select("record_id", "record_type", "url", "refers_to", "block")
    cut = records.where("number IS NOT NULL").withColumn("origin", F.coalesce("origin", "record_id"))
    lead = F.max_by(F.struct("record_type", "url", "refers_to"), -F.col("number"))
    grouped = cut.groupBy("origin").agg(lead.alias("lead"), F.collect_list(F.struct("number", "total", "block")).alias("parts"))

    def join(batch: pa.RecordBatch) -> dict:
        rids = batch.column("origin").to_pylist()
        out = {c: batch.column(c) for c in ("record_type", "url", "refers_to")}
        return out | {"record_id": rids, "block": [_joined(p, r) for p, r in zip(batch.column("parts").to_pylist(), rids, strict=True)]}

    schema = "record_id string, record_type string, url string, refers_to string, block binary"
    joined = batch_map(grouped, ["origin", "lead.record_type", "lead.url", "lead.refers_to", "parts"], join, schema)

    @F.pandas_udf("binary")
    def body(kinds: pd.Series, blocks: pd.Series) -> pd.Series:
        return pd.Series([unframe(b.partition(b"\r\n\r\n")[2]) if k == "response" else None for k, b in zip(kinds, blocks, strict=True)], dtype=object)

    payload = body("record_type", "block")
    return whole.unionByName(joined).select("record_id", "record_type", "url", "refers_to", payload.alias("payload"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record_type, url, refers_to, payload_bytes, payload_digest and payload; a revisit's length and digest are those of the response it refers to."""
    rows = reassemble(read_records(spark, path)).withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    return rows


def resolve_revisits(rows: DataFrame) -> DataFrame:
    """``rows`` without payloads; revisits have length and digest from their response."""
    slim = rows.drop("payload")
    revisits, rest = slim.where("record_type = 'revisit'"), slim.where("record_type <> 'revisit'")
    found = rest.select(F.col("record_id").alias("refers_to"), "payload_bytes", "payload_digest")
    wanted = revisits.select("refers_to").distinct()
    resolved = join_by_hot_key(revisits.drop("payload_bytes", "payload_digest"), found.join(wanted, "refers_to", "left_semi"), ["refers_to"], ["record_id"])
    return rest.unionByName(resolved)
