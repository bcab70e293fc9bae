"""Vectors as short codes: each part of a vector by the number of its nearest entry in a codebook.

Vectors become integers (``floor(SCALE * x)``) and are cut into :data:`PARTS` equal parts. A part position's codebook starts as that part of the vectors with the least
ids; rounds assign every part to its nearest entry and move entries to ``floor(sum / count)`` of their parts. All of it is exact in integers, so the
result depends neither on partitions nor on the order of rows.

The nearest entry is found by partial distances: dimensions come in descending variance of the codebook, a few at a time. The entry that is nearest by the
first ones is measured whole, and others are dropped as soon as what has been added up for them strictly exceeds that. What a task keeps between rows are the
sums and counts of the entries; those of all tasks are added by Spark, and only the codebooks, :data:`ENTRIES` rows for each part, reach the driver.

* Rows whose vector is null or empty, or holds null or non-finite components, are dropped. So are those whose number of components isn't the most frequent one (the
  largest of several) among the multiples of :data:`PARTS`.
* Ties go to the lower index; entries without parts stay. Fewer vectors than entries give smaller codebooks.
* Rows with equal ids are rows of their own, ordered by their vectors where ids decide; null ids come last. Equal rows give equal rows. Null labels are one label.
* Components beyond ``2 ** 27 / SCALE`` raise an error, as squared distances would not fit into 64 bits.
* An empty table gives an empty table. Only the id, vector and label columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import join_by_hot_key, stored
from newsloom.llm.vectors import floors, matrices, named, whole

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Dimensions that are added at once.
STEP = 4


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of, and squared distance to, each row's nearest entry of ``book``, the lower index of equally near ones."""
    order = np.argsort(-book.astype(np.float64).var(0), kind="stable")
    parts, book = parts[:, order], book[:, order]
    first, later = order[:STEP].size, range(STEP, len(order), STEP)
    sums = ((parts[:, None, :first] - book[None, :, :first]) ** 2).sum(2)
    guess = sums.argmin(1)
    best = ((parts - book[guess]) ** 2).sum(1)
    row, entry = np.nonzero(sums <= best[:, None])
    total = sums[row, entry]
    for a in later:
        total += ((parts[row, a : a + STEP] - book[entry, a : a + STEP]) ** 2).sum(1)
        stay = total <= best[row]
        row, entry, total = row[stay], entry[stay], total[stay]
    begin = np.flatnonzero(np.diff(row, prepend=-1))  # each row still has its guess
    least = np.minimum.reduceat(total, begin)
    hit = np.flatnonzero(total == least[row])
    return entry[hit[np.searchsorted(row[hit], np.arange(len(parts)))]], least


def _sums(vectors: DataFrame, dims: int, scale: int, books: np.ndarray) -> DataFrame:
    """part, entry, n and the sum of each component, a row for each task at most."""
    parts, entries, size = books.shape
    names = [f"s{k}" for k in range(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for _, x in matrices(batches, dims, scale):
            for p in range(parts):
                part = x[:, p * size : (p + 1) * size]
                code, _ = nearest(part, books[p])
                n[p] += np.bincount(code, minlength=entries)
                np.add.at(total[p], code, part)
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_pydict({"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": n[p, e]} | {c: total[p, e, k] for k, c in enumerate(names)})

    each = vectors.select("vector").mapInArrow(run, ", ".join(["part int, entry int, n long", *(f"{c} long" for c in names)]))
    return each.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *names)])


def _dims(vectors: DataFrame, parts: int) -> int | None:
    size = F.size("vector")
    row = vectors.where((size > 0) & (size % parts == 0)).groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    return row and row["size"]


def train_codebooks(vectors: DataFrame, dims: int, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks by part, entry and position within the part, of a table with id and vector."""
    start = vectors.where(whole(F.col("vector"), dims)).orderBy(F.asc_nulls_last("id"), "vector").limit(entries).select("vector").collect()
    books = floors(np.array([r[0] for r in start], np.float64).reshape(len(start), dims), scale)
    books = books.reshape(len(start), parts, dims // parts).swapaxes(0, 1).copy()
    for _ in range(rounds if len(start) else 0):
        for r in _sums(vectors, dims, scale, books).toLocalIterator():
            part, entry, n, *sums = r
            books[part, entry] = [s // n for s in sums]
    return books


def encode(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """id, code, error, label_error and codebooks_sha256 of each row that is kept."""
    vectors = named(table, id=id_column, label=label, vector=vector)
    dims = _dims(vectors, parts) or parts
    books = train_codebooks(vectors, dims, scale, parts, entries, rounds)
    size = dims // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in matrices(batches, dims, scale):
            found = [nearest(x[:, p * size : (p + 1) * size], books[p]) for p in range(parts)]
            codes = np.stack([c for c, _ in found], 1).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "label": batch.column(1), "code": [c.tobytes().hex() for c in codes], "error": sum(d for _, d in found)})

    if entries > 256:
        raise ValueError("codes have two hex digits for each part, so at most 256 entries")
    columns = vectors.select("id", F.struct(F.coalesce(F.col("label").cast("string"), F.lit("")).alias("l"), F.col("label").isNull().alias("null")).alias("label"), "vector")
    coded = columns.select("id", F.to_json("label").alias("label"), "vector").mapInArrow(run, f"id {dict(vectors.dtypes)['id']}, label string, code string, error long")
    coded = stored(coded)
    labels = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("size")))
    out = join_by_hot_key(coded, labels.drop("size"), ["label"], ["code", "error", "id"], sizes=labels.select("label", "size"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return out.select(F.col("id").alias(id_column), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
