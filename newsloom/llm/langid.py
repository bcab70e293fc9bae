"""Language identification by hyperdimensional profiles.

Each letter has a random vector of :data:`DIMENSIONS` signs, drawn from its code point alone. A trigram's vector binds (multiplies)
its letters' vectors, permuted by place; a text's vector bundles (adds) those of its trigrams; a language's prototype is the
mean direction of its training texts. A text gets the language whose prototype has the largest cosine with its vector.

Text is lower-cased; everything but letters is a space, and spaces count once. Training adds, in each partition, the unit vectors
of each language's texts, and Spark adds these over partitions and dimensions: what reaches the driver is one vector a
language, however large the corpus is, and no more than :data:`BLOCK` of them at once. More languages than that stay a table; texts are then compared with a block of them
after another, and the best of all blocks counts. All texts are used whole, in training and prediction.

* Null text, or one without a letter: ``und``, score 0. Texts with a null language are not trained on.
* Nothing to train on: every text is ``und`` with score 0.
* Ties, cosines that agree to five places, go to the language that is first in alphabetical order. Repeated rows are judged alike. An empty table gives an empty table.
* Only id, text and language columns are read; others don't matter, and no prediction sees the language or the id.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import batch_map, mixed, stored

DIMENSIONS = 1024
BLOCK = 1000
UNDETERMINED = "und"
#: Trigram vectors that a Python worker remembers.
REMEMBERED = 60_000
_state: dict[str, object] = {}


def _is_letter() -> np.ndarray:
    if "letters" not in _state:
        _state["letters"] = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _state["letters"]


def letter_vector(point: int) -> np.ndarray:
    """The signs of a code point's letter, always the same; the space has one as well."""
    cache = _state.setdefault("signs", {})
    if point not in cache:
        words = mixed(np.arange(DIMENSIONS // 64, dtype=np.uint64) + np.uint64((point + 1) * 0x9E3779B97F4A7C15 % 2**64))
        cache[point] = (np.unpackbits(words.view(np.uint8)).astype(np.int8) * 2 - 1).astype(np.int8)
    return cache[point]


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct trigrams (21 bits a code point) and how often each occurs; None if there is no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _is_letter()[points]
    if not letters.any():
        return None
    points = np.where(letters, points, 32)
    points = np.concatenate([[32], points, [32]]).astype(np.uint64)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    p = points[keep]
    return np.unique((p[:-2] << np.uint64(42)) | (p[1:-1] << np.uint64(21)) | p[2:], return_counts=True)


def _vectors(grams: np.ndarray) -> np.ndarray:
    """A row of signs for each trigram."""
    rows, table = _state.setdefault("rows", {}), _state.get("table")
    if table is None or len(rows) + len(grams) > len(table):
        rows.clear()
        table = _state["table"] = np.empty((max(REMEMBERED, len(grams)), DIMENSIONS), np.int8)
    own = grams.tolist()
    at = np.array([rows.get(g, -1) for g in own])
    for k in np.flatnonzero(at < 0):
        g = own[k]
        at[k] = rows[g] = len(rows)
        a, b, c = g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF
        table[at[k]] = np.roll(letter_vector(a), 2) * np.roll(letter_vector(b), 1) * letter_vector(c)
    return table[at]


def text_vector(text: str | None) -> np.ndarray | None:
    """The bundle of a text's trigrams, of length 1; None without a letter."""
    found = trigrams(text) if text else None
    if found is None:
        return None
    grams, counts = found
    total = np.zeros(DIMENSIONS, np.float32)
    for k in range(0, len(grams), 4096):
        total += counts[k : k + 4096].astype(np.float32) @ _vectors(grams[k : k + 4096]).astype(np.float32)
    size = np.linalg.norm(total)
    return total / size if size else total


def train_prototypes(docs: DataFrame, text: str = "text", language: str = "lang") -> dict[str, list[float]] | DataFrame:
    """The prototype, of length 1, of each language in ``docs``: a dict, or for more than :data:`BLOCK` languages a table (lang, v, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(DIMENSIONS))
        for batch in batches:
            for t, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if (v := text_vector(t)) is not None:
                    sums[lang] += v
        langs, dims = list(sums), np.arange(DIMENSIONS)
        for lang in langs:
            # thousandths, so that the sum doesn't depend on its order
            yield pa.RecordBatch.from_pydict({"lang": [lang] * DIMENSIONS, "dim": dims, "x": np.round(sums[lang] * 1e6).astype(np.int64)})

    trained = docs.where(F.col(language).isNotNull()).select(F.col(text).alias("text"), F.col(language).alias("lang"))
    parts = trained.mapInArrow(run, "lang string, dim long, x long")
    sums = parts.groupBy("lang", "dim").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda e: e["x"]).alias("v"))
    sums = stored(sums)
    languages = sums.count()
    if languages > BLOCK:
        return stored(sums.withColumn("block", F.pmod(F.xxhash64("lang"), F.lit(2 * languages // BLOCK + 1)).cast("int")))
    return _prototypes(sums)


def _prototypes(sums: DataFrame) -> dict[str, list[float]]:
    """The sums of some languages at length 1, in alphabetical order."""
    out = {}
    for r in sorted(sums.collect(), key=lambda r: r["lang"]):
        v = np.array(r["v"], float)
        out[r["lang"]] = (v / (np.linalg.norm(v) or 1)).tolist()
    return out


def _by_blocks(docs: DataFrame, prototypes: DataFrame, id_column: str, text: str) -> DataFrame:
    """:func:`predict_language` with a table of prototypes: each block's best languages, and of these the best for each row."""
    rows = stored(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("row", F.monotonically_increasing_id()))
    best = None
    for b in sorted(r["block"] for r in prototypes.select("block").distinct().collect()):
        found = _predicted(rows, _prototypes(prototypes.where(F.col("block") == b)), "row", "text", least=-2.0)
        best = stored(found if best is None else best.union(found).groupBy("doc_id").agg(F.min(F.struct((-F.round("score", 5)).alias("s"), "lang_pred", "score")).alias("b")).select("doc_id", "b.lang_pred", "b.score"))
    shown = F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score")).alias("score")
    return rows.select("row", F.col("doc_id").alias("of")).join(best, F.col("row") == F.col("doc_id")).select(F.col("of").alias("doc_id"), "lang_pred", shown)


def predict_language(docs: DataFrame, prototypes: dict[str, list[float]] | DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (the cosine, 0 if negative) of each row."""
    if isinstance(prototypes, DataFrame):
        return _by_blocks(docs, prototypes, id_column, text)
    return _predicted(docs, prototypes, id_column, text)


def _predicted(docs: DataFrame, prototypes: dict[str, list[float]], id_column: str, text: str, least: float = 0.0) -> DataFrame:
    """The best language and its cosine, which is shown as ``least`` if it is below that."""
    names = list(prototypes)
    shared = docs.sparkSession.sparkContext.broadcast(np.array([prototypes[n] for n in names], np.float32).reshape(-1, DIMENSIONS))

    def run(batch: pa.RecordBatch) -> dict:
        found, scores = [], []
        for t in batch.column("text").to_pylist():
            v = text_vector(t) if names else None
            if v is None:
                found.append(UNDETERMINED)
                scores.append(0.0)
                continue
            cosines = shared.value @ v
            k = int(np.round(cosines, 5).argmax())
            found.append(names[k])
            scores.append(min(1.0, max(least, float(cosines[k]))))
        return {"doc_id": batch.column("doc_id"), "lang_pred": found, "score": scores}

    return batch_map(docs, [F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")], run, "doc_id long, lang_pred string, score double")
