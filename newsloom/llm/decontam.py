"""Benchmark decontamination by spaced seeds.

Words are lower-cased and stripped of punctuation at both ends. A spaced seed is a fixed mask over consecutive words that
looks at some places and ignores the others, so one or more changed words need not hide a passage. Hashes of the benchmark's
seeds are broadcast in blocks of at most :data:`BLOCK_SEEDS` with the words of the items they come from, and each document is
held against a block in one pass: hits by hash, then around each hit the words are compared place by place. A run with at least
``min_match`` equal words, at most ``max_gap`` changed ones between two equal ones and at least ``min_share`` of equal words overall is
an overlap. Of a stretch that has a hit, the run with most equal words is reported, then those beside it, so further equal words never
hide a run. Items shorter than ``min_match`` words are found if they occur whole.

Documents are never shuffled nor grouped, so nothing is hot; more benchmark items mean more passes, not a larger broadcast.

* Null or empty texts, in documents or benchmark, and those without words: no overlap.
* Repeated rows or items are reported each. An empty documents or benchmark table gives an empty table.
* Very long texts are searched whole. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import batch_map, mixed, quoted

#: Fixed masks (1 looks, 0 ignores): the first is solid, the others let substitutions pass at different places.
MASKS = ("11111111", "110110110110110", "111010010101110", "101011100110111", "11100011100111")
MIN_MATCH = 13
MAX_GAP = 4
MIN_SHARE = 0.7
BLOCK_SEEDS = 500_000
_STRIP = re.compile(r"^\W+|\W+$")
#: A multiplier for each place of each mask.
_ODD = mixed(np.arange(1, 1 + len(MASKS) * max(map(len, MASKS)), dtype=np.uint64)).reshape(len(MASKS), -1) | np.uint64(1)
#: Of a hash, so many leading bits are looked up in a table before the hash itself is.
_FIRST_BITS = 22
#: So many words are remembered with their hash in a worker.
MEMORY = 100_000
_words: dict[str, int] = {}


def _hash_of(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each normalised word; words of punctuation alone are left out."""
    if not text:
        return np.zeros(0, np.uint64)
    if len(_words) > MEMORY:
        _words.clear()
    out = []
    for w in text.lower().split():
        h = _words.get(w)
        if h is None:
            bare = _STRIP.sub("", w)
            h = _words[w] = _hash_of(bare) if bare else 0
        out.append(h)
    x = np.array(out, np.uint64)
    return x[x != 0]


def seeds(words: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """For each mask, the hash of what it sees at each start."""
    for k, mask in enumerate(MASKS):
        n = len(words) - len(mask) + 1
        if n < 1:
            continue
        h = np.full(n, k + 1, np.uint64)
        for j, c in enumerate(mask):
            if c == "1":
                h += words[j : j + n] * _ODD[k, j]
        yield h, k


def extend(a: np.ndarray, b: np.ndarray, i: int, j: int, max_gap: int) -> np.ndarray:
    """Places in ``a`` of the words equal to those of ``b`` on one diagonal, around places i and j as far as gaps allow."""
    back = min(i, j)
    n = min(len(a) - i, len(b) - j)
    at = np.flatnonzero(a[i - back : i + n] == b[j - back : j + n])
    k = int(np.searchsorted(at, back))
    breaks = np.flatnonzero(np.diff(at) > max_gap + 1)
    lo = breaks[breaks < k]
    hi = breaks[breaks >= k]
    return i - back + at[int(lo[-1]) + 1 if len(lo) else 0 : int(hi[0]) + 1 if len(hi) else len(at)]


def runs(at: np.ndarray, least: int, min_share: float) -> Iterator[tuple[int, int, int]]:
    """Start, end and number of equal words of runs with ``least`` of them and their share: the one with most, then those beside it."""
    todo = [at]
    while todo:
        at = todo.pop()
        if len(at) < max(least, 1):
            continue
        k = np.arange(len(at))
        # from p to q, q - p + 1 >= min_share * (at[q] - at[p] + 1); for each q, the first p that fulfils this
        need = np.minimum.accumulate(k - min_share * at)
        p = np.searchsorted(-need, -(k + 1 - min_share * (at + 1) + 1e-9))
        q = int((k - p).argmax())
        same = q - int(p[q]) + 1
        if same >= least:
            yield int(at[p[q]]), int(at[q]) + 1, same
            todo += [at[: p[q]], at[q + 1 :]]


def overlaps(words: np.ndarray, block: dict, min_match: int, max_gap: int, min_share: float) -> list[tuple]:
    """item_id, start, end (in normalised words), equal words of each overlap with the block's items."""
    found, seen = [], set()
    for h, _ in seeds(words):
        likely = np.flatnonzero(block["first"][(h >> np.uint64(64 - _FIRST_BITS)).astype(np.int64)])
        at = np.searchsorted(block["hash"], h[likely])
        at[at == len(block["hash"])] = 0
        hit = block["hash"][at] == h[likely]
        for i, k in zip(likely[hit].tolist(), at[hit].tolist(), strict=True):
            while k < len(block["hash"]) and block["hash"][k] == h[i]:
                item, j = int(block["item"][k]), int(block["place"][k])
                k += 1
                if any(s <= i < e for s, e in (x[1:] for x in seen if x[0] == (item, int(i) - j))):
                    continue
                own = block["words"][item]
                if words[i] != own[j]:  # a mask begins with a place that it looks at: this was a collision
                    continue
                equal = extend(words, own, int(i), j, max_gap)
                seen.add(((item, int(i) - j), int(equal[0]), int(equal[-1]) + 1))
                found += [(block["id"][item], *run) for run in runs(equal, min(min_match, len(own)), min_share)]
    return found


def _short(words: np.ndarray, block: dict) -> list[tuple]:
    """Items with fewer words than the shortest mask, where they occur whole."""
    found = []
    for item in block["short"]:
        own = block["words"][item]
        n = len(words) - len(own) + 1
        if n > 0:
            hit = np.ones(n, bool)
            for j, x in enumerate(own):
                hit &= words[j : j + n] == x
            found += [(block["id"][item], int(i), int(i) + len(own), len(own)) for i in np.flatnonzero(hit)]
    return found


def _blocks(benchmark: DataFrame, id_column: str, text: str) -> Iterator[dict]:
    """The benchmark's items in blocks of a bounded number of seeds, read item by item."""
    rows, size = [], 0

    def block() -> dict:
        words = [w for _, w in rows]
        parts = [(h, np.full(len(h), k), np.arange(len(h))) for k, w in enumerate(words) for h, _ in seeds(w)]
        hashes, item, place = (np.concatenate(x) if parts else np.zeros(0, np.uint64) for x in (zip(*parts, strict=True) if parts else ((),) * 3))
        order = np.argsort(hashes, kind="stable")
        first = np.zeros(1 << _FIRST_BITS, bool)
        first[(hashes >> np.uint64(64 - _FIRST_BITS)).astype(np.int64)] = True
        short = [k for k, w in enumerate(words) if 0 < len(w) < min(map(len, MASKS))]
        return {"first": first, "hash": hashes[order], "item": item[order].astype(np.int64), "place": place[order].astype(np.int64), "words": words, "id": [i for i, _ in rows], "short": short}

    for r in benchmark.select(F.col(id_column).cast("long").alias("i"), F.col(text).alias("t")).toLocalIterator():
        w = word_hashes(r["t"])
        if not len(w):
            continue
        rows.append((r["i"], w))
        size += len(MASKS) * len(w)
        if size >= BLOCK_SEEDS:
            yield block()
            rows, size = [], 0
    if rows:
        yield block()


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item_column: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, item_id, start_word, end_word, n_equal: every overlap of a document with an item."""
    schema = "doc_id long, item_id long, start_word long, end_word long, n_equal long"
    spark, out = docs.sparkSession, None
    for found in _blocks(benchmark, item_column, item_text):
        shared = spark.sparkContext.broadcast(found)

        def run(batch: pa.RecordBatch, shared=shared) -> dict:
            rows = []
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = word_hashes(t)
                rows += [(i, *x) for x in (*overlaps(words, shared.value, min_match, max_gap, min_share), *_short(words, shared.value))]
            return dict(zip(("doc_id", "item_id", "start_word", "end_word", "n_equal"), zip(*rows, strict=True) if rows else ([],) * 5, strict=True))

        part = batch_map(docs, [F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")], run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that overlap with the benchmark; rows with a null id stay."""
    dirty = find_overlaps(docs, benchmark, id_column, **options).select(F.col("doc_id").alias(id_column)).distinct()
    return docs.join(dirty, id_column, "left_anti").select(*map(quoted, docs.columns))
