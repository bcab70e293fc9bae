"""Packing documents into sequences by non-negative least squares over the histogram of lengths.

Each document's ids (and an end id) are cut into full windows and one rest, so only the rests have to share sequences.
Lengths are rounded up to multiples of :data:`QUANTUM`; all ways to fill a window with up to three of them are
enumerated, and non-negative least squares says how often each is to be used so that the histogram is used up. The counts are
rounded down to what is there, and what is left is packed greedily, largest first, on the histogram. A plan is thus
made of counts of lengths: it is as small for 100 TB as for 1 MB, and only the histogram (one row a length) goes to the driver.

Pieces then take their places by rank: they are dealt by hash into buckets of some 50,000, numbered in their bucket, and the
buckets' sizes are summed for each length. No window or sort holds more than a bucket or a sequence.

* Null text counts as empty; an empty document is the end id alone. Very long documents become many full windows.
* Equal rows and repeated ids are packed as often as they occur; ties are between equal pieces and don't matter.
* An empty table gives an empty table. Only the id and text columns are read; others don't matter.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import batch_map, stored

WINDOW = 4096
QUANTUM = 8
END_ID = 2
BUCKET_ROWS = 50_000
#: Words whose ids a Python worker remembers, and the longest of them in bytes.
REMEMBERED, LONGEST = 250_000, 48
SLICE = 2_000_000
_SPACE = re.compile(rb"[ \t-\r]")
#: Where a run of ASCII marks (no apostrophe, which can open a contraction) closes a word.
_MARKS = re.compile(rb"(?<=[a-z0-9])(?=[!-&(-/:-@\[-`{-~]+(?:[ \t-\r]|\Z))")
_known: dict[str, tuple] = {}


def _encoder(path: str):
    if path not in _known:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _known.clear()
        _known[path] = Tokenizer.from_file(path), {}, set()
    return _known[path]


def _slices(raw: bytes) -> Iterator[bytes]:
    """``raw`` in parts of about SLICE bytes, cut at white space."""
    at = 0
    while len(raw) - at > SLICE and (m := _SPACE.search(raw, at + SLICE)):
        yield raw[at : m.start()]
        at = m.start()
    yield raw[at:]


def _learn(words: set[bytes], tokenizer, known: dict[bytes, bytes], again: set[bytes]) -> dict[bytes, bytes]:
    """Ids of words that aren't known yet; they are remembered unless they are long. When there are too many, those that were met ``again`` stay, if they are less than half."""
    order = [w for w in words if w not in known]
    again.update(known.keys() & words)
    if len(known) + len(order) > REMEMBERED:
        kept = {w: known[w] for w in (again if len(again) <= REMEMBERED // 2 else known.keys() & words)}
        known.clear()
        known.update(kept)
        again.clear()
    encoded = tokenizer.encode_batch_fast([w.decode() for w in order], add_special_tokens=False)
    found = {w: _pack(e.ids) for w, e in zip(order, encoded, strict=True)}
    known.update((w, x) for w, x in found.items() if len(w) <= LONGEST)
    return {w: x for w, x in found.items() if len(w) > LONGEST}


def _pack(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def token_bytes(texts: list[str], path: str) -> Iterator[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers, without special tokens.

    The tokenizer lower-cases, drops white space and never joins across it, nor a letter or digit with a mark after it, so
    a text's ids are those of its words and closing marks in turn. The ids of usual words are remembered.
    """
    tokenizer, known, again = _encoder(path)
    held: list[list[list[bytes]]] = []
    size = 0

    def flush() -> Iterator[bytes]:
        long = _learn(set().union(*(words for parts in held for words in parts)), tokenizer, known, again)
        for parts in held:
            if long:
                yield b"".join(known[w] if w in known else long[w] for words in parts for w in words)
            else:
                yield b"".join(b"".join(map(known.__getitem__, words)) for words in parts)

    for text in texts:
        if "<|" in text:  # a special token's string, perhaps: it may have marks inside
            yield from flush()
            held, size = [], 0
            yield _pack(tokenizer.encode(text, add_special_tokens=False).ids)
            continue
        held.append([_MARKS.sub(b" ", part).split() for part in _slices(text.encode().lower())])
        size += len(text)
        if size > SLICE:
            yield from flush()
            held, size = [], 0
    yield from flush()


def cut_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, id_column: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``window`` ids: doc_id, start, length, ids_crc32, doc_tokens, and the ids if wanted."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        ids = batch.column("doc_id").to_pylist()
        texts = [t or "" for t in batch.column("text").to_pylist()]
        out: dict[str, list] = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
        for doc_id, raw in zip(ids, token_bytes(texts, tokenizer), strict=True):
            raw += end
            for at in range(0, len(raw), 4 * window):
                piece = raw[at : at + 4 * window]
                for c, v in zip(out, (doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), len(raw) // 4, np.frombuffer(piece, "<u4").tolist() if with_ids else None), strict=True):
                    out[c].append(v)
        yield out

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids
    return batch_map(docs, [F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")], run, schema)


def fillings(bins: int) -> np.ndarray:
    """All ways to write ``bins`` as a sum of one to three parts, largest first; 0 stands for no part."""
    found = [(bins, 0, 0)] + [(bins - b, b, 0) for b in range(1, bins // 2 + 1)]
    found += [(bins - b - c, b, c) for c in range(1, bins // 3 + 1) for b in range(c, (bins - c) // 2 + 1)]
    return np.array(found)


def nnls(uses: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """x >= 0 that makes the use of each length closest to ``b``, by accelerated projected gradients; a column has the lengths in a row of ``uses``."""
    n, k = len(b), len(uses)
    flat, owner = uses.ravel(), np.repeat(np.arange(k), uses.shape[1])
    flat, owner = flat[flat > 0], owner[flat > 0]

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, x[owner], n)

    def back(r: np.ndarray) -> np.ndarray:
        return np.bincount(owner, r[flat], k)

    v = np.ones(k)
    for _ in range(30):
        v = back(forward(v))
        v /= (size := np.linalg.norm(v))
    x = y = np.zeros(k)
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(forward(y) - b) / (1.05 * size))
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        x, y = new, new + (before - 1) / t * (new - x)
    return x


def plan_packing(counts: dict[int, int], bins: int) -> list[tuple[tuple[int, ...], int]]:
    """Contents of sequences in rounded lengths, largest first, and how many sequences have them; uses up ``counts``."""
    left = np.zeros(bins + 1, np.int64)
    for k, n in counts.items():
        left[k] = n
    if not left.sum():
        return []
    plan = [((bins,), int(left[bins]))] if left[bins] else []
    left[bins] = 0
    if total := left.sum():
        ways = fillings(bins)[1:]
        x = nnls(ways, left / total) * total
        for k in np.argsort(-x, kind="stable"):
            if x[k] < 0.5:
                break
            parts, use = np.unique(ways[k][ways[k] > 0], return_counts=True)
            if n := int(min(round(x[k]), (left[parts] // use).min())):
                left[parts] -= n * use
                plan.append((tuple(int(p) for p in ways[k] if p), n))
    while left.any():
        now, room, taken = left.copy(), bins, []
        while room and now[: room + 1].any():
            part = int(np.flatnonzero(now[: room + 1])[-1])
            taken.append(part)
            now[part] -= 1
            room -= part
        parts, use = np.unique(taken, return_counts=True)
        n = int((left[parts] // use).min())
        left[parts] -= n * use
        plan.append((tuple(taken), n))
    return plan


def place_pieces(pieces: DataFrame, window: int = WINDOW, quantum: int = QUANTUM) -> DataFrame:
    """``pieces`` with sequence_id and offset. They are read three times, so they should be stored."""
    spark, bins = pieces.sparkSession, window // quantum
    sized = pieces.withColumn("_bin", F.ceil(F.col("length") / quantum).cast("int"))
    histogram = {r["_bin"]: r["n"] for r in sized.groupBy("_bin").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``bins`` rows
    slots, first, used = [], 0, dict.fromkeys(range(bins + 1), 0)
    for parts, n in plan_packing(histogram, bins):
        for slot, part in enumerate(parts):
            slots.append((part, used[part], used[part] + n, first, slot))
            used[part] += n
        first += n
    buckets = max(1, -(-sum(histogram.values()) // BUCKET_ROWS))
    keys = ["_bin", "_bucket"]
    dealt = sized.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    sizes = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(*keys, (F.sum("_n").over(Window.partitionBy("_bin").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    numbered = dealt.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id", "start", "length", "ids_crc32")) - 1)
    ranked = numbered.join(before, keys).withColumn("_rank", F.col("_before") + F.col("_k"))
    places = spark.createDataFrame(slots, "_bin int, _from long, _to long, _first long, _slot int")  # as small as the plan
    placed = ranked.join(F.broadcast(places), "_bin").where("_rank >= _from AND _rank < _to").withColumn("sequence_id", F.col("_first") + F.col("_rank") - F.col("_from"))
    offset = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("_slot")) - F.col("length")
    return placed.withColumn("offset", offset).select(*pieces.columns, "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, id_column: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a piece of a document: where it comes from and where in which sequence it lies."""
    return place_pieces(stored(cut_pieces(docs, tokenizer, window, end_id, id_column, text, with_ids)), window)
