"""Windows of tokens that occur twice or more in a corpus: the part that both kinds of substring removal share.

A window is ``length`` consecutive tokens (bytes or words) of one document. Its anchor is the run of ``seed`` tokens in it with the
least hash, the first of equal ones. Equal windows have equal anchors at equal places, so whatever repeats can be found among
windows with one anchor. Consecutive windows with the same anchor make a segment; there are about two segments to
``length - seed`` tokens.

1. Anchors that occur once are dropped: none of their windows repeats.
2. Segments with equal anchor and equal 128-bit digest of their bytes are one class. Two members of each class (the one, if there is but
   one) are fetched with their text.
3. The suffixes that begin with windows of the segments of one anchor are a group, and groups that fit in memory (:data:`GROUP` segments)
   go to ``engine``, which finds the windows that occur twice, some :data:`BLOCK` bytes of groups at a time. All members of a class share
   what is found.
4. A group that is larger is split by a longer prefix: windows where the anchor stands in the first half of its possible places, and
   those where it stands in the second. All windows of a half have more tokens around the anchor in common, and these are the
   new prefix by which they are dealt. Halving ends at the latest when the whole window is the prefix: all suffixes of such a group begin
   with the same window, and as one class it has two members at most. So every group gets small, however often a passage occurs.

Hashes only route. Their bases are drawn anew in each call, so no text can be made to collide. Rows of hot keys are dealt to many
tasks; counts are combined before they are shuffled. Documents are joined by their id; if ids are null or repeated, rows are stored
once more with a number each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import batch_map, drop_stored, join_by_hot_key, mixed, quoted, stored
from newsloom.llm.hashing import Keys, Sums

#: Most segments of a group, bytes of groups that the engine gets at once, rows of a batch, and tokens that are hashed at once.
GROUP, BLOCK, FLUSH, TOKENS = 1000, 500_000, 50_000, 1 << 17
_PLACE = np.uint64((1 << 18) - 1)
CLASS = ["anchor", "d1", "d2"]


class Tokens(Protocol):
    """How a text is read; ``read`` gives a document from which tokens are counted, cut as bytes, and turned into values for a hash.

    ``read_cut`` does so for what ``cut`` gave.
    """

    length: int
    seed: int

    def read(self, raw: bytes) -> object: ...
    def read_cut(self, raw: bytes) -> object: ...
    def count(self, doc: object) -> int: ...
    def cut(self, doc: object, first: int, end: int) -> bytes: ...
    def values(self, doc: object, first: int, end: int, keys: Keys) -> tuple[np.ndarray, np.ndarray]: ...


@dataclass(frozen=True)
class Group:
    """Segments that meet in a task: their bytes, how many windows each has, and its anchor (numbered, in order)."""

    texts: list[bytes]
    windows: np.ndarray
    anchors: np.ndarray


Engine = Callable[[Group], list[list[tuple[int, int]]]]


def segments(tokens: Tokens, doc: object, keys: Keys) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window, place of the anchor in it, and number of windows of each segment."""
    found, total = [], tokens.count(doc)
    w = tokens.length - tokens.seed + 1
    for at in range(0, max(0, total - tokens.length + 1), TOKENS):
        own = tokens.values(doc, at, min(total, at + TOKENS + tokens.length - 1), keys)
        h = mixed(Sums(own, keys).windows(tokens.seed))
        keyed = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        padded = np.full(-(-len(h) // w) * w, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(h)] = keyed
        rows = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(own[0]) - tokens.length + 1
        place = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & _PLACE).astype(np.int64)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        found.append((h[place[starts]].view(np.int64), starts + at, place[starts] - starts, np.diff(np.append(starts, n))))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4


def digests(texts: list[bytes]) -> np.ndarray:
    """128 bits of a cryptographic digest of each, as two numbers."""
    return np.frombuffer(b"".join([blake2b(t, digest_size=16).digest() for t in texts]), "<i8").reshape(-1, 2)


def span_of(start: np.ndarray, place: np.ndarray, n: np.ndarray) -> np.ndarray:
    return start << 24 | place << 12 | n


def keyed_documents(docs: DataFrame, id_column: str, text: str, carry: bool = False) -> DataFrame:
    """id, text (null: empty) and ``key``, which no two rows share; with ``carry`` also all columns but the text as ``row``."""
    row = [F.struct(*[F.col(quoted(c)) for c in docs.columns if c != text] or [F.lit(0)]).alias("row")] if carry else []
    ids = F.col(quoted(id_column)).cast("long")
    out = docs.select(ids.alias("id"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"), *row)
    if out.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL").isEmpty():
        return out.withColumn("key", F.col("id"))
    return stored(out.withColumn("key", F.monotonically_increasing_id()))


def _segment_rows(docs: DataFrame, tokens: Tokens, keys: Keys) -> DataFrame:
    """key, anchor, digest (d1, d2) and span (first window, place of the anchor, number of windows) of each segment."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        held, parts, made, size = [], [], [], 0

        def rows() -> dict:
            anchor, span = (np.concatenate(x) for x in zip(*parts, strict=True))
            d = np.concatenate(made)
            return {"key": np.repeat(np.array(held, np.int64), [len(p[0]) for p in parts]), "anchor": anchor, "d1": d[:, 0], "d2": d[:, 1], "span": span}

        for key, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
            doc = tokens.read(text.as_py().encode())
            anchor, start, place, n = segments(tokens, doc, keys)
            for k in range(0, len(anchor), FLUSH):
                a, s, p, m = (x[k : k + FLUSH] for x in (anchor, start, place, n))
                held.append(key)
                parts.append((a, span_of(s, p, m)))
                made.append(digests([tokens.cut(doc, x, y) for x, y in zip(s.tolist(), (s + m + tokens.length - 1).tolist(), strict=True)]))
                size += len(a)
                if size > FLUSH:
                    yield rows()
                    held, parts, made, size = [], [], [], 0
        if parts:
            yield rows()

    return batch_map(docs, ["key", "text"], run, "key long, anchor long, d1 long, d2 long, span long")


SEGMENTS = "anchor long, d1 long, d2 long, large boolean, lo int, hi int, span long, first boolean, copies long, bytes binary"


def _fetched(docs: DataFrame, classes: DataFrame, tokens: Tokens) -> DataFrame:
    """One or two members of each class with their bytes; the anchor can stand from ``lo`` to ``hi``."""

    def place(which: str) -> DataFrame:
        w = F.struct(*CLASS, "large", F.col(f"{which}_span").alias("span"), F.lit(which == "one").alias("first"))
        return (classes if which == "one" else classes.where("size > 1")).select(F.col(which).alias("key"), w.alias("w"))

    per_doc = place("one").union(place("two")).groupBy("key").agg(F.collect_list("w").alias("wanted"))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for text, asked in zip(batch.column("text"), batch.column("wanted"), strict=True):
            doc, found = tokens.read(text.as_py().encode()), asked.values
            for k in range(0, len(found), 4096):
                part = found.slice(k, 4096)
                out = {c: part.field(c) for c in (*CLASS, "large", "span", "first")}
                spans = out["span"].to_numpy()
                start = spans >> 24
                end = start + (spans & 0xFFF) + tokens.length - 1
                cut = [tokens.cut(doc, x, y) for x, y in zip(start.tolist(), end.tolist(), strict=True)]
                lo, hi = np.zeros(len(part), np.int32), np.full(len(part), tokens.length - tokens.seed, np.int32)
                yield out | {"lo": lo, "hi": hi, "span": spans & 0xFFFFFF, "copies": np.ones(len(part), np.int64), "bytes": cut}

    return batch_map(docs.select("key", "text").join(per_doc, "key"), ["text", "wanted"], run, SEGMENTS)


def _searched(texts: DataFrame, engine: Engine) -> DataFrame:
    """``runs`` (first window << 12 | number of windows) of repeated windows in each class of ``texts``."""

    def flush(rows: list[tuple]) -> dict:
        rows = [r for r in rows for _ in range(r[5])]
        anchors = np.unique([r[0] for r in rows], return_inverse=True)[1]
        found = engine(Group([r[6] for r in rows], np.array([r[3] & 0xFFF for r in rows]), anchors))
        out = {r[:3]: [at << 12 | n for at, n in runs] for r, runs in zip(rows, found, strict=True) if r[4] and runs}
        return {c: [k[j] for k in out] for j, c in enumerate(CLASS)} | {"runs": list(out.values())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in (*CLASS, "span", "first", "copies", "bytes")), strict=True):
                if size > BLOCK and r[0] != held[-1][0]:
                    yield pa.RecordBatch.from_pydict(flush(held), schema=schema)
                    held, size = [], 0
                held.append(r)
                size += r[5] * len(r[6])
        if held:
            yield pa.RecordBatch.from_pydict(flush(held), schema=schema)

    schema = pa.schema([*((c, pa.int64()) for c in CLASS), ("runs", pa.list_(pa.int64()))])
    dealt = texts.drop("large", "lo", "hi").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "anchor long, d1 long, d2 long, runs array<long>")


def _halves(tops: DataFrame, tokens: Tokens) -> DataFrame:
    """Segments with their windows dealt by the half in which the anchor stands, and by a longer prefix.

    ``up_...``: the class of the segment; ``shift``: the first window of the part in the segment.
    """
    names = ("up_anchor", "up_d1", "up_d2", "shift", *CLASS, "lo", "hi", "span", "copies", "bytes")

    def run(batch: pa.RecordBatch) -> dict:
        rows = []
        for *up, lo, hi, span, copies, raw in zip(*(batch.column(c).to_pylist() for c in (*CLASS, "lo", "hi", "span", "copies", "bytes")), strict=True):
            place, n, doc, mid = span >> 12, span & 0xFFF, tokens.read_cut(raw), (lo + hi) // 2
            for a, b in ((lo, mid), (mid + 1, hi)):
                first, last = max(0, place - b), min(n - 1, place - a)
                if first <= last:
                    prefix = b"%d %d " % (a, b) + tokens.cut(doc, place - a, place - b + tokens.length)
                    part = tokens.cut(doc, first, last + tokens.length)
                    (g, _), d = digests([prefix, part]).tolist()
                    rows.append((*up, first, g, *d, a, b, (place - first) << 12 | (last - first + 1), copies, part))
        return dict(zip(names, zip(*rows, strict=True) if rows else ([],) * len(names), strict=True))

    schema = "up_anchor long, up_d1 long, up_d2 long, shift long, anchor long, d1 long, d2 long, lo int, hi int, span long, copies long, bytes binary"
    return batch_map(tops, [*CLASS, "lo", "hi", "span", "copies", "bytes"], run, schema)


def _marked(classes: DataFrame, copies: Column) -> DataFrame:
    """``classes`` with ``large``: whether their group has over :data:`GROUP` segments."""
    sizes = stored(classes.groupBy("anchor").agg(F.sum(copies).alias("total")).where(F.col("total") > GROUP))
    hot = sizes.withColumnRenamed("total", "size")
    return join_by_hot_key(classes, sizes, ["anchor"], ["d1"], how="left", sizes=hot).withColumn("large", F.col("total").isNotNull()).drop("total")


def _found(texts: DataFrame, tokens: Tokens, engine: Engine) -> DataFrame:
    """``runs`` of the classes in ``texts``; large groups are halved until none is left."""
    found = _searched(texts.where("NOT large"), engine)
    large = texts.where("large")
    if large.isEmpty():
        return found
    same = [F.first(c).alias(c) for c in ("lo", "hi", "span", "bytes")]
    copies = F.least(F.sum("copies"), F.lit(2)).alias("copies")
    parts = stored(_halves(large.groupBy(*CLASS).agg(*same, copies), tokens))
    merged = stored(parts.groupBy(*CLASS).agg(*same, copies).withColumn("first", F.lit(True)))
    below = _found(stored(_marked(merged, F.col("copies"))), tokens, engine)
    runs = F.transform("runs", lambda r: r + F.shiftleft("shift", 12))
    up = join_by_hot_key(parts.drop("bytes"), below, CLASS, ["up_d1"])
    return found.union(up.select(*(F.col(f"up_{c}").alias(c) for c in CLASS), runs.alias("runs")))


def repeated_windows(docs: DataFrame, tokens: Tokens, engine: Engine) -> DataFrame:
    """key and span (first window << 12 | number of windows) of runs of repeated windows; ``docs`` has key and text."""
    rows = stored(_segment_rows(docs, tokens, Keys.drawn()))
    often = stored(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    again = stored(join_by_hot_key(rows, often, ["anchor"], ["key", "span"], sizes=often).drop("size"))
    drop_stored(rows)
    drop_stored(often)
    places = [f(c).alias(n + s) for f, n in ((F.first, "one"), (F.last, "two")) for c, s in (("key", ""), ("span", "_span"))]
    classes = stored(again.groupBy(*CLASS).agg(F.count(F.lit(1)).alias("size"), *places))
    marked = _marked(classes, F.least("size", F.lit(2)))
    texts = stored(_fetched(docs, marked, tokens))
    found = stored(_found(texts, tokens, engine))
    drop_stored(texts)
    sizes = classes.where("size > 1").select(*CLASS, "size")
    out = join_by_hot_key(again, found, CLASS, ["key", "span"], sizes=sizes).select("key", F.col("span").alias("at"), F.explode("runs").alias("run"))
    return out.select("key", (F.shiftleft(F.shiftright("at", 24), 12) + F.col("run")).alias("span"))


def covered(spans: list[int] | None, n: int, length: int) -> np.ndarray:
    """Which of n tokens lie in a window of the runs in ``spans``."""
    change = np.zeros(n + 1, np.int64)
    for span in spans or ():
        start, windows = span >> 12, span & 0xFFF
        change[start] += 1
        change[start + windows + length - 1] -= 1
    return np.cumsum(change[:-1]) > 0


def runs_of(repeated: np.ndarray, owner: np.ndarray, n: int) -> list[list[tuple[int, int]]]:
    """For each segment, the runs (first, number) of its windows that are marked; ``owner`` says whose each window is, in order."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    base = np.searchsorted(owner, np.arange(n))
    at = np.flatnonzero(repeated)
    if len(at):
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (np.diff(owner[at]) > 0)]))
        whose = owner[at[starts]]
        for o, first, size in zip(whose.tolist(), (at[starts] - base[whose]).tolist(), np.diff(np.append(starts, len(at))).tolist(), strict=True):
            out[o].append((first, size))
    return out


def with_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """``docs`` with ``spans``, the list of its runs or null; a document's runs are no more than its tokens."""
    return docs.join(runs.groupBy("key").agg(F.collect_list("span").alias("spans")), "key", "left")
