"""Suffix-array removal of repeated byte strings, by a hash-compared suffix sort.

Suffixes begin at the windows of :mod:`newsloom.llm.repeats` and end with their segment. In a group they are sorted by content in a
mergesort. Two suffixes are compared by the length of what they have in common: prefix polynomial hashes modulo a prime and
binary search find it in logarithmically many steps. All neighbours in that order are then compared byte by byte, and a group in which hashes
have misled is sorted again by its bytes, so collisions change nothing. Only the first window of each run of candidates (windows whose
hash occurs twice) and another place of that window are sorted; a common part longer than a window settles the windows after it, and
what is left of a run goes round again.

* Null text counts as empty. Texts shorter than a window lose nothing.
* Matches don't cross documents. Very long texts are worked on in overlapping parts, without loss. Equal rows repeat each other.
* A text that repeats itself loses both places. An empty table gives an empty table. Other columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from newsloom.llm.common import batch_map
from newsloom.llm.hashing import Keys, Sums, byte_values
from newsloom.llm.repeats import Group, covered, keyed_documents, repeated_windows, runs_of, with_runs

LENGTH = 200
SEED = 40


@dataclass(frozen=True)
class Bytes:
    """Texts as bytes."""

    length: int = LENGTH
    seed: int = SEED

    def read(self, raw: bytes) -> bytes:
        return raw

    read_cut = read

    def count(self, doc: bytes) -> int:
        return len(doc)

    def cut(self, doc: bytes, first: int, end: int) -> bytes:
        return doc[first:end]

    def values(self, doc: bytes, first: int, end: int, keys: Keys) -> tuple[np.ndarray, np.ndarray]:
        return byte_values(doc[first:end])


class Suffixes:
    """Suffixes of some strings laid end to end; each ends with its string."""

    def __init__(self, raw: bytes, keys: Keys):
        self.data, self.hashes = np.frombuffer(raw, np.uint8), Sums(byte_values(raw), keys)

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes at a and b have in common, ``most`` at most, by the hashes of their prefixes."""
        lo, hi = np.zeros(len(a), np.int64), most.copy()
        while len(k := np.flatnonzero(lo < hi)):
            mid = (lo[k] + hi[k] + 1) >> 1
            same = self.hashes.spans(a[k], a[k] + mid) == self.hashes.spans(b[k], b[k] + mid)
            lo[k] = np.where(same, mid, lo[k])
            hi[k] = np.where(same, hi[k], mid - 1)
        return lo

    def ordered(self, a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the suffixes at a and b have n bytes in common, no more, and stand in order, by the bytes themselves."""
        x, y = end_a - a, end_b - b
        last = len(self.data) - 1
        p, q = self.data[np.minimum(a + n, last)].astype(np.int64), self.data[np.minimum(b + n, last)].astype(np.int64)
        return _checked(self.data, a, b, n) & (np.where(n < x, p, -1) < np.where(n < y, q, -1) + ((n == x) & (n == y)))

    def less(self, a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether the suffix at a sorts before that at b; ``ties`` where they are equal."""
        most = np.minimum(end_a - a, end_b - b)
        n = self.common(a, b, most)
        inside = n < most
        last = len(self.data) - 1
        x, y = self.data[np.minimum(a + n, last)], self.data[np.minimum(b + n, last)]
        size = (end_a - a) - (end_b - b)
        return np.where(inside, x < y, np.where(size == 0, ties, size < 0))


def sort_suffixes(s: Suffixes, start: np.ndarray, end: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order of suffixes, each group (numbered, in order) apart, by mergesort; a merge finds each suffix's place in the other run by binary search."""
    order = np.arange(len(start))
    base = np.searchsorted(group, group)
    size = np.searchsorted(group, group, side="right") - base
    place, width = order - base, 1
    while len(live := np.flatnonzero(size > width)):
        at, first, n = place[live], base[live], size[live]
        run = at // width
        other = np.where(run % 2 == 0, run + 1, run - 1) * width
        lo, hi = np.minimum(other, n), np.minimum(other + width, n)
        begin, mine, left = lo.copy(), order[live], run % 2 == 0
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) >> 1
            that, this = order[first[open_] + mid], mine[open_]
            before = s.less(start[that], start[this], end[that], end[this], ~left[open_])
            lo[open_] = np.where(before, mid + 1, lo[open_])
            hi[open_] = np.where(before, hi[open_], mid)
        merged = first + (run // 2) * 2 * width + at % width + (lo - begin)
        order[merged] = mine
        width *= 2
    return order


def sort_plainly(s: Suffixes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The order of suffixes by comparing their bytes."""
    return np.array(sorted(range(len(start)), key=lambda k: s.data[start[k] : end[k]].tobytes()), np.int64)


def plain_common(s: Suffixes, a: int, b: int, most: int) -> int:
    wrong = np.flatnonzero(s.data[a : a + most] != s.data[b : b + most])
    return int(wrong[0]) if len(wrong) else most


def sorted_neighbours(s: Suffixes, start: np.ndarray, end: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes, each group apart, and how many bytes each has in common with the next one of its group (else 0).

    Every pair of neighbours is compared byte by byte; a group in which hashes have misled is sorted again without them.
    """
    order = sort_suffixes(s, start, end, group)
    a, b = order[:-1], order[1:]
    n = s.common(start[a], start[b], np.minimum(end[a] - start[a], end[b] - start[b])) * (group[a] == group[b])
    right = s.ordered(start[a], start[b], end[a], end[b], n) | (group[a] != group[b])
    for g in np.unique(group[a[~right]]):
        at = np.flatnonzero(group[order] == g)
        order[at] = own = order[at][sort_plainly(s, start[order[at]], end[order[at]])]
        for k, x, y in zip(at, own, own[1:], strict=False):
            n[k] = plain_common(s, start[x], start[y], min(end[x] - start[x], end[y] - start[y]))
    return order, n


def sort_engine(length: int):
    """Runs of windows of each segment that occur elsewhere, by a suffix sort."""
    keys = Keys.drawn()

    def find(group: Group) -> list[list[tuple[int, int]]]:
        s = Suffixes(b"".join(group.texts), keys)
        sizes = np.array([len(t) for t in group.texts])
        owner = np.repeat(np.arange(len(sizes)), group.windows)
        first = np.repeat(np.cumsum(sizes) - sizes, group.windows) + np.concatenate([np.arange(n) for n in group.windows])
        end, anchor = np.cumsum(sizes)[owner], group.anchors[owner]
        h = s.hashes.windows(length)[first]
        by_hash = np.lexsort((h, anchor))
        equal = (np.diff(h[by_hash]) == 0) & (np.diff(anchor[by_hash]) == 0)
        partner = np.full(len(h), -1)
        partner[by_hash[:-1][equal]] = by_hash[1:][equal]
        back = by_hash[1:][equal]
        partner[back] = np.where(partner[back] < 0, by_hash[:-1][equal], partner[back])
        open_, repeated = partner >= 0, np.zeros(len(h), bool)
        while open_.any():
            heads = np.flatnonzero(open_ & ~np.concatenate([[False], open_[:-1] & (owner[1:] == owner[:-1])]))
            chosen = np.union1d(heads, partner[heads])
            chosen = chosen[np.argsort(anchor[chosen], kind="stable")]
            order, n = sorted_neighbours(s, first[chosen], end[chosen], anchor[chosen])
            reach = np.zeros(len(h), np.int64)
            for a in (chosen[order[:-1]], chosen[order[1:]]):
                np.maximum.at(reach, a, n - length + 1)
            hit = heads[reach[heads] > 0]
            change = np.zeros(len(h) + 1, np.int64)
            np.add.at(change, hit, 1)
            np.add.at(change, hit + reach[hit], -1)
            new = np.cumsum(change[:-1]) > 0
            repeated |= new
            open_ &= ~new
            open_[heads] = False
        return runs_of(repeated, owner, len(sizes))

    return find


def _checked(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether n bytes from a and b are the same, byte by byte."""
    total = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(total, n)
    wrong = data[np.repeat(a, n) + place] != data[np.repeat(b, n) + place]
    return np.bincount(np.repeat(np.arange(len(n)), n), wrong, len(n)) == 0


def whole_characters(raw: bytes, gone: np.ndarray) -> str:
    """The text that is left if only characters of which all bytes are gone go."""
    data = np.frombuffer(raw, np.uint8)
    first = np.flatnonzero((data & 0xC0) != 0x80)
    left = np.add.reduceat((~gone).astype(np.int64), first) > 0
    return data[np.repeat(left, np.diff(np.append(first, len(data))))].tobytes().decode()


def remove_repeated_bytes(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, carry: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, kept (the remaining bytes) and removed (pairs of first byte and number of bytes).

    With ``carry``: all other columns of the input as ``row``, n_removed, and ``kept_text``, the text without the characters of which all bytes went.
    """
    keyed = keyed_documents(docs, id_column, text, carry)
    runs = repeated_windows(keyed.select("key", "text"), Bytes(length, min(SEED, length)), sort_engine(length))

    def cut(t: str, spans: list[int] | None) -> tuple[bytes, np.ndarray]:
        raw = t.encode()
        return raw, covered(spans, len(raw), length) if spans else np.zeros(len(raw), bool)

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "kept", "removed")}
        for t, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
            raw, gone = cut(t.as_py(), spans)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if len(edges) else raw
            for c, v in zip(out, (len(raw), int(gone.sum()), kept, [[int(a), int(b - a)] for a, b in edges.reshape(-1, 2)]), strict=True):
                out[c].append(v)
        return {"id": batch.column("id")} | out

    def run_carried(batch: pa.RecordBatch) -> dict:
        n, kept = [], []
        for t, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
            raw, gone = cut(t.as_py(), spans)
            n.append(int(gone.sum()))
            kept.append(whole_characters(raw, gone) if n[-1] else t.as_py())
        return {"row": batch.column("row"), "n_removed": n, "kept_text": kept}

    joined = with_runs(keyed, runs)
    if carry:
        fields = [joined.schema["row"], T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]
        return batch_map(joined, ["row", "text", "spans"], run_carried, T.StructType(fields))
    schema = "id long, n_bytes long, n_removed long, kept binary, removed array<array<long>>"
    return batch_map(joined, ["id", "text", "spans"], run, schema).withColumnRenamed("id", id_column)
