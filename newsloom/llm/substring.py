"""Substring removal by suffix trees over groups of suffixes.

Suffixes are the word sequences that start at the windows of :mod:`newsloom.llm.repeats` and end with their segment. Spark deals them to
groups by a prefix of variable length: the words of their anchor, and where a group would be too large for memory, as many words around
it as make it small enough. In a group, the suffix array comes from prefix doubling over numbered words (exact, without hashes), the
lengths of common prefixes of neighbours from the same ranks, and the tree's internal nodes are the intervals of that array. Below a
node as deep as a window, suffixes start with a maximal repeat. Words that no repeated window covers are kept.

* Null text counts as empty: no words, nothing removed. Texts shorter than a window keep all words.
* Very long texts are worked on in overlapping parts, without loss. Equal rows repeat each other and lose all covered words.
* Words of over 64 bytes are compared by their SHA-256, so the memory that a group takes doesn't depend on them.
* A text that repeats itself loses both places. An empty table gives an empty table. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from newsloom.llm.common import batch_map
from newsloom.llm.hashing import Keys, Sums, byte_values
from newsloom.llm.repeats import Group, covered, keyed_documents, repeated_windows, runs_of, with_runs

LENGTH = 35
SEED = 6
LONG_WORD = 64


def _short(word: bytes) -> bytes:
    return b"\0" + hashlib.sha256(word).hexdigest().encode() if len(word) > LONG_WORD or word.startswith(b"\0") else word


@dataclass(frozen=True)
class Words:
    """Texts as words that one space separates."""

    length: int = LENGTH
    seed: int = SEED

    def read(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        words = raw.split()
        if b"\0" in raw or (words and max(map(len, words)) > LONG_WORD):
            words = [_short(w) for w in words]
        return self.read_cut(b" ".join(words))

    def read_cut(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        ends = np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) == 32), len(raw)) if raw else np.zeros(0, np.int64)
        return raw, np.concatenate([[0], ends + 1])

    def count(self, doc: tuple[bytes, np.ndarray]) -> int:
        return len(doc[1]) - 1

    def cut(self, doc: tuple[bytes, np.ndarray], first: int, end: int) -> bytes:
        return doc[0][doc[1][first] : doc[1][end] - 1]

    def values(self, doc: tuple[bytes, np.ndarray], first: int, end: int, keys: Keys) -> tuple[np.ndarray, np.ndarray]:
        edges = doc[1][first : end + 1] - doc[1][first]
        return Sums(byte_values(self.cut(doc, first, end)), keys).parts(edges[:-1], edges[1:] - 1)


def suffix_ranks(words: np.ndarray, most: int) -> list[np.ndarray]:
    """The rank of each place by the 1, 2, 4 ... words from there, up to ``most`` of them; what is past the end ranks least."""
    ranks, width = [np.unique(words, return_inverse=True)[1] + 1], 1
    while width < most:
        after = np.concatenate([ranks[-1][width:], np.zeros(min(width, len(words)), np.int64)])
        ranks.append(np.unique(ranks[-1] * (len(words) + 1) + after, return_inverse=True)[1] + 1)
        width *= 2
    return ranks


def suffix_tree(words: np.ndarray, starts: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Suffixes at ``starts`` in order, the length of each one's longest repeat, and the top internal nodes as deep as ``least``.

    A node is its depth and its first and last leaf in that order. No suffix has more than ``most`` words in common with another.
    """
    ranks = suffix_ranks(words, most)
    order = starts[np.argsort(ranks[-1][starts], kind="stable")]
    a, b, depth = order[:-1].copy(), order[1:].copy(), np.zeros(max(len(order) - 1, 0), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        inside = (a < len(words)) & (b < len(words))
        same = np.zeros(len(a), bool)
        same[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
        depth += same * (1 << k)
        a, b = a + same * (1 << k), b + same * (1 << k)
    longest = np.maximum(np.concatenate([[0], depth]), np.concatenate([depth, [0]]))
    deep = np.concatenate([[0], (depth >= least).view(np.int8), [0]])
    edges = np.flatnonzero(np.diff(deep)).reshape(-1, 2)
    return order, longest, [(int(depth[x:y].min()), int(x), int(y)) for x, y in edges]


def tree_engine(length: int):
    """Runs of windows of each segment that start below a deep internal node."""

    def find(group: Group) -> list[list[tuple[int, int]]]:
        number: dict[bytes, int] = {}
        words, sizes = [], []
        for k, t in enumerate(group.texts):
            own = t.split(b" ")
            sizes.append(len(own) + 1)
            words += [number.setdefault(w, len(number)) for w in own]
            words.append(-1 - k)  # no common prefix goes beyond the end of a segment
        base = np.cumsum(sizes) - sizes
        starts = np.repeat(base, group.windows) + np.concatenate([np.arange(n) for n in group.windows])
        order, longest, nodes = suffix_tree(np.array(words), starts, length, max(sizes))
        repeated = np.zeros(len(words), bool)
        for _, a, b in nodes:
            repeated[order[a : b + 1]] = True
        return runs_of(repeated[starts], np.repeat(np.arange(len(sizes)), group.windows), len(sizes))

    return find


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """id, n_words, n_removed, kept_text (the kept words joined by a space) and removed (pairs of first word and number of words)."""
    keyed = keyed_documents(docs, id_column, text)
    runs = repeated_windows(keyed, Words(length, min(SEED, length)), tree_engine(length))

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("n_words", "n_removed", "kept_text", "removed")}
        for t, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            words = t.encode().split()
            gone = covered(spans, len(words), length)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if len(edges) else words
            for c, v in zip(out, (len(words), int(gone.sum()), b" ".join(kept).decode(), [[int(a), int(b - a)] for a, b in edges.reshape(-1, 2)]), strict=True):
                out[c].append(v)
        return {"id": batch.column("id")} | out

    schema = "id long, n_words long, n_removed long, kept_text string, removed array<array<long>>"
    return batch_map(with_runs(keyed, runs), ["id", "text", "spans"], run, schema).withColumnRenamed("id", id_column)
