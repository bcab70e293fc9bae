"""Polynomial hashes of byte strings and words modulo a prime, by numpy.

A hash is two polynomials modulo 2 ** 31 - 1, 62 bits together. With a base that was drawn at random after the texts were written
(:meth:`Keys.drawn`), no text can be made to collide with another on purpose. Hashes only route and order; what counts as
equal is compared by bytes or by 128 bits of a cryptographic digest.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

P = np.uint64(2**31 - 1)
#: Bytes that are worked on at once; longer texts go in parts.
PART = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


@dataclass(frozen=True)
class Keys:
    """The bases of both polynomials."""

    bases: tuple[int, int] = (1_103_515_245, 1_566_083_941)

    @staticmethod
    def drawn() -> Keys:
        return Keys(tuple(1000 + secrets.randbelow(int(P) - 2000) for _ in range(2)))


def rest(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime."""
    return x - (x // P) * P


def powers(base: int, n: int) -> np.ndarray:
    """``base ** k`` modulo the prime for k below n."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        if have is None and len(_powers) >= 4:
            _powers.clear()
        have = np.ones(1, np.uint64) if have is None else have
        while len(have) < n:
            have = np.concatenate([have, rest(have * np.uint64(pow(base, len(have), int(P))))])
        _powers[base] = have
    return have[:n]


class Sums:
    """Prefix sums of values below 2 ** 31 (an array for each polynomial), from which the hash of any span follows."""

    def __init__(self, values: tuple[np.ndarray, np.ndarray], keys: Keys):
        self.size, self.sums, self.scale = len(values[0]), [], []
        for v, base in zip(values, keys.bases, strict=True):
            s = np.zeros(self.size + 1, np.uint64)
            np.cumsum(rest(v * powers(pow(base, -1, int(P)), self.size)), out=s[1:])
            self.sums.append(rest(s))
            self.scale.append(powers(base, self.size + 1))

    def parts(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both polynomials of the values in each span, the same wherever it lies."""
        return tuple(rest((s[ends] + P - s[starts]) * p[starts]) for s, p in zip(self.sums, self.scale, strict=True))

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        a, b = self.parts(starts, ends)
        return a << np.uint64(31) | b

    def windows(self, k: int) -> np.ndarray:
        """A hash of each run of k values."""
        n = self.size - k + 1
        if n < 1:
            return np.zeros(0, np.uint64)
        a, b = (rest((s[k:] + P - s[:n]) * p[:n]) for s, p in zip(self.sums, self.scale, strict=True))
        return a << np.uint64(31) | b


def byte_values(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    v = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
    return v, v


def _parts(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """``raw`` in parts that end before white space, with their starts."""
    at = 0
    while len(raw) - at > PART:
        end = at + PART
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        yield at, raw[at:end]
        at = end
    yield at, raw[at:]


def word_spans(raw: bytes, keys: Keys = Keys()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word (a maximal run of bytes other than 9 to 13 and 32)."""
    found = []
    for at, part in _parts(raw):
        inside = np.zeros(len(part) + 2, np.int8)
        inside[1:-1] = ~_SPACE[np.frombuffer(part, np.uint8)]
        edges = np.diff(inside)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        found.append((Sums(byte_values(part), keys).spans(starts, ends), starts + at, ends + at))
    return found[0] if len(found) == 1 else tuple(np.concatenate(x) for x in zip(*found, strict=True))
