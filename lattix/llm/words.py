"""Words of many whole texts at once, as arrays: bounds, and 64-bit hashes of any byte ranges.

A range's hash is a polynomial in an odd base over random values of its bytes, from prefix sums modulo 2**64, so a word
costs a few array operations and no Python object. About 30 bytes of memory a byte of text, for `GROUP` bytes at a time
(or for one text that is longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import mix

GROUP = 1 << 21
_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


class Words:
    """The words of several texts: first and last bytes, the text each is in, and where each text's words begin."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts)
        self.bytes = b = np.frombuffer(self.data, np.uint8)
        edge = np.ones(len(b) + 2, np.int8)
        edge[1:-1] = _SPACE[b]
        edge = np.diff(edge)
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.starts, offsets)  # words of text i: first[i] to first[i + 1]
        self._sums: np.ndarray | None = None

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of the ranges from starts to ends."""
        n = len(self.bytes)
        power, inverse = _power(n + 1)
        if self._sums is None:
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_VALUES[self.bytes] * power[:n], dtype=np.uint64, out=self._sums[1:])
        return mix((self._sums[ends] - self._sums[starts]) * inverse[starts])


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of so many words."""
    if width < 1 or len(hashes) < width:
        return np.empty(0, np.uint64)
    out = np.full(len(hashes) - width + 1, width, np.uint64)
    for j in range(width):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(_BASE) + hashes[j : j + len(out)]
    return mix(out)


def groups(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    """The texts in groups of about GROUP bytes, each with its first position; a null text is an empty one."""
    at, group, size = 0, [], 0
    for i, t in enumerate(texts):
        if group and size + len(t or b"") > GROUP:
            yield at, group
            at, group, size = i, [], 0
        group.append(t or b"")
        size += len(t or b"")
    if group:
        yield at, group


def shingles(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """For each whole text its distinct n-word shingles as sorted hashes; ASCII letters are lowered, words end at ASCII white space, fewer than n words are one shingle."""
    out = []
    for _, group in groups(texts):
        w = Words([t.lower() for t in group])
        h = w.hashes(w.starts, w.ends)
        runs = windows(h, n)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
            s = np.sort(runs[a : b - n + 1]) if b - a >= n else windows(h[a:b], b - a)
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s)
    return out
