"""Vectorised words, rolling hashes and window minima over batches of texts.

A batch of texts is one byte array; every text is followed by a separator byte, so no word and
no window crosses texts.  Substring hashes are differences of one running sum: the hash of
``bytes[s:e]`` is ``(sum[e] - sum[s]) * base ** -s`` modulo 2 ** 64, then mixed.  Equal strings
have equal hashes; different ones collide with a chance of about 2 ** -64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes of text handled at once; a longer text is a batch of its own.
CHUNK_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_VALUES = np.random.RandomState(20240607).randint(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i for i < n (kept, as every batch needs them)."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for name, factor in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, factor, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (every step is a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def in_chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of at most ``limit`` bytes, or one longer text."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


class Rolling:
    """Hashes of all runs of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self._down = _power_table(n + 1)
        self._sum = np.empty(n + 1, dtype=np.uint64)
        self._sum[0] = 0
        np.cumsum(values * up[:n], out=self._sum[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[start]) * self._down[start])

    def runs(self, k: int) -> np.ndarray:
        """Hashes of the k values from each place on."""
        n = len(self._sum) - k
        return mix((self._sum[k:] - self._sum[:n]) * self._down[:n]) if n > 0 else np.empty(0, dtype=np.uint64)


class Bytes(Rolling):
    """Texts of one chunk as bytes with a running hash sum."""

    def __init__(self, texts: list[bytes], lower: bool = False, separator: bytes = b" "):
        joined = separator.join(texts) + separator
        self.data = np.frombuffer(joined, dtype=np.uint8)
        if lower:
            self.data = _LOWER[self.data]
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        super().__init__(_VALUES[self.data])


class Words(Bytes):
    """Words of one chunk: maximal runs without white space (space, 0x09-0x0D)."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        super().__init__(texts, lower)
        space = _SPACE[self.data]
        before = np.empty_like(space)
        before[0], before[1:] = True, space[:-1]
        self.word_start = np.flatnonzero(~space & before)
        self.word_end = np.flatnonzero(space & ~before)
        self.word = self.hashes(self.word_start, self.word_end)
        #: Index of the first word of every text, and behind the last.
        self.first = np.concatenate(
            (np.searchsorted(self.word_start, self.starts), [len(self.word)])).astype(np.int64)

    def shingles(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on (also those that cross texts; see ``inside``)."""
        n = len(self.word) - k + 1
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        total = np.zeros(n, dtype=np.uint64)
        for i in range(k):
            total *= _STEP
            total += self.word[i:i + n]
        return mix(total)


def as_bytes(texts: Iterable) -> list[bytes]:
    """UTF-8 of texts; null is empty."""
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t
            for t in texts]


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Least or greatest of every ``width`` consecutive values, by doubling."""
    out, span = values, 1
    while span < width:
        step = min(span, width - span)
        out = pick(out[:-step], out[step:])
        span += step
    return out


def anchors(values: np.ndarray, width: int, valid: np.ndarray) -> np.ndarray:
    """Places whose value is the least of some valid window of ``width`` values.

    ``valid`` tells for every window, by its first place, if it counts.  Equal windows choose equal
    places, as the choice looks at the values inside the window alone.
    """
    if len(values) < width:
        return np.empty(0, dtype=np.int64)
    least = np.where(valid, _sliding(values, width, np.minimum), np.uint64(0))
    padded = np.zeros(len(values) + width - 1, dtype=np.uint64)
    padded[width - 1:width - 1 + len(least)] = least
    return np.flatnonzero(_sliding(padded, width, np.maximum) == values)
