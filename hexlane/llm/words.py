"""Word and n-gram hashes of whole batches of texts at once, in numpy inside a Spark task.

A word is a maximal run of bytes other than space and \\x09-\\x0D. Its hash is a polynomial over its bytes
(wrapping 64-bit arithmetic, scrambled); an n-gram's hash is a polynomial over its word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BYTE_BASE, WORD_BASE, CHECK_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
SLICE_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, U)
            p[0] = 1
            out.append(np.cumprod(p, dtype=U))
        have = _powers[base] = (out[0], out[1])
    return have[0][:n], have[1][:n]


class Words:
    """Words of consecutive texts: doc (index of the text), start and end (byte offsets), hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.n_docs = len(offsets) - 1
        if lower:
            data = data + (((data >= 65) & (data <= 90)) * np.uint8(32))
        self.data = data
        n = len(data)
        gap = (data == 32) | ((data >= 9) & (data <= 13))
        first = np.ones(n + 1, bool)
        first[1:n] = gap[: n - 1]
        first[offsets[:-1][offsets[:-1] < n]] = True
        last = np.ones(n, bool)
        last[: n - 1] = gap[1:] if n else gap
        last[offsets[1:-1][(offsets[1:-1] > 0)] - 1] = True
        self.start = np.flatnonzero(first[:n] & ~gap)
        self.end = np.flatnonzero(last & ~gap) + 1
        up, down = powers(BYTE_BASE, n + 1)
        total = np.zeros(n + 1, U)
        np.cumsum((data.astype(U) + U(1)) * up[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start])
        self.count = np.diff(np.searchsorted(self.start, offsets))
        self.doc = np.repeat(np.arange(self.n_docs), self.count)
        self.first = np.concatenate(([0], np.cumsum(self.count)))

    def __len__(self) -> int:
        return len(self.start)

    def grams(self, k: int, base: int = WORD_BASE) -> np.ndarray:
        """Hash of the k words from each position; positions whose k words leave the text hold unrelated values."""
        n = len(self)
        if n < k:
            return np.zeros(0, U)
        up, down = powers(base, n + 1)
        total = np.zeros(n + 1, U)
        np.cumsum(self.hash * up[:n], out=total[1:])
        return mix((total[k:] - total[:-k]) * down[: n - k + 1] + U(k))

    def whole(self, k: int) -> np.ndarray:
        """Positions whose k words lie in one text."""
        n = len(self)
        return np.flatnonzero(self.doc[k - 1 :] == self.doc[: n - k + 1]) if n >= k else np.zeros(0, np.int64)


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, offsets) of runs of texts of about so many bytes; null counts as empty, a long text stays whole."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        to = min(to, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
