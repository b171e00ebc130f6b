"""Words of whole texts as NumPy arrays, straight from Arrow buffers.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``.  As those six are ASCII, the same runs result whether a
text is cut as UTF-8 bytes or as code points.  A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
BLOCK_BYTES = 1 << 20
_CHUNK = 1 << 19

U64 = np.uint64
#: Multipliers of the polynomial hashes; any odd numbers do.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, _CHUNK + 64)
        up, down = np.full(size, base, U64), np.full(size, pow(base, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 1 << 22:
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Block:
    """Some texts: ``data`` their bytes, ``bounds`` the n + 1 offsets, ``start``/``end`` of each word, ``first`` the n + 1 offsets into the words."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds
        solid = ~SPACE[data]
        begin = solid.copy()
        begin[1:] &= ~solid[:-1]
        stop = solid.copy()
        stop[:-1] &= ~solid[1:]
        edge = bounds[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        begin[edge] = solid[edge]
        stop[edge - 1] = solid[edge - 1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, bounds)

    def __len__(self) -> int:
        return len(self.bounds) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()

    def sums(self, mask: np.ndarray) -> np.ndarray:
        """Per text, how many bytes the mask marks."""
        c = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return c[self.bounds[1:]] - c[self.bounds[:-1]]

    def word_hashes(self, base: int = BASES[0], lower: bool = False) -> np.ndarray:
        return self.span_hashes(self.start, self.end, base, lower)

    def span_hashes(self, start: np.ndarray, end: np.ndarray, base: int = BASES[0], lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each byte span; spans ascend.  Works through the bytes in chunks, so memory follows the spans."""
        out, a = np.empty(len(start), U64), 0
        while a < len(start):
            b = max(a + 1, int(np.searchsorted(end, start[a] + _CHUNK, "right")))
            lo, hi = int(start[a]), int(end[b - 1])
            x = self.data[lo:hi]
            if lower:
                x = np.where((x >= 65) & (x <= 90), x | 32, x)
            up, down = powers(base, hi - lo + 1)
            p = np.empty(hi - lo + 1, U64)
            p[0] = 0
            np.cumsum((x.astype(U64) + U64(1)) * up[: hi - lo], out=p[1:])
            s, e = start[a:b] - lo, end[a:b] - lo
            out[a:b] = (p[e] - p[s]) * down[s] + (e - s).astype(U64) * U64(BASES[2])
            a = b
        return mix(out)


def grams(h: np.ndarray, n: int, base: int = BASES[1]) -> np.ndarray:
    """A hash of each n consecutive word hashes; those that cross a text's end must be left out by the caller."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, U64)
    if n <= 8:
        out = np.zeros(m, U64)
        for j in range(n):
            out = out * U64(base) + h[j : j + m]
        return mix(out)
    out, step = np.empty(m, U64), 1 << 19
    for a in range(0, m, step):
        b = min(m, a + step)
        up, down = powers(base, b - a + n)
        p = np.concatenate((np.zeros(1, U64), np.cumsum(h[a : b + n - 1] * up[: b - a + n - 1])))
        out[a:b] = (p[n : n + b - a] - p[: b - a]) * down[: b - a]
    return mix(out)


def whole(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the n-word windows that lie in one text, and the n_texts + 1 offsets into them."""
    per = np.maximum(np.diff(first) - n + 1, 0)
    off = np.concatenate(([0], np.cumsum(per)))
    at = np.repeat(first[:-1] - off[:-1], per) + np.arange(off[-1])
    return at, off


def blocks(texts: pa.Array | pa.ChunkedArray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    """(from row, to row, Block) for stretches of about ``most`` bytes; a longer text is a block by itself."""
    for part in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        part = part.cast(pa.large_string()).fill_null("")
        off = np.frombuffer(part.buffers()[1], np.int64, len(part) + 1, part.offset * 8) if len(part) else np.zeros(1, np.int64)
        body = np.frombuffer(part.buffers()[2] or b"", np.uint8)
        a = 0
        while a < len(part):
            b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
            yield a, b, Block(body[off[a] : off[b]], off[a : b + 1] - off[a])
            a = b
