"""Winnowing over word sequences: shared by decontamination, substring dedup, near-duplicate blocks and license scans.

Words are found and hashed in whole arrays of bytes, without a Python object a word. A document's k-grams of words are
hashed; of each run of ``w`` neighbouring k-grams (a span of ``k + w - 1`` words) the least hash is kept, the last one on
ties. The choice depends on the span's words alone, so two texts that share such a span keep the same anchor in it.
"""

from __future__ import annotations

import numpy as np

#: Bytes that part words where nothing else is asked for: blank and 9 to 13, as ``bytes.split`` has it.
BLANKS = bytes([9, 10, 11, 12, 13, 32])
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes that are hashed in one go (more only where a single word is longer): 40 bytes of arrays each.
CHUNK = 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_series: list[np.ndarray] = []


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _series or len(_series[0]) < n:
        size = max(n, CHUNK + 4096)
        _series[:] = [powers(_BASE, size), powers(_INVERSE, size)]
    return _series[0][:n], _series[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def stretches(h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of the numbers from each start to each stop, by sums of a power series modulo 2^64; not mixed.

    Starts ascend. Pieces of the array are summed one by one, so that the series stays short.
    """
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + CHUNK // 2)))
        low, high = int(start[i]), int(stop[i:j].max())
        up, down = _powers_to(high - low + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h[low:high] * up[:-1], dtype=np.uint64)))
        x = start[i:j] - low
        out[i:j] = (sums[stop[i:j] - low] - sums[x]) * down[x]
        i = j
    return out


class Words:
    """The words of several texts, laid end to end.

    ``h``: a 64-bit hash a word; ``at``, ``stop``: where it is in ``data``; ``first``, ``count``: each text's words;
    ``owner``: each word's text. ``table`` translates bytes first; what it makes a blank parts words.
    """

    def __init__(self, texts: list[bytes], table: bytes | None = None) -> None:
        data = b" ".join(texts)
        self.data = data.translate(table) if table is not None else data
        a = np.frombuffer(self.data, np.uint8)
        inside = np.ones(256, np.int8)
        inside[list(BLANKS)] = 0
        edge = np.flatnonzero(np.diff(inside[a], prepend=np.int8(0), append=np.int8(0)))
        self.at, self.stop = edge[::2], edge[1::2]
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        seats = np.searchsorted(self.at, begins)
        self.first, self.count = seats[:-1], np.diff(seats)
        self.h = np.empty(len(self.at), np.uint64)
        i = 0
        while i < len(self.at):
            begin = int(self.at[i])
            j = max(i + 1, int(np.searchsorted(self.stop, begin + CHUNK, "right")))
            some = a[begin : int(self.stop[j - 1])].astype(np.uint64) + np.uint64(1)
            x, y = self.at[i:j] - begin, self.stop[i:j] - begin
            self.h[i:j] = mix(stretches(some, x, y) + (y - x).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            i = j

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    @property
    def ends(self) -> np.ndarray:
        """For each word, where its text's words end."""
        return np.repeat(self.first + self.count, self.count)

    def words(self, start: int, stop: int) -> list[bytes]:
        return [self.data[x:y] for x, y in zip(self.at[start:stop].tolist(), self.stop[start:stop].tolist())]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Hashes of words that hold no blank."""
    return Words([b" ".join(words)]).h


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; too short an array gives none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = np.full(n, k, np.uint64)
    for j in range(k):
        g *= np.uint64(_BASE)
        g += h[j : j + n]
    return mix(g)


def _least(g: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours, by doubling."""
    n, size, m = len(g) - w + 1, 1, g
    while 2 * size <= w:
        m = np.minimum(m[: len(m) - size], m[size:])
        size *= 2
    return np.minimum(m[:n], m[w - size : w - size + n])


def anchors(h: np.ndarray, ends: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of several documents whose word hashes are laid end to end; ``ends``: where each word's document ends.

    Returns for each anchor its position, its hash, the first span that keeps it and the number of such spans, which
    are neighbours. A document of fewer than ``k + w - 1`` words has none.
    """
    g = grams(h, k)
    n = len(h) - (k + w - 1) + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, g[:0], z, z
    least, step = _least(g, w), np.zeros(n, np.int8)
    for j in range(1, w):
        np.copyto(step, np.int8(j), where=g[j : j + n] == least)
    spans = np.flatnonzero(np.arange(k + w - 1, n + k + w - 1) <= ends[:n])
    at = spans + step[spans]
    # spans of one anchor are neighbours: a change of anchor or a gap begins another run
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (spans[1:] != spans[:-1] + 1))) if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate((first, [len(at)])))
    return at[first], g[at[first]], spans[first], size
