"""Words of Arrow text columns as numpy arrays: spans and 64-bit Karp-Rabin hashes, without Python objects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
P = 0x9E3779B97F4A7C15 | 1
P_INV = pow(P, -1, 1 << 64)
#: Bytes of text worked on at once; a longer single text is worked on alone.
SLICE = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters and digits of ASCII, and all of UTF-8's other bytes.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, SLICE)
        for name, base in (("up", P), ("down", P_INV)):
            a = np.full(size, U(base))
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"][:n], _powers["down"][:n]


def slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts are SLICE bytes at most, or one row."""
    size = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    start, total = 0, 0
    for i, n in enumerate(size):
        if total and (total + n > SLICE or i - start >= 16000):
            yield start, i
            start, total = i, 0
        total += int(n)
    if len(size) > start:
        yield start, len(size)


class Words:
    """Words of some texts in order: doc (row), start and end (bytes in data), hash. first: index of each text's first word; count: its number of words."""

    def __init__(self, column: pa.Array, word: np.ndarray | None = None):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.data = LOWER[data]
        inside = ~SPACE[data] if word is None else word[data]
        edge = self.offsets[:-1]
        edge = edge[edge < len(data)]
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        before[edge] = False
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        after[edge[edge > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        n = len(self.offsets) - 1
        self.count = np.bincount(self.doc, minlength=n)
        self.first = np.cumsum(self.count) - self.count
        up, down = powers(len(data))
        total = np.zeros(len(data) + 1, U)
        np.cumsum((self.data.astype(U) + U(1)) * up, out=total[1:])
        self.hash = mixed((total[self.end] - total[self.start]) * (down[self.start] if len(self.start) else down[:0]))

    def windows(self, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of every window of k words; short: of all words of a text that has fewer, too."""
        n = len(self.hash)
        doc = np.concatenate([self.doc, np.full(k, -1)])
        whole = doc[k - 1 : n + k - 1] == self.doc
        keep = np.flatnonzero(whole | (short & (np.arange(n) == self.first[self.doc]) & (self.count[self.doc] < k)))
        h = np.concatenate([self.hash, np.zeros(k, U)])
        out = np.zeros(len(keep), U)
        for j in range(k):
            same = doc[keep + j] == self.doc[keep]
            out += np.where(same, h[keep + j], U(0)) * U(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64))
        return keep, mixed(out)


def text_of(words: Words, i: int) -> str:
    return words.data[words.start[i] : words.end[i]].tobytes().decode("utf-8", "replace")
