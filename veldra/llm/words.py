"""Words of many texts at once, as 64-bit hashes.

A word is a run of ASCII letters or digits, without regard to case. The functions
work on the UTF-8 bytes of an Arrow string column, so no Python string is made per
text or word: bytes of other characters are above 127 and end a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

# What each byte counts as in a word: 0 ends it; letters lose their case.
_FOLD = np.zeros(256, np.uint8)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _FOLD[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _FOLD[_c] = _c + 32


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            up, down = np.full(n, _P), np.full(n, _P_INV)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def string_parts(column: pa.Array, most: int = 1 << 20, rows: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of at most ``rows`` rows and about ``most`` bytes.

    Gives (first row, rows, bytes, offsets from 0). A null is an empty text; a text
    longer than ``most`` makes a run of its own.
    """
    column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        end = min(n, row + rows, max(row + 1, end))
        yield row, end - row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray = _FOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every word, index of the first word of each text and one past the last, start byte, end byte).

    ``fold`` says as what each byte counts in a word, 0 if it ends one.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none
    folded = fold[data]
    inside = folded != 0
    edge = np.zeros(n, bool)
    edge[offsets[:-1][offsets[:-1] < n]] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (edge | ~before))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:] & ~edge[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = _powers.to(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(folded * up[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets), starts, ends


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words; runs over the end of a text are to be left out by the caller."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = 1
    for j in range(k):
        factor = factor * 0xD1342543DE82EF95 % (1 << 64) | 1
        out += hashes[j : j + n] * np.uint64(factor)
    return mix(out)


def run_starts(firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index where each run of ``k`` words inside one text begins, its text)."""
    counts = np.maximum(np.diff(firsts) - k + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    return firsts[:-1][text] + np.arange(counts.sum()) - begin[text], text
