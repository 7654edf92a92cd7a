"""Words and hashes of whole Arrow batches at once, on the UTF-8 bytes.

Texts of a batch lie one after the other in one buffer. Words are found and hashed there with a few
numpy passes, so no Python object is made for a word. A block is at most `BLOCK` bytes of whole
texts (one longer text is a block of its own), which bounds the memory a pass needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 21
SPACES = bytes([0x20, *range(0x09, 0x0E)])


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = np.array(x, np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTE = stream(256, 1)
_PLACE = stream(4096, 2) | np.uint64(1)


def _places(n: int) -> np.ndarray:
    global _PLACE
    if n > len(_PLACE):
        _PLACE = stream(max(n, 2 * len(_PLACE)), 2) | np.uint64(1)
    return _PLACE


def separators(kind: str) -> np.ndarray:
    """For each byte whether it parts words: `spaces`, or all ASCII but letters and digits (`marks`)."""
    out = np.zeros(256, bool)
    if kind == "spaces":
        out[list(SPACES)] = True
    else:
        out[:128] = [not chr(c).isalnum() for c in range(128)]
    return out


@dataclass
class Words:
    """Words of several texts: byte positions, the text each belongs to, hashes."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    bounds: np.ndarray  # bounds[i]:bounds[i + 1] are the words of text i
    inside: np.ndarray  # for each byte whether it is part of a word

    def hashes(self, longest: int | None = None, last: bool = False) -> np.ndarray:
        """64-bit hash of each word, or of its first (`last`: final) `longest` bytes."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        start, length = self.start, self.end - self.start
        if longest is not None:
            length = np.minimum(length, longest)
            if last:
                start = self.end - length
        first = np.cumsum(length) - length
        place = np.arange(int(length.sum()), dtype=np.int32) - np.repeat(first.astype(np.int32), length)
        byte = self.data[self.inside] if longest is None else self.data[np.repeat(start, length) + place]
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(_BYTE[byte] * _places(int(length.max()))[place], first)
            return mixed(sums + length.astype(np.uint64))


def words_of(data: np.ndarray, offsets: np.ndarray, part: np.ndarray) -> Words:
    """Words of the texts `data[offsets[i]:offsets[i + 1]]`; `part` marks separating bytes."""
    low, high = int(offsets[0]), int(offsets[-1])
    data, offsets = data[low:high], offsets - low
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~part[data]
    step = np.diff(inside)
    # A text that ends without a separator still ends its last word.
    seam = offsets[1:-1]
    seam = np.unique(seam[(seam > 0) & (seam < len(data))])
    seam = seam[(inside[seam] == 1) & (inside[seam + 1] == 1)]
    start = np.sort(np.concatenate([np.flatnonzero(step == 1), seam]))
    end = np.sort(np.concatenate([np.flatnonzero(step == -1), seam]))
    bounds = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    return Words(data, start, end, doc, bounds, inside[1:-1].view(bool))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each text begins."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def blocks(column: pa.Array | pa.ChunkedArray, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, offsets) of runs of texts of about `size` bytes."""
    data, offsets = utf8(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data, offsets[first : last + 1]
        first = last


def rolled(words: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Rabin-Karp hash of every run of k words: the polynomial in `base` modulo 2^64.

    h(i, k) = sum of words[i + j] * base^(k - 1 - j), built by joining runs of half the length.
    """
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out, have, run, size = None, 0, words, 1
        while True:
            if k & size:
                out = run if out is None else out[: len(words) - have - size + 1] * np.uint64(pow(base, size, 1 << 64)) + run[have:]
                have += size
            if have == k:
                return out[:n]
            run = run[: len(run) - size] * np.uint64(pow(base, size, 1 << 64)) + run[size:]
            size *= 2
