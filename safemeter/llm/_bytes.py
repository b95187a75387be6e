"""Vectorised work on the UTF-8 bytes of Arrow string columns (numpy, inside tasks).

Texts are handled in runs of whole documents of about ``RUN_BYTES`` bytes, so that
memory stays bounded whatever the batch holds; one longer text is a run of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 1 << 18
#: Places hashed together: their arrays stay in the processor's cache.
_CHUNK = 1 << 15

#: Bytes that end a word: space and \t \n \v \f \r.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII letters, digits and every byte of a non-ASCII character.
WORDY = np.zeros(256, bool)
WORDY[np.r_[0x30:0x3A, 0x61:0x7B, 0x80:0x100]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


#: Longer ranges are digested one by one.
_LONG = 256
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def eights(data: np.ndarray) -> np.ndarray:
    """At each place the eight bytes from there on as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


class ByteHash:
    """64-bit hashes of byte ranges: eight bytes at a time are put into a state that is scrambled each time.

    Unlike sums of powers, no pattern of bytes makes two ranges collide more often than chance does.
    """

    def __init__(self, seed: int):
        self.start = mix(np.array([2 * seed + 1], np.uint64))[0]
        self.key = hashlib.sha256(str(seed).encode()).digest()[:16]

    def ranges(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of ``data[start : end]`` for each pair."""
        size, word = end - start, eights(data)
        x = mix(size.astype(np.uint64) ^ self.start)
        todo, done = np.flatnonzero((size > 0) & (size <= _LONG)), 0
        while len(todo):
            left = size[todo] - done
            x[todo] = mix(x[todo] ^ (word[start[todo] + done] & _TAIL[np.minimum(left, 8)]))
            todo, done = todo[left > 8], done + 8
        for k in np.flatnonzero(size > _LONG).tolist():
            x[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8, key=self.key).digest(), "little")
        return x

    def at(self, data: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of ``data[p : p + size]`` for each place; ``size`` is 8 at least."""
        word, steps = eights(data), [*range(0, size - 8, 8), size - 8]
        one, two = np.empty(len(places), np.uint64), np.empty(len(places), np.uint64)
        for k in range(0, len(places), _CHUNK):
            p = places[k : k + _CHUNK]
            a, b = np.full(len(p), self.start), np.full(len(p), ~self.start)
            for step in steps:
                m = mix(word[p + step] ^ a)
                b = (b ^ m) * _MIX_A
                b ^= b >> np.uint64(29)
                a = m
            one[k : k + _CHUNK], two[k : k + _CHUNK] = a, b
        return one, mix(two)


def runs(texts: pa.Array, limit: int = RUN_BYTES, rows: int = 1 << 16) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole texts, ``rows`` of them at most; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if n == 0:
        return
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        j = min(j, n, i + rows)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (maximal runs of ``inside`` bytes in one text), and each text's first word index."""
    n = len(data)
    m = np.zeros(n + 2, bool)
    m[1:-1] = inside[data]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    starts = np.flatnonzero(m[1:-1] & (~m[:-2] | cut[:-1]))
    ends = np.flatnonzero(m[1:-1] & (~m[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def windows(values: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hash of ``values[i : i + size]`` for every i; the last ``size - 1`` are not meaningful."""
    out = np.full(len(values), seed * 64 + size, np.uint64)
    for k in range(size):
        out[: len(values) - k or None] ^= values[k:]
        out = mix(out)
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
