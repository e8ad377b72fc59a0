"""Vectorised text handling over Arrow buffers: words, 64-bit word hashes and n-gram keys without Python strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The six separators of the word pattern [^\x20\x09-\x0D]+.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_U = np.uint64
_ROOT = 0x9E3779B97F4A7C15
_BLOCK = 1 << 18


def words_lut() -> np.ndarray:
    """Bytes that belong to a word: all but the six separators."""
    lut = np.ones(256, bool)
    lut[list(SPACES)] = False
    return lut


def letters_lut(digits: bool) -> np.ndarray:
    """Bytes of ASCII letters and of all longer UTF-8 sequences, and of ASCII digits if asked for."""
    lut = np.zeros(256, bool)
    lut[ord("a") : ord("z") + 1] = lut[ord("A") : ord("Z") + 1] = lut[0x80:] = True
    if digits:
        lut[ord("0") : ord("9") + 1] = True
    return lut


def lower_lut() -> np.ndarray:
    lut = np.arange(256, dtype=np.uint8)
    lut[ord("A") : ord("Z") + 1] += 32
    return lut


def _byte_values() -> np.ndarray:
    """A fixed odd 64-bit value for each byte after A-Z are lower-cased."""
    return mix(np.arange(1, 257, dtype=_U) * _U(_ROOT))[lower_lut()] | _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each output bit depends on all input bits."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The key of two keys in this order."""
    return mix(left * _U(0xD6E8FEB86659FD93) + (right ^ _U(0xA5A5A5A5A5A5A5A5)) * _U(_ROOT))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    root, inverse = _ROOT | 1, pow(_ROOT | 1, -1, 1 << 64)
    out = []
    for r in (root, inverse):
        p = np.full(n, r, _U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Hasher:
    """Hashes of byte ranges by prefix sums of a polynomial modulo 2^64."""

    def __init__(self) -> None:
        self.values = _byte_values()
        self.up, self.down = _powers(_BLOCK + 1)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of each range, which are in order and don't overlap; A-Z count as a-z."""
        out = np.empty(len(starts), _U)
        at = 0
        while at < len(starts):
            base = int(starts[at])
            to = max(at + 1, int(np.searchsorted(ends, base + _BLOCK, side="right")))
            span = int(ends[to - 1]) - base
            if span >= len(self.up):
                self.up, self.down = _powers(span + 1)
            sums = np.empty(span + 1, _U)
            sums[0] = 0
            np.cumsum(self.values[data[base : base + span]] * self.up[:span], out=sums[1:])
            s, e = starts[at:to] - base, ends[at:to] - base
            out[at:to] = mix((sums[e] - sums[s]) * self.down[s] + (e - s).astype(_U))
            at = to
        return out


def text_chunks(column: pa.Array, max_bytes: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [a, b) of a string column with their bytes and offsets, about max_bytes at a time; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + max_bytes, side="right")) - 1)
        yield a, b, raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def word_ranges(data: np.ndarray, offsets: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row (and the end) the index of its first word; words end with their row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = lut[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)
