"""The words of a batch of texts as arrays: hashes, lines and places, without a Python object for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from skyledger.llm.common import mixed

LONGEST = 64  # bytes of a word that are hashed with all others; longer words one by one
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a column of texts without nulls, ASCII letters in lower case.

    ``hashes`` has 64 bits of every word, text after text, ``counts`` the words of each text,
    ``breaks`` the words that are the first after a line feed.
    """

    def __init__(self, column: pa.Array):
        wide = pa.types.is_large_string(column.type)
        _, offsets, data = column.buffers()
        bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        low, high = int(bounds[0]), int(bounds[-1])
        raw = ((bytes(memoryview(data)[low:high]) if high > low else b"") + bytes(8)).lower()
        self._bounds = bounds = bounds - low
        self._points = points = np.frombuffer(raw, np.uint8)[:high - low]
        inside = (points != 32) & ((points < 9) | (points > 13))
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = bounds[1:] > bounds[:-1]  # words do not go on from one text to the next
        first[bounds[:-1][full]] = inside[bounds[:-1][full]]
        last[bounds[1:][full] - 1] = inside[bounds[1:][full] - 1]
        self._starts, self._stops = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.counts = np.diff(np.searchsorted(self._starts, bounds))
        breaks = np.unique(np.searchsorted(self._starts, np.flatnonzero(points == 10)))
        self.breaks = breaks[breaks < len(self._starts)]
        self.hashes = self._hashed(raw)

    def _hashed(self, raw: bytes) -> np.ndarray:
        starts, sizes = self._starts, self._stops - self._starts
        eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))  # the eight bytes from every place on
        out = mixed((eight[starts] & _MASKS[np.minimum(sizes, 8)]) ^ (sizes.astype(np.uint64) * _ODD))
        more = np.flatnonzero((sizes > 8) & (sizes <= LONGEST))
        for at in range(8, LONGEST, 8):
            out[more] = mixed(out[more] ^ (eight[starts[more] + at] & _MASKS[np.minimum(sizes[more] - at, 8)])) + _ODD
            more = more[sizes[more] > at + 8]
        for i in np.flatnonzero(sizes > LONGEST).tolist():
            out[i] = xxhash.xxh64_intdigest(raw[starts[i]:self._stops[i]])
        return out

    def texts(self) -> list[np.ndarray]:
        """The hashes of each text."""
        return np.split(self.hashes, np.cumsum(self.counts)[:-1]) if len(self.counts) else []

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each word starts and ends in its text, in code points."""
        inner = (self._points & 0xC0) == 0x80  # bytes that do not begin a code point
        before = np.concatenate([np.zeros(1, np.int64), np.cumsum(inner)])
        begin = np.repeat((self._bounds - before[self._bounds])[:-1], self.counts)
        return self._starts - before[self._starts] - begin, self._stops - before[self._stops] - begin
