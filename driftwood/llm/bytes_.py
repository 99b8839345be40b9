"""Vectorised views of text columns, for use inside tasks.

A batch of texts is one byte array with offsets. Words and lines are spans of
it; a polynomial prefix sum gives the hash of any span, so that no Python
object is made per word. Hashes only nominate candidates or count shingles;
what decides is compared exactly by the operators.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time (one larger text is worked on alone).
SLICE = 1 << 20

_BYTE = np.arange(256)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
LOWER = np.where(_UPPER, _BYTE + 32, _BYTE).astype(np.uint8)
#: Word characters [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z became a-z; all others are single bytes.
WORD = ((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((LOWER >= 0x61) & (LOWER <= 0x7A)) | (_BYTE >= 0x80)
#: White space [\x20\x09-\x0D].
SPACE = (_BYTE == 0x20) | ((_BYTE >= 0x09) & (_BYTE <= 0x0D))
_WEIGHT = LOWER.astype(np.uint64) + np.uint64(1)

_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse for the bytes of a slice (16 MB in all, however long texts are)."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(SLICE + 1, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads the bits of each value over all places."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about SLICE bytes of text, each with its bytes and offsets."""
    for batch in batches:
        data, off = texts(batch.column(column))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(off, off[at] + SLICE, "right")) - 1)
            yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


class Spans:
    """Spans [start, end) of a byte array, in order, with the first span of each text."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> None:
        self.data, self.starts, self.ends, self.first = data, starts, ends, first

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A hash of each span's bytes with A-Z lower-cased. Works on runs of spans of SLICE bytes, so a long text takes no more memory."""
        out, at = np.empty(len(self.starts), np.uint64), 0
        while at < len(out):
            base = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, base + SLICE, "right")))
            if self.ends[at] - base > SLICE:
                out[at] = self._long(int(base), int(self.ends[at]))
                at += 1
                continue
            total, down = self._sums(base, self.ends[to - 1]), _powers()[1]
            out[at:to] = (total[self.ends[at:to] - base] - total[self.starts[at:to] - base]) * down[self.starts[at:to] - base]
            at = to
        return mix(out)

    def _sums(self, a: int, b: int) -> np.ndarray:
        """Sums of byte weights times powers of the base, over [a, a), [a, a + 1) ... [a, b)."""
        total = np.zeros(b - a + 1, np.uint64)
        weighted = _WEIGHT[self.data[a:b]]
        weighted *= _powers()[0][: b - a]
        np.cumsum(weighted, out=total[1:])
        return total

    def _long(self, a: int, b: int) -> np.uint64:
        """The sum of one span of more than SLICE bytes, slice by slice."""
        total, scale, step = 0, 1, pow(_BASE, SLICE, 1 << 64)
        for x in range(a, b, SLICE):
            total += scale * int(self._sums(x, min(x + SLICE, b))[-1])
            scale = scale * step % (1 << 64)
        return np.uint64(total % (1 << 64))

    def lowered(self, i: int) -> bytes:
        return LOWER[self.data[self.starts[i] : self.ends[i]]].tobytes()


def words(data: np.ndarray, off: np.ndarray) -> Spans:
    """The words of each text."""
    n = len(data)
    inside = WORD[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[off[:-1][off[:-1] < n]] = False
    after[off[1:][off[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Spans(data, starts, ends, np.searchsorted(starts, off))


def lines(data: np.ndarray, off: np.ndarray) -> Spans:
    """The lines of each text, split at \\n; an empty text has one empty line."""
    breaks = np.flatnonzero(data == 10)
    counts = np.diff(np.searchsorted(breaks, off)) + 1
    first = np.concatenate([[0], np.cumsum(counts)])
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    is_first, is_last = np.zeros(first[-1], bool), np.zeros(first[-1], bool)
    is_first[first[:-1]] = is_last[first[1:] - 1] = True
    starts[is_first], starts[~is_first] = off[:-1], breaks + 1
    ends[is_last], ends[~is_last] = off[1:], breaks
    return Spans(data, starts, ends, first)


def stripped(spans: Spans) -> Spans:
    """The spans without white space at both ends."""
    space = SPACE[spans.data]
    edge = np.diff(space.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    run, run_end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # runs of white space
    starts, ends = spans.starts.copy(), spans.ends.copy()
    if len(run):
        i = np.searchsorted(run, starts, "right") - 1
        led = (i >= 0) & (run_end[i] > starts)
        starts[led] = np.minimum(run_end[i[led]], ends[led])
        i = np.searchsorted(run, ends, "left") - 1
        trailed = (i >= 0) & (run_end[i] >= ends)
        ends[trailed] = np.maximum(run[i[trailed]], starts[trailed])
    return Spans(spans.data, starts, ends, spans.first)


def grams(word: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words; the i-th starts at word i (the caller drops those that leave a text)."""
    n = max(0, len(word) - k + 1)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total *= np.uint64(0xD6E8FEB86659FD93)
        total += word[i : i + n]
    return mix(total + np.uint64(k))


def owners(first: np.ndarray) -> np.ndarray:
    """The text of each span."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
