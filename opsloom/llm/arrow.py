"""Small helpers for functions that run on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes worked on at once. A longer single text is one piece of its own.
PIECE_BYTES = 500_000


def text_pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into row ranges of bounded size.

    Yields (first row, end row, bytes of the range, offset of each row in them);
    a null text has no bytes.
    """
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets_buffer, data = column.buffers()
    offsets = np.frombuffer(offsets_buffer, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(max(high, low + 1), n)
        yield low, high, raw[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
        low = high


def ragged(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array from flat values and the length of each row."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of many ranges, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values, ascending, by sorting (``np.unique`` may hash, which is slower on whole numbers)."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that every bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_STRETCH = 1 << 17


class SpanHasher:
    """Hashes of many spans of one array by prefix sums of a polynomial."""

    def __init__(self, multiplier: int):
        self.m = multiplier | 1
        self.inverse = pow(self.m, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) >= n:
            return
        size = max(n, 2 * len(self.up))
        with np.errstate(over="ignore"):
            for name, m in (("up", self.m), ("down", self.inverse)):
                table = np.full(size, m, np.uint64)
                table[0] = 1
                setattr(self, name, np.multiply.accumulate(table))

    def __call__(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of symbols[starts[i]:ends[i]]; starts and ends ascend."""
        out = np.zeros(len(starts), np.uint64)
        low = 0
        while low < len(starts):      # a stretch of symbols at a time, so that tables stay small
            base = int(starts[low])
            high = max(low + 1, int(np.searchsorted(starts, base + _STRETCH)))
            part = symbols[base:int(ends[high - 1])]
            self._grow(len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            with np.errstate(over="ignore"):
                np.cumsum((part.astype(np.uint64) + np.uint64(1)) * self.up[:len(part)], out=sums[1:])
                begin = starts[low:high] - base
                out[low:high] = mix((sums[ends[low:high] - base] - sums[begin]) * self.down[begin])
            low = high
        return out
