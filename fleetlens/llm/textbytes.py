"""Numpy work on the UTF-8 bytes of Arrow batches: documents one after another in a byte array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from fleetlens.llm.common import shipped

#: Documents are taken together up to so many bytes; a longer one stands alone.
PIECE_BYTES = 2 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input moves every bit of the output."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def constants(seed: int, n: int) -> np.ndarray:
    """``n`` odd 64-bit numbers that depend on the seed alone."""
    return mixed(np.arange(1, n + 1, dtype=U) * U(_BASE) + U(seed)) | U(1)


def pieces(column: pa.Array | pa.ChunkedArray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of a string column without nulls, in pieces of ``most`` bytes."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(array)
    if n == 0:
        return
    wide = pa.types.is_large_string(array.type)
    offsets = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


class Powers:
    """Powers of the base and of its inverse, kept by a worker and made longer when a piece needs it."""

    up = np.ones(1, U)
    down = np.ones(1, U)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, PIECE_BYTES + 1)
            for name, factor in (("up", _BASE), ("down", _INVERSE)):
                p = np.full(size, U(factor))
                p[0] = 1
                setattr(cls, name, np.multiply.accumulate(p))
        return cls.up[:n], cls.down[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Sums of value[i] * base**i before each place. ``span_hash`` reads the hash of any span from it."""
    up, _ = Powers.of(len(values))
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * up, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal for equal spans, wherever they stand."""
    _, down = Powers.of(len(prefix))
    return mixed((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U) * U(_BASE))


shipped(__name__)
