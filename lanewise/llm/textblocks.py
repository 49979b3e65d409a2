"""Words of many texts at once, on the UTF-8 bytes of a batch: starts, ends and 64-bit hashes as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_ODD = 0x9E3779B97F4A7C15
_WHOLE = 1 << 64
#: A value for each byte, A-Z as a-z; from a fixed generator, so hashes agree between machines and runs.
_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, _WHOLE, 256, dtype=np.uint64)
_LOWERED = _VALUES.copy()
_LOWERED[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[*range(0x09, 0x0E), 0x20]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, factor in enumerate((_ODD, pow(_ODD, -1, _WHOLE))):
            steps = np.full(n + n // 8, factor, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins, with the end last. Null texts are empty."""
    column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = column.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2] or b"", np.uint8)
    return (data[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(wide) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))


def mixed_bits(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``h``."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def running(data: np.ndarray, lowered: bool = True) -> np.ndarray:
    """Running sums from which the hash of any stretch follows by one subtraction; one longer than ``data``."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWERED if lowered else _VALUES)[data] * _power(len(data))[0], out=sums[1:])
    return sums


def stretch_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each stretch of bytes; equal stretches have equal hashes wherever they are."""
    return mixed_bits((sums[ends] - sums[starts]) * _power(len(sums))[1][starts])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space) and, for each text, its first word's number (end last)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[1:-1][cuts]
    ends[cuts - 1] = inside[1:-1][cuts - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word with A-Z lowered, and each text's first word's number (end last)."""
    starts, ends, first = words(data, offsets)
    return stretch_hash(running(data), starts, ends), first


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each text."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[first[1:]] - sums[first[:-1]]


def slices(column: pa.Array, most: int = 2_000_000) -> list[pa.Array]:
    """The column in consecutive parts of about ``most`` bytes, so that arrays over a part stay small; a longer text is a part."""
    offsets = text_bytes(column)[1]
    parts, start = [], 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        parts.append(column.slice(start, end - start))
        start = end
    return parts
