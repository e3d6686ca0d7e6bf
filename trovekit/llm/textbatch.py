"""Arrow text columns as flat numpy arrays, in pieces of bounded size."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 19


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; NULL is the empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Cut a batch into pieces of about ``limit`` bytes: (row numbers, bytes, offsets).

    A row longer than ``limit`` comes in several pieces that end after a blank or
    line break where there is one, else between two characters.
    """
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        if last > first:
            lo, hi = offsets[first], offsets[last]
            yield np.arange(first, last), data[lo:hi], offsets[first : last + 1] - lo
            first = last
            continue
        at, end = int(offsets[first]), int(offsets[first + 1])
        while at < end:
            to = min(end, at + limit)
            if to < end:
                gaps = np.flatnonzero((data[at:to] == 32) | (data[at:to] == 10))
                if len(gaps):
                    to = at + int(gaps[-1]) + 1
                else:
                    while to > at + 1 and (data[to] & 0xC0) == 0x80:
                        to -= 1
            yield np.array([first]), data[at:to], np.array([0, to - at])
            at = to
        first += 1


def codepoints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets in characters); broken UTF-8 is replaced."""
    raw = data.tobytes()
    try:
        chars = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
        sizes = np.array([len(t) for t in texts], np.int64)
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        return chars, np.concatenate(([0], np.cumsum(sizes)))
    starts = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return chars, starts[offsets]


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets; empty rows give 0."""
    total = np.concatenate((np.zeros((1, *values.shape[1:]), np.float64), np.cumsum(values, axis=0, dtype=np.float64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def row_max(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Largest of the non-negative ``values`` between consecutive offsets; empty rows give 0."""
    if not len(values):
        return np.zeros(len(offsets) - 1)
    top = np.maximum.reduceat(np.append(values, 0.0), offsets[:-1])
    return np.where(offsets[1:] > offsets[:-1], top, 0.0)


@functools.cache
def _odd_numbers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return draw(256), draw(1 << 16)


def run_hash(data: np.ndarray, solid: np.ndarray, starts: np.ndarray, place: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of bytes that begins at ``starts``; bytes outside ``solid`` add nothing.

    ``place`` is a byte's position in its run.
    """
    by_byte, by_place = _odd_numbers()
    h = np.add.reduceat(np.where(solid, by_byte[data] * by_place[place & 0xFFFF], np.uint64(0)), starts)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


def byte_numbers() -> np.ndarray:
    """A random odd number for each byte."""
    return _odd_numbers()[0]
