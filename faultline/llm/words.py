"""Words of texts and their hashes, as NumPy arrays, for code that runs inside tasks.

A word is a run of bytes outside space and 0x09-0x0D. A text is read in slices that end
between words, so besides eight bytes a word only one slice is held in work arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
#: Bytes of words that the sum below tells apart. Modulo 2^64 some longer words have equal sums
#: for every base (Thue-Morse words of 1,024 letters), so these are named by BLAKE2.
SHORT = 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(values: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits (a bijection)."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def numbers(count: int, seed: int) -> np.ndarray:
    """Reproducible 64-bit numbers."""
    start = np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + start)


BYTE_VALUES = numbers(256, 1)
BASE = int(numbers(1, 2)[0]) | 1
UNBASE = pow(BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to ``count`` of the base and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) <= count:
        steps = np.ones((2, max(count, 1 << 16) + 1), dtype=np.uint64)
        steps[0, 1:], steps[1, 1:] = BASE, UNBASE
        _powers[:] = list(np.multiply.accumulate(steps, axis=1))
    return _powers[0], _powers[1]


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions at which words start and end."""
    edges = np.ones(len(data) + 2, dtype=bool)
    np.take(SPACE, data, out=edges[1:-1])
    turns = np.flatnonzero(edges[1:] != edges[:-1])
    return turns[::2], turns[1::2]


def slices(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts a text between words into parts of about ``SLICE`` bytes."""
    begin = 0
    while len(data) - begin > SLICE:
        end = begin + SLICE
        while end < len(data):
            found = np.flatnonzero(SPACE[data[end : end + SLICE]])
            if len(found):
                end += int(found[0])
                break
            end = min(len(data), end + SLICE)
        yield begin, end
        begin = end
    yield begin, len(data)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each word of a text given as bytes."""
    parts = []
    for begin, end in slices(data):
        part = data[begin:end]
        starts, ends = spans(part)
        if not len(starts):
            continue
        up, down = powers(len(part))
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUES[part] * up[: len(part)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts])
        for i in np.flatnonzero(ends - starts > SHORT).tolist():
            name = hashlib.blake2b(part[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
            hashes[i] = int.from_bytes(name, "little")
        parts.append(hashes)
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def window_hashes(words: np.ndarray, width: int, seed: int = 3) -> np.ndarray:
    """One hash for each run of ``width`` consecutive words; none if there are fewer."""
    count = len(words) - width + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    factors = numbers(width, seed) | np.uint64(1)
    total = np.zeros(count, dtype=np.uint64)
    for i in range(width):
        total += words[i : i + count] * factors[i]
    return mix(total)


def shingle_set(data: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of word runs; a shorter text is one run, an empty one none."""
    words = word_hashes(data)
    if not len(words):
        return words
    return np.unique(window_hashes(words, min(width, len(words)), seed=3 + min(width, len(words))))


def digest(values: np.ndarray) -> bytes:
    """128-bit name of an array of hashes."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def byte_rows(column: pa.Array) -> list[np.ndarray]:
    """The UTF-8 bytes of each row of a string or binary column, without copying; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, values = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)
    ends = ends[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, np.uint8)
    rows = [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    if column.null_count:
        empty = data[:0]
        rows = [r if ok else empty for r, ok in zip(rows, column.is_valid().to_pylist(), strict=True)]
    return rows


def as_long(values: np.ndarray) -> np.ndarray:
    """Unsigned hashes as the signed numbers that Spark's long holds."""
    return np.ascontiguousarray(values).view(np.int64)


def list_column(arrays: list[np.ndarray]) -> pa.Array:
    """Arrays of 64-bit hashes as a column of lists of longs."""
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(as_long(flat)))
