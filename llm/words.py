"""Words of whole texts as 64-bit hashes, computed for many documents at once.

A word is a maximal run of bytes outside space and 0x09-0x0D. These are single bytes in UTF-8, so
words can be found without decoding. A word's hash is a polynomial over random byte values,
computed with one multiplication per byte and finished by a bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the base, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 1024), _BASE, dtype=np.uint64)
        grown[0] = 1
        _powers = np.cumprod(grown, dtype=np.uint64)
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher: each input bit reaches all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _block_words(data: np.ndarray, fold_case: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and end byte of each word in ``data``; both ends count as white space."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_IS_SPACE[data]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.empty(0, dtype=np.uint64), starts, ends
    values = _BYTE_VALUES[_LOWER[data] if fold_case else data]
    place = np.arange(len(data)) - np.repeat(
        np.append(0, starts), np.diff(np.concatenate(([0], starts, [len(data)])))
    )
    longest = int((ends - starts).max())
    values *= powers(longest)[np.minimum(place, longest - 1)]
    values[_IS_SPACE[data]] = 0
    return mix(np.add.reduceat(values, starts)), starts, ends


def text_words(
    data: np.ndarray, fold_case: bool = True
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of one text of any length, in blocks that end at white space."""
    if len(data) <= BLOCK_BYTES:
        return _block_words(data, fold_case)
    found, at = [], 0
    while at < len(data):
        end = min(at + BLOCK_BYTES, len(data))
        while end < len(data):
            spaces = np.flatnonzero(_IS_SPACE[data[end - 4096 if end - 4096 > at else at : end]])
            if len(spaces):
                end = (end - 4096 if end - 4096 > at else at) + int(spaces[-1]) + 1
                break
            end = min(end + BLOCK_BYTES, len(data))
        hashes, starts, ends = _block_words(data[at:end], fold_case)
        found.append((hashes, starts + at, ends + at))
        at = end
    return tuple(np.concatenate(parts) for parts in zip(*found, strict=True))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a text column, without copying; a null has no bytes."""
    column = column.cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[
        column.offset : column.offset + len(column) + 1
    ]
    if column.null_count:
        column = column.fill_null("")
        return utf8(column)
    return offsets, np.frombuffer(data or b"", dtype=np.uint8)


def batch_words(
    column: pa.Array, fold_case: bool = True
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Words of a column of texts in blocks of neighbouring rows, of bounded size.

    Yields (first row, word counts by row, hashes, first bytes, end bytes); byte positions are
    relative to the start of the row's text.
    """
    if not len(column):
        return
    offsets, data = utf8(column)
    row = 0
    while row < len(column):
        last = max(
            row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, side="right")) - 1
        )
        last = min(last, len(column))
        if last == row + 1:
            hashes, starts, ends = text_words(data[offsets[row] : offsets[last]], fold_case)
            yield row, np.array([len(hashes)]), hashes, starts, ends
        else:
            # One space after each text keeps words of neighbours apart.
            lengths = np.diff(offsets[row : last + 1])
            joined = np.full(int(lengths.sum()) + len(lengths), 0x20, dtype=np.uint8)
            begins = offsets[row:last] - offsets[row] + np.arange(last - row)
            place = np.arange(int(lengths.sum())) + np.repeat(np.arange(last - row), lengths)
            joined[place] = data[offsets[row] : offsets[last]]
            hashes, starts, ends = _block_words(joined, fold_case)
            bounds = np.searchsorted(starts, np.append(begins, len(joined)))
            counts = np.diff(bounds)
            shift = np.repeat(begins, counts)
            yield row, counts, hashes, starts - shift, ends - shift
        row = last


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; of all words together if they are fewer."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(width, n)
    total = np.zeros(n - width + 1, dtype=np.uint64)
    for i in range(width):
        total = mix(total * _BASE + hashes[i : n - width + 1 + i] + np.uint64(width))
    return total


def distinct_shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    return np.unique(shingles(hashes, width))


# --- characters that are surely no white space -----------------------------------------------
# Solid are the visible characters of ASCII and those that begin with the byte 0xC3 in UTF-8 (letters
# of Latin-1, and two signs).

_VISIBLE = np.zeros(256, dtype=bool)
_VISIBLE[33:127] = True


def solid(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte, whether a solid character ends with it, and whether one begins with it."""
    visible, first = _VISIBLE[codes], codes == 0xC3
    ends = visible.copy()
    ends[1:] |= first[:-1]
    return ends, visible | first


def begins_solid(data: bytes, at: int) -> bool:
    return 32 < data[at] < 127 or data[at] == 0xC3


def ends_solid(data: bytes) -> bool:
    return 32 < data[-1] < 127 or data[-2] == 0xC3
