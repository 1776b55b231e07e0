"""Words and n-grams of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Texts are taken together up to so many bytes; a longer text is taken alone.
CHUNK_BYTES = 1 << 20


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``first row, end row, bytes, ends`` of consecutive texts; null texts are empty."""
    column = column.fill_null("") if column.null_count else column
    wide = column.cast(pa.large_string())
    offsets = np.frombuffer(wide.buffers()[1], np.int64, len(wide) + 1, wide.offset * 8)
    data = wide.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(wide):
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = max(end, first + 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values, one to one."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def blanks(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALL = np.uint64(2**64 - 1)


def _sub_keys(key: int) -> list[np.uint64]:
    return [mixed(np.array([(key + i * int(BASE)) % 2**64], np.uint64))[0] for i in range(3)]


def words(data: np.ndarray, ends: np.ndarray, lower: bool = False, key: int = 0):
    """``hash, text number, start, end`` of the words between white-space bytes.

    A word is hashed in lanes of eight bytes: each is mixed with the key and its place, then the
    lanes are summed and mixed with the length. Who does not know the key, which is drawn anew for every
    run, cannot write down words with equal hashes.
    """
    blank = blanks(data)
    inside = np.concatenate([[False], ~blank, [False]])
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge) & np.append(~blank, False))
    stop = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    if not len(start):
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, empty
    size = stop - start
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:-8] = _LOWER[data] if lower else data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    n_lanes = (size + 7) >> 3
    first = np.cumsum(n_lanes) - n_lanes
    word = np.repeat(np.arange(len(start)), n_lanes)
    nth = np.arange(len(word)) - first[word]
    left = np.minimum(size[word] - 8 * nth, 8).astype(np.uint64)
    lanes = eight[start[word] + 8 * nth] & (_ALL >> (np.uint64(64) - np.uint64(8) * left))
    with_key, with_place, with_size = _sub_keys(key)
    lanes = mixed((lanes ^ with_key) + (nth.astype(np.uint64) + np.uint64(1)) * (with_place | np.uint64(1)))
    h = mixed(np.add.reduceat(lanes, first) ^ (size.astype(np.uint64) * BASE + with_size))
    return h, np.searchsorted(ends, start, "right") - 1, start, stop


def grams(values: np.ndarray, size: int, key: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` values, put together from runs of powers of two."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = np.uint64((int(BASE) + 2 * int(_sub_keys(key)[0])) % 2**64)
    out, done, block, width, power = None, 0, values, 1, base
    while True:
        if size & width:
            out = block if out is None else out[: len(block) - done] * power + block[done:]
            done += width
        if done == size:
            return mixed(out[:n])
        block = block[:-width] * power + block[width:]
        width *= 2
        power = np.uint64(int(power) * int(power) & (1 << 64) - 1)


def sliding(best, values: np.ndarray, width: int) -> np.ndarray:
    """``best`` (minimum or maximum) of each ``width`` consecutive values."""
    out, have = values, 1
    while have * 2 <= width:
        out = best(out[:-have], out[have:])
        have *= 2
    if width > have:
        out = best(out[: len(out) - (width - have)], out[width - have :])
    return out
