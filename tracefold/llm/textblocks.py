"""Vectorised work on the UTF-8 bytes of many texts at once: words, word hashes, window hashes."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

if sys.platform == "linux":  # arrays of over 1 MB go back to the system once they are freed (M_MMAP_THRESHOLD)
    getattr(ctypes.CDLL(None), "mallopt", lambda *_: 0)(-3, 1 << 20)

#: Bytes of text that one numpy pass takes at a time (more only for a single longer text).
PIECE_BYTES = 1 << 20
_MULT, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags that is False within the inclusive ranges."""
    flags = np.ones(256, bool)
    for low, high in ranges:
        flags[low : high + 1] = False
    return flags


#: Words between ASCII white space; runs of ASCII letters and digits and of all bytes beyond ASCII.
NOT_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: Lower-cases A to Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def lower(body: np.ndarray) -> np.ndarray:
    """Lower-cases A to Z and the accented capitals of Latin-1 in UTF-8."""
    out = LOWER[body]
    two = np.flatnonzero((body[:-1] == 0xC3) & (body[1:] >= 0x80) & (body[1:] <= 0x9E) & (body[1:] != 0x97)) + 1
    out[two] += 0x20
    return out


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return body, at - at[0]


def pieces(offsets: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most `most` bytes each, single longer rows aside."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        yield low, high
        low = high


def words(body: np.ndarray, offsets: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the offsets of each text's words among them."""
    inside = kept[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside
    ends[:-1] &= ~ends[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _MULT)
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; kept for the next call."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), base, np.uint64)
        step[0] = 1
        have = _powers[int(base)] = np.cumprod(step)
    return have[:n]


_INVERSE = {int(b): np.uint64(pow(int(b), -1, 1 << 64)) for b in (_MULT, _STEP)}


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Polynomial hashes of the runs values[starts:ends], modulo 2 ** 64."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    return (sums[ends] - sums[starts]) * powers(_INVERSE[int(base)], len(values) + 1)[starts]


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    return prefix_hashes(body, starts, ends, ())[0]


def prefix_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    """Hashes of each word, and of its first bytes for each of `sizes` (of all of it if it is shorter), by row."""
    out = np.empty((1 + len(sizes), len(starts)), np.uint64)
    low = 0
    while low < len(starts):
        first = int(starts[low])
        high = max(low + 1, int(np.searchsorted(ends, first + PIECE_BYTES, "right")))
        last = int(ends[high - 1])
        sums = np.zeros(last - first + 1, np.uint64)
        np.cumsum(_BYTE[body[first:last]] * powers(_MULT, last - first), out=sums[1:])
        begin = starts[low:high] - first
        inverse = powers(_INVERSE[int(_MULT)], last - first + 1)[begin]
        for row, size in enumerate((None, *sizes)):
            end = ends[low:high] - first if size is None else np.minimum(ends[low:high] - first, begin + size)
            out[row, low:high] = mixed((sums[end] - sums[begin]) * inverse ^ ((end - begin).astype(np.uint64) * _STEP))
        low = high
    return out


def window_hashes(hashes: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the `length` words from each position in `at`."""
    if not len(at):
        return np.zeros(0, np.uint64)
    return mixed(spans_hash(hashes, at, at + length, _STEP) ^ np.uint64(length))


def shingles(body: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's runs of `size` words, A to Z in lower case, and the offsets of the texts among them.

    Words stand between ASCII white space; a text of fewer words, but not none, is one run.
    """
    low = LOWER[body]
    starts, ends, firsts = words(low, offsets, NOT_SPACE)
    hashes, counts = word_hashes(low, starts, ends), np.diff(firsts)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    first = np.repeat(firsts[:-1] - at[:-1], n) + np.arange(at[-1])
    length = np.repeat(np.minimum(counts, size), n)
    return mixed(spans_hash(hashes, first, first + length, _STEP) ^ length.astype(np.uint64)), at


def joined(body: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kept words of every text joined by single spaces: bytes, and each word's start and end in them.

    A text's bytes reach from its first kept word's start to its last one's end; a space that stands
    before the first kept word lies outside.
    """
    inner = np.ones(len(starts), np.int64)  # 0 for a word that stands at its text's very start
    some = firsts[:-1] < firsts[1:]
    inner[firsts[:-1][some]] = starts[firsts[:-1][some]] > offsets[:-1][some]
    if keep is None:
        keep = np.ones(len(starts), bool)
    change = np.zeros(len(body) + 1, np.int8)
    change[(starts - inner)[keep]] += 1
    change[ends[keep]] -= 1
    mask = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
    place = np.zeros(len(body) + 1, np.int64)
    np.cumsum(mask, out=place[1:])
    out = body.copy()
    out[(starts - inner)[keep & (inner > 0)]] = 0x20
    return out[mask], place[starts], place[ends]


def distinct_words(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The place of each word among the distinct ones, and those as a binary array; compared byte by byte."""
    sizes = ends - starts
    at = np.concatenate([[0], np.cumsum(sizes)])
    if len(starts) and (starts[1:] == ends[:-1]).all():
        data = body[starts[0] : ends[-1]]
    else:
        change = np.zeros(len(body) + 1, np.int8)
        change[starts] += 1
        change[ends] -= 1
        data = body[np.cumsum(change[:-1], dtype=np.int8).astype(bool)]
    packed = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = packed.dictionary_encode()
    return np.asarray(coded.indices, np.int64), coded.dictionary


def laid_out(values: np.ndarray, at: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists values[at[c]:at[c + 1]] for each code c, end to end, and the offsets of the codes in that."""
    return gathered(values, at[:-1][codes], (at[1:] - at[:-1])[codes])


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of `sizes` values from `starts` on, end to end, and their offsets in that."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])], ends


def cut(column: pa.Array, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> pa.Array:
    """Each text without the byte ranges that are its own (offsets `rows` among them), and the white space after each."""
    out: list[str | None] = column.to_pylist()
    body, offsets = flat(column)
    data = body.tobytes()
    for row in np.flatnonzero(np.diff(rows)).tolist():
        at, last, parts = int(offsets[row]), int(offsets[row + 1]), []
        for k in range(rows[row], rows[row + 1]):
            parts.append(data[at : starts[k]])
            at = int(ends[k])
            while at < last and not NOT_SPACE[body[at]]:
                at += 1
        out[row] = b"".join([*parts, data[at:last]]).decode()
    return pa.array(out, pa.string())
