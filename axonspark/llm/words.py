"""Vectorised word, shingle and n-gram hashing over Arrow string columns.

A word is a maximal run of bytes other than ``\\x20 \\x09-\\x0D``; A-Z may be
folded to lower case. A word is hashed by blocks of eight bytes, each finalised
with its place before they are added up, so that no pattern of bytes cancels out.
Nothing is per word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Texts are hashed in slices of about this many bytes (one longer text is a slice of its own).
SLICE_BYTES = 1 << 21
#: Where the places of blocks start to be numbered, for the hash and for a second, independent one.
_FROM, _FROM2 = np.array([0x9E3779B97F4A7C15], U64), np.array([0xD1B54A32D192ED03], U64)
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that part words of letters and digits alone: all of ASCII's others.
MARKS = np.ones(256, dtype=bool)
MARKS[128:] = MARKS[48:58] = MARKS[65:91] = MARKS[97:123] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def slices(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of consecutive slices of about SLICE_BYTES each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(ends, ends[at] + SLICE_BYTES, side="right")) - 1
        to = min(max(to, at + 1), len(column))
        yield at, column.slice(at, to - at)
        at = to


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row boundaries) of a large_string slice; null is empty."""
    n = len(column)
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1].copy()
    if column.null_count:
        column = column.fill_null("")
        ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1].copy()
    data = column.buffers()[2]
    body = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return body, ends - ends[0]


def spaces(body: np.ndarray) -> np.ndarray:
    """Whether each byte is white space."""
    return _SPACE[body]


def spans(body: np.ndarray, ends: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words before each row boundary) of all words of a slice; ``space`` says of each byte whether it parts words."""
    n = len(body)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    word = ~space[body]
    cut = np.zeros(n + 1, dtype=bool)
    cut[ends] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = word[:-1]
    start = np.flatnonzero(word & (~before | cut[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = word[1:]
    end = np.flatnonzero(word & (~after | cut[1:])) + 1
    return start, end, np.searchsorted(start, ends)


def values(body: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = True) -> pa.LargeBinaryArray:
    """The words themselves, for exact comparison."""
    upto = np.concatenate([[0], np.cumsum(end - start)])
    inside = np.zeros(len(body) + 1, np.int8)
    inside[start] += 1
    inside[end] -= 1
    data = body[np.cumsum(inside[:-1], dtype=np.int8).view(bool)] if len(body) else body
    data = _FOLD[data] if fold else np.ascontiguousarray(data)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(upto), pa.py_buffer(data)])


def hashes(body: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = True, second: bool = False) -> np.ndarray:
    """64-bit hash of each span of bytes, or the ``second``, independent one."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    data = np.concatenate([_FOLD[body] if fold else body, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(body) + 1, "<u8", data, strides=(1,))  # the eight bytes from each place on
    size = end - start
    first = _FROM2 if second else _FROM
    total = mix((eight[start] & _TAIL[np.minimum(size, 8)]) ^ mix(first))
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) >> 3  # blocks after the first
        upto = np.cumsum(more)
        k = np.arange(upto[-1]) - np.repeat(upto - more, more) + 1
        at = np.repeat(start[long], more) + 8 * k
        block = eight[at] & _TAIL[np.minimum(np.repeat(end[long], more) - at, 8)]
        total[long] += np.add.reduceat(mix(block ^ mix(first + k.astype(np.uint64))), upto - more)
    return mix(total + size.astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def grams(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words inside each row, and the grams before each row boundary.

    A row of fewer words (but at least one) gives its whole sequence as one gram.
    """
    count = np.diff(first)
    made = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    out_first = np.concatenate([[0], np.cumsum(made)])
    if not out_first[-1]:
        return np.zeros(0, np.uint64), out_first
    row = np.repeat(np.arange(len(count)), made)
    at = first[:-1][row] + (np.arange(out_first[-1]) - out_first[:-1][row])
    left = np.minimum(count[row], size)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    h = left.astype(np.uint64)
    for k in range(size):
        w = np.where(k < left, padded[at + k], U64(0))
        h = h * U64(0xD6E8FEB86659FD93) + w
        h = h ^ (h >> U64(29))
    return mix(h), out_first


def row_sets(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, and the boundaries."""
    values = values.copy()
    for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        values[i:j].sort()
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = values[1:] != values[:-1]
    fresh[first[:-1][first[:-1] < first[1:]]] = True
    return values[fresh], np.concatenate([[0], np.cumsum(fresh)])[first]


def shingle_sets(column: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles of ``size`` lower-cased words (hashed, ascending), and the boundaries."""
    body, ends = raw(column)
    start, end, first = spans(body, ends)
    return row_sets(*grams(hashes(body, start, end), first, size))
