"""Periodic runs of words: longest previous factors, LZ blocks, Main's boundary extensions and copied runs.

A run is a maximal stretch of words with a smallest period q that is at least so
many periods long. All documents of a slice of text are worked on at once, by
arrays; a word counts as another one in another document, so nothing reaches
across.

1. Suffixes are ranked by prefix doubling, and the ranks of every length 2**k
   are kept: two places agree on 2**k words if their ranks of that length do, so
   that common extensions to the right and to the left are exact and logarithmic.
2. Suffix array and LCP give the longest previous factor of each place: the
   smallest LCP on the way to the nearest suffixes above and below that begin earlier.
3. Hops over them give LZ blocks: the longest earlier factor, or a new word.
4. A run that touches a boundary ``b`` between the blocks ``v`` and ``u`` and
   ends in ``u`` has a period under |v| + |u|, as ``v`` and the word after it
   don't occur earlier. So the extensions of b against b + p and b - p find it.
5. Any other run lies inside a block, so it is a copy of one in the block's
   earlier occurrence: runs are put into buckets by start, and each block copies
   those of its source, in order.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axonspark.llm import words, worker
from axonspark.llm.names import unused
from axonspark.llm.scratch import whole_texts

#: Pairs of boundary and period that are looked at together.
PAIRS = 1 << 21


class Ranks:
    """Ranks of all suffixes by their first 1, 2, 4, ... words until all differ. ``symbols`` differ between documents; ``stop`` is each place's end of document."""

    def __init__(self, symbols: np.ndarray, stop: np.ndarray):
        n = len(symbols)
        self.n, self.stop = n, stop
        order = np.argsort(symbols, kind="stable")
        sorted_ = symbols[order]
        fresh = np.ones(n, bool)
        fresh[1:] = sorted_[1:] != sorted_[:-1]
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0)).astype(np.int32)  # the place of a group's first
        self.levels = [rank]
        last = np.append(fresh[1:], True)
        open_ = order[~(fresh & last)]  # in order of rank
        step = 1
        while len(open_):
            ahead = open_ + step
            second = np.where(ahead < stop[open_], rank[np.minimum(ahead, n - 1)] + 1, 0)
            key = rank[open_].astype(np.int64) << 32 | second
            by = np.argsort(key, kind="stable")
            open_, key = open_[by], key[by]
            group = np.ones(len(open_), bool)
            group[1:] = key[1:] >> 32 != key[:-1] >> 32
            fresh = np.ones(len(open_), bool)
            fresh[1:] = key[1:] != key[:-1]
            at = np.arange(len(open_))
            begins = np.maximum.accumulate(np.where(group, at, 0))
            rank = rank.copy()
            rank[open_] = ((key >> 32) + np.maximum.accumulate(np.where(fresh, at, 0)) - begins).astype(np.int32)
            self.levels.append(rank)
            last = np.append(fresh[1:], True)
            open_ = open_[~(fresh & last)]
            step *= 2

    def suffixes(self) -> np.ndarray:
        out = np.empty(self.n, np.int64)
        out[self.levels[-1]] = np.arange(self.n)
        return out

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree from ``i`` and ``j`` on; places at the end of a document agree on none."""
        out, i, j = np.zeros(len(i), np.int64), i.astype(np.int64), j.astype(np.int64)
        top = self.n - 1
        limit = self.stop[np.minimum(i, top)]
        for k in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[k]
            same = (i < limit) & (j < limit) & (rank[np.minimum(i, top)] == rank[np.minimum(j, top)])
            step = same.astype(np.int64) << k
            out, i, j = out + step, i + step, j + step
        return out

    def left(self, i: np.ndarray, j: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """How many words agree from ``i`` and ``j`` on to the left, in documents that ``begin`` there."""
        out, i, j = np.zeros(len(i), np.int64), i.astype(np.int64), j.astype(np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank, a, b = self.levels[k], i - (1 << k) + 1, j - (1 << k) + 1
            same = (a >= begin) & (b >= begin) & (rank[np.maximum(a, 0)] == rank[np.maximum(b, 0)])
            step = same.astype(np.int64) << k
            out, i, j = out + step, i - step, j - step
        return out


def previous_factors(suffixes: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each place: the longest factor from there that also begins earlier, and where.

    The nearest smaller entry on either side is found by jumps from candidate to
    candidate, all at once, with the smallest LCP that a jump passes over; where
    that is 0 nothing further on can agree.
    """
    n = len(suffixes)
    best, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    for forth in (True, False):
        place = suffixes if forth else suffixes[::-1]
        low = lcp.copy() if forth else np.append(lcp[1:], 0)[::-1].copy()  # LCP with the entry before, in this direction
        to = np.arange(n, dtype=np.int32) - 1
        active = np.flatnonzero(low).astype(np.int32)  # the first entry's LCP is 0
        active = active[place[active - 1] > place[active]]
        while len(active):
            over = to[active]
            least, now = np.minimum(low[active], low[over]), to[over]
            low[active], to[active] = least, now
            on = least > 0
            active, now = active[on], now[on]
            active = active[place[now] > place[active]]
        here = np.empty(n, np.int64)
        here[place] = low
        from_ = np.empty(n, np.int64)
        from_[place] = place[np.maximum(to, 0)]
        better = here > best
        best[better], source[better] = here[better], from_[better]
    return best, source


def blocks(factor: np.ndarray) -> np.ndarray:
    """The starts of the LZ blocks of all documents."""
    out, i, hop = [], 0, np.maximum(factor, 1).tolist()
    while i < len(hop):
        out.append(i)
        i += hop[i]
    return np.array(out, np.int64)


def _ranges(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, 1..size[k]) of all k."""
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + 1


def runs(symbols: np.ndarray, first: np.ndarray, least: int = 2, times: int = 2) -> np.ndarray:
    """All runs of at least ``least`` words and ``times`` (2 or more) periods, as rows (start, end, period) in that order; document k has the places first[k] to first[k + 1]."""
    none = np.zeros((0, 3), np.int64)
    n = len(symbols)
    if not n:
        return none
    size = np.diff(first)
    begin, stop = np.repeat(first[:-1], size), np.repeat(first[1:], size)
    ranks = Ranks(symbols, stop)
    order = ranks.suffixes()
    lcp = np.zeros(n, np.int64)
    lcp[1:] = np.where(symbols[order[1:]] == symbols[order[:-1]], ranks.right(order[1:], order[:-1]), 0)
    factor, source = previous_factors(order, lcp)
    starts = blocks(factor)
    ends = np.append(starts[1:], n)
    # boundaries: each block's start but the first of a document, and each document's end
    inner = np.flatnonzero(starts != begin[starts])
    closing = np.flatnonzero(ends == stop[starts])
    b = np.concatenate([starts[inner], ends[closing]])
    before = np.concatenate([starts[inner] - starts[inner - 1], ends[closing] - starts[closing]])
    after = np.concatenate([ends[inner] - starts[inner], np.zeros(len(closing), np.int64)])
    head = np.concatenate([begin[starts[inner]], begin[starts[closing]]])
    tail = np.concatenate([stop[starts[inner]], stop[starts[closing]]])
    top = (before + np.maximum(after, 1) - 1) // (times - 1)
    # a run is extended by so many words at least, half of them on one side: ranks of that length rule most pairs out
    periods = np.arange(1, max(least, 2))
    shortest = int(min(np.maximum((times - 1) * periods, least - periods).min(), (times - 1) * len(periods) + times - 1))
    level = min(max((shortest + 1) // 2, 1).bit_length() - 1, len(ranks.levels) - 1)
    rank, width = ranks.levels[level], 1 << level
    found = [none]
    for side in (1, -1):
        most = np.minimum(top, after if side == 1 else b - head)
        done = 0
        upto = np.cumsum(most)
        while done < len(most):
            to = max(int(np.searchsorted(upto, (upto[done - 1] if done else 0) + PAIRS, side="right")), done + 1)
            k, p = _ranges(most[done:to])
            k += done
            done = to
            i, j = (b[k], b[k] + p) if side == 1 else (b[k] - p, b[k])
            ahead = (j < tail[k]) & (rank[np.minimum(i, n - 1)] == rank[np.minimum(j, n - 1)])
            back = (i - width >= head[k]) & (rank[np.maximum(i - width, 0)] == rank[np.maximum(j - width, 0)])
            k, p, i, j = (x[ahead | back] for x in (k, p, i, j))
            if not len(k):
                continue
            fore = np.where(j < tail[k], ranks.right(i, np.minimum(j, tail[k] - 1)), 0)
            aft = ranks.left(i - 1, j - 1, head[k])
            ok = (fore + aft >= (times - 1) * p) & (fore + aft + p >= least)
            found.append(np.stack([(i - aft)[ok], (j + fore)[ok], p[ok]], axis=1))
    got = np.concatenate(found)
    got = got[np.lexsort(got.T[::-1])]
    fresh = np.ones(len(got), bool)  # of one stretch the smallest period
    fresh[1:] = (got[1:, :2] != got[:-1, :2]).any(axis=1)
    return _copied(got[fresh], starts, ends, source, max(least, times))


def _copied(got: np.ndarray, starts: np.ndarray, ends: np.ndarray, source: np.ndarray, least: int) -> np.ndarray:
    """``got`` and the runs inside blocks: each block copies those strictly inside its earlier occurrence, by buckets of starts in order."""
    if not len(got):
        return got
    bucket: dict[int, list[tuple[int, int]]] = {}
    for s, e, p in got.tolist():
        bucket.setdefault(s, []).append((e, p))
    filled = sorted(bucket)
    known = {tuple(r) for r in got.tolist()}
    for k in np.flatnonzero(ends - starts >= least + 2).tolist():
        b, e, q = int(starts[k]), int(ends[k]), int(source[starts[k]])
        shift, at = b - q, bisect_right(filled, q)
        while at < len(filled) and filled[at] < q + e - b:
            s = filled[at]
            for end, p in list(bucket[s]):
                if end < q + e - b and (s + shift, end + shift, p) not in known:
                    known.add((s + shift, end + shift, p))
                    if s + shift not in bucket:
                        bucket[s + shift] = []
                        insort(filled, s + shift)
                    bucket[s + shift].append((end + shift, p))
            at += 1
    return np.array(sorted(known), np.int64)


Rewrite = Callable[[object, int], "tuple[int, int] | None"]


def scan(column: pa.Array, ids: list, least: int, times: int, rewrite: Rewrite | None) -> Iterator[tuple[list[tuple[int, int, int]], str]]:
    """Of each text of a slice: its runs (start, length, period) and the words outside their repetitions, joined by spaces."""
    body, ends = words.raw(column)
    start, end, first = words.spans(body, ends)
    at = np.arange(len(start))
    for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        loop = rewrite(ids[k], b - a) if rewrite and b > a else None
        if loop:
            at[a + loop[0] : b] = a + loop[0] + np.arange(b - a - loop[0]) % loop[1]
    word = words.values(body, start, end, fold=False).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[at] if len(start) else at
    row = np.repeat(np.arange(len(column)), np.diff(first))
    found = runs(row << 32 | word, first, least, times)
    gone = np.zeros(len(at) + 1, np.int64)
    np.add.at(gone, found[:, 0] + found[:, 2], 1)
    np.add.at(gone, found[:, 1], -1)
    kept = np.cumsum(gone[:-1]) == 0
    left, of = at[kept], row[kept]
    # the kept words' bytes, each with one byte more for the space after it
    size = end[left] - start[left] + 1
    upto = np.cumsum(size)
    total = int(upto[-1]) if len(upto) else 0
    padded = np.append(body, np.uint8(32))
    text = padded[np.repeat(start[left] - upto + size, size) + np.arange(total)] if total else padded[:0]
    text[upto - 1] = 32
    cut = np.concatenate([[0], upto])[np.searchsorted(of, np.arange(len(column) + 1))]
    whose = row[found[:, 0]]
    inside = np.searchsorted(whose, np.arange(len(column) + 1)).tolist()
    for k in range(len(column)):
        mine = found[inside[k] : inside[k + 1]]
        yield [(s - int(first[k]), e - s, p) for s, e, p in mine.tolist()], text[cut[k] : max(cut[k + 1] - 1, cut[k])].tobytes().decode("utf-8")


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, exactly; ties to the smallest start, then period."""
    return min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def periodic_runs(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = 24, times: int = 3, rewrite: Rewrite | None = None, carry: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` (its columns ``carry``, or all) with runs, strongest and collapsed.

    Words are stretches other than white space, numbered from 0. A run is a
    stretch with smallest period q that no neighbour extends, of at least
    ``least`` words and ``times`` periods; runs holds all (start, length,
    period) in that order, strongest the one of the greatest length / period
    (null: no run). collapsed is the text without the words that any run holds
    after its first q, joined by one space. ``rewrite`` may give, by id and
    number of words, a place from which the words are to repeat and how many do.

    A null or empty text has no words, no runs and an empty collapsed text; a null id is given to ``rewrite`` as it is. Repeated rows each
    keep theirs; an empty table gives an empty one; columns called like a result
    are replaced. Narrow: texts don't move, and a task holds a slice of about 2
    MB, or one longer text, with four bytes a word for each doubling up to its
    longest repeat.
    """
    whole_texts(docs.sparkSession)
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    made = [T.StructField("runs", T.ArrayType(run)), T.StructField("strongest", run), T.StructField("collapsed", T.StringType())]
    keep = [c for c in carry or docs.columns if c.lower() not in {f.name for f in made}]
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{id}`").alias(unused(docs.columns, "row_id")), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(unused(docs.columns, "body")))
    kind = pa.struct([(c, pa.int64()) for c in run.names])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("periodic")
        for b in batches:
            ids = b.column(len(keep)).to_pylist()
            found, text_ = [], []
            for at, col in words.slices(b.column(len(keep) + 1)):
                for got, left in scan(col, ids[at : at + len(col)], least, times, rewrite):
                    found.append([dict(zip(run.names, r, strict=True)) for r in got])
                    text_.append(left)
            best = [strongest([tuple(r.values()) for r in got]) for got in found]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(found, pa.list_(kind)), pa.array([dict(zip(run.names, r, strict=True)) if r else None for r in best], kind), pa.array(text_, pa.string())], names=[*keep, *[f.name for f in made]])

    return src.mapInArrow(apply, T.StructType([*(docs.schema[c] for c in keep), *made]))
