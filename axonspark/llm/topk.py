"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonspark.llm import vectors as V
from axonspark.llm.scratch import Scratch

BINS = 256
BLOCK = 4096
#: A query's range is narrow enough when so many candidates lie at or above its lower end.
ENOUGH = 64


def quantise(m: np.ndarray) -> np.ndarray:
    """floor(1024 * x) as 64-bit integers; beyond their range at its ends."""
    x = np.floor(1024.0 * m)
    return np.where(x >= 2.0**63, 2**63 - 1, np.where(x <= -(2.0**63), -(2**63), x)).astype(np.int64) if (np.abs(x) >= 2.0**62).any() else x.astype(np.int64)


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products (queries by vectors); by doubles where these are exact, else by 64-bit integers."""
    if q.shape[1] == 0:
        return np.zeros((len(q), len(v)), np.int64)
    top = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    if top < 2.0**53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


def _scored(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        for body, block, payload in zip(*(c.to_pylist() for c in b.columns[:3]), strict=True):
            c, q = V.unpack(body), V.unpack(payload)
            if c["v"].shape[1] == q["v"].shape[1]:
                s = scores(q["v"], c["v"])
                yield block, q, c["ids"], s, q["ids"][:, None] != c["ids"][None, :]


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and query: candidates, lowest and highest score."""
    held: dict[int, list] = {}
    for block, q, _, s, other in _scored(batches):
        big = np.iinfo(np.int64)
        lo, hi = np.where(other, s, big.max).min(1), np.where(other, s, big.min).max(1)
        n = other.sum(1)
        if block in held:
            o = held[block]
            o[1], o[2], o[3] = o[1] + n, np.minimum(o[2], lo), np.maximum(o[3], hi)
        else:
            held[block] = [np.arange(len(n)), n, lo, hi]
    for block, (at, n, lo, hi) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), block)), *(pa.array(x.astype(np.int64)) for x in (at, n, lo, hi))], names=["block", "q", "n", "lo", "hi"])


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and query: candidates in each bin of the query's present range."""
    held: dict[int, np.ndarray] = {}
    for block, q, _, s, other in _scored(batches):
        lo, width = q["lo"][:, None], q["width"][:, None]
        bin_ = (s - lo) // width
        ok = other & (s >= lo) & (bin_ < BINS)
        row = np.broadcast_to(np.arange(len(lo))[:, None], s.shape)
        made = np.bincount(row[ok] * BINS + bin_[ok], minlength=len(lo) * BINS)
        held[block] = held[block] + made if block in held else made
    for block, h in held.items():
        at = np.flatnonzero(h)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block)), pa.array(at // BINS), pa.array(at % BINS), pa.array(h[at])], names=["block", "q", "bin", "n"])


def _start(k: int):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        p = next(x for x in t["payload"].to_pylist() if x is not None)
        q = V.unpack(p)
        size = len(q["ids"])
        n, lo, hi = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        got = t.filter(pa.compute.is_valid(t["q"]))
        at = got["q"].to_numpy()
        for a, c in ((n, "n"), (lo, "lo"), (hi, "hi")):
            a[at] = got[c].to_numpy()
        width = np.maximum(1, -(-(hi - lo + 1) // BINS))
        return _block(key, q, lo, width, np.minimum(k, n), np.zeros(size, np.int64), n)

    return run


def _block(key, q, lo, width, need, above, inside) -> pa.Table:
    """``need``: the rank looked for; ``above``: candidates beyond the range; ``inside``: at most in it."""
    open_ = (width > 1) & (above + inside > np.maximum(need, ENOUGH))
    made = V.pack(ids=q["ids"], v=q["v"], lo=lo, width=width, need=need, above=above, inside=inside)
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "payload": pa.array([made], pa.binary()), "open": pa.array([int(open_.sum())], pa.int64())})


def _refine(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """Moves each query's range into the bin that holds its kth score."""
    q = V.unpack(next(x for x in t["payload"].to_pylist() if x is not None))
    size = len(q["ids"])
    got = t.filter(pa.compute.is_valid(t["q"]))
    h = np.zeros((size, BINS), np.int64)
    h[got["q"].to_numpy(), got["bin"].to_numpy()] = got["n"].to_numpy()
    down = h[:, ::-1].cumsum(1)[:, ::-1]
    over = q["above"][:, None] + down
    last = np.maximum(0, (over >= q["need"][:, None]).sum(1) - 1)
    at = np.arange(size)
    inside = h[at, last]
    above = over[at, last] - inside
    lo = q["lo"] + last * q["width"]
    width = np.maximum(1, -(-q["width"] // BINS))
    done = (q["width"] == 1) | (q["above"] + q["inside"] <= np.maximum(q["need"], ENOUGH))
    keep = lambda old, new: np.where(done, old, new)
    return _block(key, q, keep(q["lo"], lo), keep(q["width"], width), q["need"], keep(q["above"], above), keep(q["inside"], inside))


def _final(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, q, ids, s, other in _scored(batches):
            out = [[], [], []]
            for r in np.flatnonzero((other & (s >= q["lo"][:, None])).any(1)):
                at = np.flatnonzero(other[r] & (s[r] >= q["lo"][r]))
                at = at[V.top_rows(-s[r, at], ids[at], k)]
                for o, x in zip(out, (np.full(len(at), q["ids"][r]), ids[at], s[r, at]), strict=True):
                    o.append(x)
            cols = [pa.array(np.concatenate(o) if o else np.zeros(0, np.int64)) for o in out]
            yield pa.RecordBatch.from_arrays(cols, names=["query_id", "vec_id", "score"])

    return run


def exact_top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest integer inner products, ties to the smaller id.

    Vectors are quantised by floor(1024 * x). Null ids and vectors, and vectors
    with a null or non-finite component, take no part; only vectors as long as
    the query are its candidates, without the rows of its own id; with fewer
    than ``k`` all are returned; repeated rows count one by one. Other columns
    aren't read; empty tables give an empty result.

    Every round scores all candidates, adds up one histogram a query over all
    tasks and moves the query's range into the bin of its kth score, until the
    range is one score or few candidates remain. Then the candidates from there
    up are kept, at most ``k`` a block and query, and ranked.
    """
    scratch = Scratch(vectors.sparkSession, "topk")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(1)
            flat = quantise(col.flatten().to_numpy(zero_copy_only=False))
            ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(col).to_numpy(zero_copy_only=False))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["id", "v"])

    ready = lambda df: V.usable(df, id, vector).mapInArrow(whole, "id long, v array<bigint>")
    blocks, n = V.query_blocks(ready(queries), scratch)
    rows = scratch.keep(V.bodies(ready(vectors), BLOCK), "bodies")
    none = F.lit(None)
    state = blocks.select("block", "payload", *[none.cast("long").alias(c) for c in ("q", "n", "lo", "hi")])
    got = V.against(rows, blocks, n).mapInArrow(_ranges, "block long, q long, n long, lo long, hi long")
    got = got.groupBy("block", "q").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("block", none.cast("binary").alias("payload"), "q", "n", "lo", "hi")
    kind = "block long, payload binary, open long"
    blocks = scratch.keep(state.unionByName(got).groupBy("block").applyInArrow(_start(k), kind), "state")
    while (blocks.agg(F.sum("open")).first()[0] or 0) > 0:
        got = V.against(rows, blocks.select("block", "payload"), n).mapInArrow(_histograms, "block long, q long, bin long, n long")
        got = got.groupBy("block", "q", "bin").agg(F.sum("n").alias("n")).select("block", none.cast("binary").alias("payload"), "q", "bin", "n")
        state = blocks.select("block", "payload", *[none.cast("long").alias(c) for c in ("q", "bin", "n")])
        blocks = scratch.keep(state.unionByName(got).groupBy("block").applyInArrow(_refine, kind), "state")
    found = V.against(rows, blocks.select("block", "payload"), n).mapInArrow(_final(k), "query_id long, vec_id long, score long")
    return V.best(found, k, descending=True)
