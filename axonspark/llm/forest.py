"""Approximate nearest neighbours by a forest of hash prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonspark.llm import vectors as V
from axonspark.llm.scratch import Scratch

#: Vectors of one forest; every block of the table has its own, and every row is in one.
BLOCK = 8192
TREES = 64
BITS = 32
#: A query ascends until it has met this share of its block. Vectors without clusters, as here, need most of it for a high recall.
SHARE = 0.5
SEED = 11


class Forest:
    """Per tree, the rows in the order of their hash strings (signs of random projections)."""

    def __init__(self, m: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        self.m, self.trees, self.bits = m, trees, bits
        rng = np.random.Generator(np.random.PCG64([seed, m.shape[1]]))
        self.planes = rng.standard_normal((m.shape[1], trees * bits))
        keys = self.hash(m)
        self.order = np.argsort(keys, axis=0, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, axis=0)

    def hash(self, m: np.ndarray) -> np.ndarray:
        """(rows, trees) hash strings, the first bit highest."""
        out = np.zeros((len(m), self.trees), np.uint64)
        for k in range(0, len(m), 1024):
            signs = (m[k : k + 1024] @ self.planes >= 0).reshape(-1, self.trees, self.bits)
            for b in range(self.bits):
                out[k : k + 1024] |= signs[:, :, b].astype(np.uint64) << np.uint64(self.bits - 1 - b)
        return out

    def candidates(self, q: np.ndarray, want: int) -> Iterator[np.ndarray]:
        """Each query's rows. In every tree it descends to its longest matching prefix; then all trees ascend together.

        At a depth a query meets the rows that share so many first bits with it
        in any tree: one range of each sorted array. All trees always stand at
        the same depth, and go one bit up until ``want`` different rows are met.
        """
        keys = self.hash(q)
        lo = np.zeros((self.bits + 1, len(q), self.trees), np.int32)
        hi = np.zeros_like(lo)
        full = (1 << self.bits) - 1
        deepest = self.longest(keys)
        for depth in range(int(deepest.max(initial=0)) + 1):
            mask = np.uint64(full >> (self.bits - depth) << (self.bits - depth))
            low = keys & mask
            high = low | (np.uint64(full) ^ mask)
            for t in range(self.trees):
                lo[depth, :, t] = np.searchsorted(self.keys[:, t], low[:, t], "left")
                hi[depth, :, t] = np.searchsorted(self.keys[:, t], high[:, t], "right")
        for r in range(len(q)):
            seen = np.zeros(len(self.m), bool)
            depth = int(deepest[r].max(initial=0))
            while True:
                if (hi[depth, r] - lo[depth, r]).sum() >= want or not depth:
                    for t in range(self.trees):
                        seen[self.order[lo[depth, r, t] : hi[depth, r, t], t]] = True
                    if not depth or np.count_nonzero(seen) >= want:
                        break
                depth -= 1
            yield np.flatnonzero(seen)

    def longest(self, keys: np.ndarray) -> np.ndarray:
        """By query and tree the length of the longest prefix that any row shares: one of the two neighbours in the order has it."""
        out = np.zeros(keys.shape, np.int64)
        for t in range(self.trees):
            at = np.searchsorted(self.keys[:, t], keys[:, t])
            for place in (at - 1, at):
                other = self.keys[np.clip(place, 0, len(self.keys) - 1), t] ^ keys[:, t]
                out[:, t] = np.maximum(out[:, t], self.bits - np.ceil(np.log2(other.astype(np.float64) + 1)).astype(np.int64))
        return out


def _search(k: int, trees: int, bits: int, share: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, forest = None, None
        for b in batches:
            for body, payload in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                c, q = V.unpack(body), V.unpack(payload)
                if c["v"].shape[1] != q["v"].shape[1] or not c["v"].shape[1]:
                    continue
                if body != last:
                    last, forest = body, Forest(c["v"], trees, bits, seed)
                out = [[], [], []]
                for i, at in zip(range(len(q["ids"])), forest.candidates(q["v"], max(16 * k, round(share * len(c["ids"])))), strict=True):
                    at = at[c["ids"][at] != q["ids"][i]]
                    d = np.sqrt(((c["v"][at] - q["v"][i]) ** 2).sum(1))
                    top = V.top_rows(d, c["ids"][at], k)
                    for o, x in zip(out, (np.full(len(top), q["ids"][i]), c["ids"][at][top], d[top]), strict=True):
                        o.append(x)
                ids, vec, d = (np.concatenate(o) if o else np.zeros(0) for o in out)
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(vec.astype(np.int64)), pa.array(d.astype(np.float64))], names=["query_id", "vec_id", "score"])

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 10, id: str = "vec_id", vector: str = "embedding", trees: int = TREES, bits: int = BITS, share: float = SHARE, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found by Euclidean distance, ties to the smaller id.

    Every row is indexed, in the forest of its block; distances are of the
    original vectors, in double precision. Vectors that are null, zero, of no
    components, or hold null or non-finite ones take no part, nor do null ids;
    only vectors as long as the query are its candidates, without rows of its
    own id; repeated rows count one by one. Empty tables give an empty result.
    """
    scratch = Scratch(vectors.sparkSession, "forest")
    ready = lambda df: V.usable(df, id, vector).where(F.exists("v", lambda x: x != 0))
    blocks, n = V.query_blocks(ready(queries), scratch)
    rows = scratch.keep(V.bodies(ready(vectors), block), "bodies")
    found = V.against(rows, blocks, n).mapInArrow(_search(k, trees, bits, share, seed), "query_id long, vec_id long, score double")
    return V.best(found, k, descending=False)
