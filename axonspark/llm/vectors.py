"""Blocks of vectors and queries, shared by the exact and the approximate search."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axonspark.llm.scratch import Scratch

#: Queries of one block.
QUERIES = 1024
#: Query blocks are broadcast while all of them together stay under this size; beyond it they are joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(x: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(x), allow_pickle=False) as f:
        return {k: f[k] for k in f.files}


def usable(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, v) of the vectors that take part: none null, holding null or holding a non-finite component; no null id."""
    v = F.col(f"`{vector}`").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(f"`{id}`").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & good)


def matrices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of up to ``most`` rows each, one width in each."""
    held: dict[int, list] = {}
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        col = b.column(1)
        width = pa.compute.list_value_length(col).to_numpy(zero_copy_only=False)
        flat = col.flatten().to_numpy(zero_copy_only=False)
        at = np.concatenate([[0], np.cumsum(width)])
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            m = flat[at[rows][:, None] + np.arange(w)] if w else np.zeros((len(rows), 0))
            held.setdefault(int(w), []).append((ids[rows], m))
            if sum(len(x) for x, _ in held[int(w)]) >= most:
                yield from _cut(held.pop(int(w)), most)
    for parts in held.values():
        yield from _cut(parts, most)


def _cut(parts: list, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, m = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
    for k in range(0, len(ids), most):
        yield ids[k : k + most], m[k : k + most]


def query_blocks(queries: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(block, payload of ids and v), at most about QUERIES queries of one width a block, and the number of blocks."""
    n = queries.count()
    blocks = max(1, -(-n // QUERIES))

    def run(t: pa.Table) -> pa.Table:
        first = t["block"][0].as_py()
        made = [pack(ids=i, v=m) for i, m in matrices(t.select(["id", "v"]).combine_chunks().to_batches(), 4 * QUERIES)]
        return pa.table({"block": pa.array([first << 20 | k for k in range(len(made))], pa.int64()), "payload": pa.array(made, pa.binary())})

    q = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("long")).groupBy("block").applyInArrow(run, "block long, payload binary")
    q = scratch.keep(q, "queries")
    number = scratch.keep(q.select("block").withColumn("k", F.row_number().over(Window.orderBy("block")) - 1), "numbers")
    q = scratch.keep(q.join(number, "block").select(F.col("k").cast("long").alias("block"), "payload"), "queries")
    return q, q.count()


def against(rows: DataFrame, blocks: DataFrame, n: int) -> DataFrame:
    """(body, block, payload) for each row of bodies and each of ``n`` query blocks.

    The stated query set meets all rows block by block: the blocks are broadcast
    while their measured size allows it; beyond that both sides are dealt by
    (block, slice), so that neither is ever in one task.
    """
    size = blocks.agg(F.sum(F.length("payload"))).first()[0] or 0
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")) if n else F.array().cast("array<long>")))
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(blocks), "block").select("body", "block", "payload")
    slices = 64
    spread = blocks.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("body"), F.lit(slices)).cast("int"))
    return rows.join(spread, ["block", "slice"]).select("body", "block", "payload")


def bodies(vectors: DataFrame, most: int) -> DataFrame:
    """Blocks of up to ``most`` vectors of one width, as they lie in each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, m in matrices(batches, most):
            yield pa.RecordBatch.from_arrays([pa.array([pack(ids=ids, v=m)], pa.binary())], names=["body"])

    return vectors.select("id", "v").mapInArrow(run, "body binary")


def best(found: DataFrame, k: int, descending: bool) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best, ties to the smaller vec_id."""
    order = [F.desc("score") if descending else F.asc("score"), F.asc("vec_id")]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_rows(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` smallest scores, ties to the smaller id."""
    if len(score) > k:
        edge = np.partition(score, k - 1)[k - 1]
        keep = np.flatnonzero(score <= edge)
    else:
        keep = np.arange(len(score))
    return keep[np.lexsort((ids[keep], score[keep]))[:k]]
