"""Packing of tokenised documents into sequences: shortest-pack-first over the length histogram."""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axonspark.llm import tokens, words, worker
from axonspark.llm.scratch import Scratch


def plan(histogram: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int, int, int, int]], int]:
    """Places all lengths of ``histogram`` (length under ``size`` -> documents).

    Returns (length class, first rank, end rank, start, piece length, sequence
    of the first rank, offset there) for each run of equal placements, and the
    number of sequences. Lengths go longest first, each into the emptiest packs
    that hold it, a whole run of equal packs at a time; new packs are opened up
    to the number that the tokens need. After that a length that fits nowhere is
    cut to fill the emptiest pack, and the rest goes back into the histogram. So
    the padding of all sequences together is less than one sequence. The steps
    depend on the lengths and patterns, not on the number of documents.
    """
    total = sum(k * n for k, n in histogram.items())
    most, opened = -(-total // size), 0
    pool: dict[int, deque] = defaultdict(deque)
    for k, n in histogram.items():
        if n:
            pool[k].append((k, 0, n, 0))
    gaps: dict[int, list] = defaultdict(list)
    largest: list[int] = []
    out = []
    for length in range(size - 1, 0, -1):
        queue = pool[length]
        while queue:
            kind, low, high, start = queue.popleft()
            while largest and not gaps[-largest[0]]:
                heapq.heappop(largest)
            gap = -largest[0] if largest else 0
            if gap < length and opened < most:
                gap, base, n = size, opened, min(high - low, most - opened)
                opened += n
                there = n
            else:
                base, there = gaps[gap].pop()
                n = min(high - low, there)
            put = min(gap, length)
            out.append((kind, low, low + n, start, put, base, size - gap))
            if there > n:
                gaps[gap].append((base + n, there - n))
                heapq.heappush(largest, -gap)
            if gap > put:
                gaps[gap - put].append((base, n))
                heapq.heappush(largest, put - gap)
            if length > put:
                pool[length - put].append((kind, low, low + n, start + put))
            if high > low + n:
                queue.appendleft((kind, low + n, high, start))
    return out, opened


def tokenised(docs: DataFrame, path: str, size: int, end: int) -> DataFrame:
    """Per row of ``docs`` (id, text): its tokens with ``end``, cut into full pieces and a rest, with checksums.

    ``part`` and ``rank`` number the rows of each rest length inside their task,
    ``fulls_before`` its full pieces; the table is written once, which fixes them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("tokens")
        part, seen, at, fulls = TaskContext.get().partitionId(), np.zeros(size, np.int64), 0, 0
        for b in batches:
            for first, col in words.slices(b.column(1)):
                rows: list[tuple] = []
                for ids in tokens.memo(path).encode(col):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    whole, rest = divmod(len(ids), size)
                    crcs = [zlib.crc32(ids[k * size : (k + 1) * size].tobytes()) for k in range(whole)]
                    tail = ids[whole * size :]
                    rows.append((part << 33 | at, part, len(ids), fulls, crcs, rest, int(seen[rest]), zlib.crc32(tail.tobytes()), (tail.astype("<u2") if not len(tail) or tail.max() < 65536 else tail).tobytes()))
                    at, fulls = at + 1, fulls + whole
                    seen[rest] += 1
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(col)), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["id", "uid", "part", "n", "fulls_before", "crcs", "rest", "rank", "rest_crc", "rest_ids"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, uid long, part int, n long, fulls_before long, crcs array<long>, rest int, rank long, rest_crc long, rest_ids binary")


def _cut_crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Checksums of pieces of a rest. Columns: rest, at, length, rest_ids, then any others."""
    for b in batches:
        made = []
        for rest, at, length, ids in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            x = np.frombuffer(ids, dtype="<u2" if len(ids) == 2 * rest else "<u4")
            made.append(zlib.crc32(x[at : at + length].astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([*b.columns[4:], b.column(2), pa.array(made, pa.int64())], names=[*b.schema.names[4:], "length", "ids_crc32"])


def pack(docs: DataFrame, path: str | None = None, size: int = 2048, end: int = 1, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A row's tokens are its text's ids (null: none) and ``end``. Every full
    ``size`` of them is a sequence of its own; the rests are packed by ``plan``
    from their length histogram (under ``size`` rows on the driver) and joined
    to their places by rank within the length. Repeated rows and ids are packed
    as separate documents; null ids stay null; other columns aren't read. An
    empty table gives an empty result.

    Ranks are a task's own running numbers plus an offset from the counts of
    (task, length), so that a length that most documents share needs no sort
    and no single task; the running number of full sequences is taken over one
    row a writing task. The places, bounded by the lengths and not by the
    documents, are broadcast. Only rests that are cut move their ids.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    src = docs.select(F.col(f"`{id}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    made = scratch.keep(tokenised(src, path or tokens.public_path(), size, end), "tokens")
    counts = scratch.keep(made.groupBy("part", "rest").agg(F.count("*").alias("c"), F.sum(F.size("crcs")).alias("f")), "counts")
    histogram = {r["rest"]: r["c"] for r in counts.where("rest > 0").groupBy("rest").agg(F.sum("c").alias("c")).collect()}
    places, packs = plan(histogram, size)
    ahead = counts.select("part", "rest", (F.sum("c").over(Window.partitionBy("rest").orderBy("part")) - F.col("c")).alias("ahead"))
    tasks = counts.groupBy("part").agg(F.sum("f").alias("f"))
    tasks = tasks.select("part", (F.sum("f").over(Window.orderBy("part")) - F.col("f") + F.lit(packs)).alias("first"))
    narrow = made.select("id", "uid", "part", "n", "rest", "rank", "rest_crc")
    ranked = narrow.where("rest > 0").join(ahead, ["part", "rest"]).select("id", "uid", "n", "rest", "rest_crc", (F.col("rank") + F.col("ahead")).alias("rank"))
    where = spark.createDataFrame(places, "rest int, low long, high long, at int, length long, base long, offset long")
    placed = ranked.join(F.broadcast(where), "rest").where("rank >= low and rank < high")
    placed = placed.select("id", "uid", "n", "rest", "rest_crc", "at", "length", (F.col("base") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")
    placed = scratch.keep(placed, "placed")
    start = (F.col("n") - F.col("rest") + F.col("at")).alias("start")
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    uncut = placed.where("length = rest").select("id", start, "length", F.col("rest_crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", "offset")
    cut = placed.where("length < rest").select("uid", "id", start, "rest", "at", "length", F.col("n").alias("doc_tokens"), "sequence_id", "offset")
    kind = src.schema["id"].dataType.simpleString()
    cut = made.select("uid", "rest_ids").join(cut, "uid").select("rest", "at", "length", "rest_ids", "id", "start", "doc_tokens", "sequence_id", "offset")
    cut = cut.mapInArrow(_cut_crcs, f"id {kind}, start long, doc_tokens long, sequence_id long, offset long, length long, ids_crc32 long").select(*names)
    whole = made.where(F.size("crcs") > 0).join(tasks, "part").select("id", "n", "fulls_before", "first", F.posexplode("crcs").alias("k", "crc"))
    whole = whole.select("id", (F.col("k") * size).cast("long").alias("start"), F.lit(size).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), (F.col("first") + F.col("fulls_before") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return uncut.unionByName(cut).unionByName(whole).withColumnRenamed("id", id)
