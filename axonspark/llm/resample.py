"""Target-distribution importance resampling by a streaming CRC ring.

A document is scanned once: a ring keeps the running zlib CRC-32 states of the
runs of words that began at the last ``n`` words, each is extended by a space and
the next word, and after every word the ring gives the buckets of all runs of 1
to ``n`` words that end there. The gain of a bucket is the log ratio of its rate
in the target to that in the raw text; a document's weight is the sum of its
gains, and a Gumbel top-k draws the documents.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axonspark.llm import worker
from axonspark.llm.names import unused
from axonspark.llm.scratch import Scratch, whole_texts

#: A-Z to lower case, and white space for what parts words: ASCII but letters and digits.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def split(text: str) -> list[bytes]:
    """The words of a text, as UTF-8."""
    return text.encode("utf-8").translate(FOLD).split()


def ring(found: list[bytes], n: int) -> np.ndarray:
    """The CRC-32 of every run of 1 to ``n`` consecutive words joined by one space, by the word at which it ends, longest first."""
    crc32, states, out = zlib.crc32, [], []
    if n == 1:
        return np.fromiter(map(crc32, found), np.uint32, len(found))
    for w in found:
        spaced = b" " + w
        states = [crc32(spaced, s) for s in states]
        states.append(crc32(w))
        out += states
        if len(states) == n:
            del states[0]
    return np.array(out, np.uint32)


def noise(seed: str, key: str) -> int:
    """floor(1000 * g) for the standard Gumbel draw g of this key, from 32 bits of its SHA-256."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def gains(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's rate in the target over that in the raw text, one occurrence added to each."""
    m, big, all_ = len(raw), float(target.sum()), float(raw.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_ + m) / ((s + 1.0) * (big + m)))) for t, s in zip(target.tolist(), raw.tolist(), strict=True)], np.int64)


def _emit(keep: int, names: list[str], n: int, buckets: int, seed: str):
    """Texts to their numbers of words and features, buckets and noise. The last two columns are the id as a string and the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("resample")
        kind = "<u2" if buckets <= 1 << 16 else "<u4"
        for b in batches:
            sizes, features, made, drawn = [], [], [], []
            for key, text in zip(b.column(keep).to_pylist(), b.column(keep + 1), strict=True):
                found = split(text.as_py())
                at = ring(found, n) % np.uint32(buckets)
                sizes.append(len(found))
                features.append(len(at))
                made.append(at.astype(kind).tobytes())
                drawn.append(noise(seed, key))
            yield pa.RecordBatch.from_arrays([*b.columns[:keep], pa.array(sizes, pa.int64()), pa.array(features, pa.int64()), pa.array(drawn, pa.int64()), pa.array(made, pa.binary())], names=names)

    return run


def emitted(docs: DataFrame, keep: list[str], id: str | None, text: str, n: int, buckets: int, seed: str) -> DataFrame:
    """The columns ``keep`` and of each text its words, features, noise and buckets, by one scan."""
    made = [T.StructField("__words", T.LongType()), T.StructField("n_features", T.LongType()), T.StructField("__noise", T.LongType()), T.StructField("__buckets", T.BinaryType())]
    key = F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("")) if id else F.lit("")
    src = docs.select(*[F.col(f"`{c}`") for c in keep], key.alias("__key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__body"))
    return src.mapInArrow(_emit(len(keep), [*keep, *[f.name for f in made]], n, buckets, seed), T.StructType([*(docs.schema[c] for c in keep), *made]))


def counted(scanned: DataFrame, buckets: int) -> np.ndarray:
    """Occurrences of each bucket: every task adds up its own, and only sums move."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("resample")
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), kind), minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(total[hit], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in scanned.select("__buckets").mapInArrow(add, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def resample(docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", target_text: str = "text", n: int = 1, buckets: int = 10_000, percent: int = 10, least: int = 20, seed: str = "2024", carry: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` (its columns ``carry``, or all but the text) with n_features, weight, score and rank.

    Of the N rows with at least ``least`` words the floor(percent * N / 100) of
    the highest scores are drawn and numbered from 1, ties to the smaller id;
    rank is null for all others.

    A null or empty text has no features and the weight 0. A null id draws like
    an empty one and comes last among ties; rows with one id, score and number of
    features are alike in the result, so that it doesn't matter which is drawn.
    An empty target has gains that favour rare buckets; an empty ``docs`` gives
    an empty table. Columns of ``docs`` called like a result are replaced.

    Each text is scanned once; its buckets, two bytes a feature, are written and
    read again for the sums and for the weights. Only ``buckets`` sums reach the
    driver and ``buckets`` gains go out. Rows are ranked by a range partitioning
    and an offset for each partition, so that no task holds all of them.
    """
    spark = docs.sparkSession
    whole_texts(spark)
    scratch = Scratch(spark, "resample")
    keep = [c for c in (carry or [c for c in docs.columns if c != text]) if c.lower() not in ("n_features", "weight", "score", "rank")]
    inner = [f"c{k}" for k in range(len(keep))]
    renamed = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(keep, inner, strict=True)], F.col(f"`{id}`").alias("__id"), F.col(f"`{text}`").alias("__text"))
    scanned = scratch.keep(emitted(renamed, [*inner, "__id"], "__id", "__text", n, buckets, seed), "buckets")
    wanted = emitted(target.select(F.col(f"`{target_text}`").alias("__text")), [], None, "__text", n, buckets, seed)
    gain = spark.sparkContext.broadcast(gains(counted(wanted, buckets), counted(scanned, buckets)))
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    first = [*inner, "__id", "__words", "n_features"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("resample")
        for b in batches:
            w = np.array([int(gain.value[np.frombuffer(x.as_buffer(), kind)].sum()) for x in b.column(len(first) + 1)], np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(first)], pa.array(w), pa.array(w + b.column(len(first)).to_numpy(zero_copy_only=False))], names=[*first, "weight", "score"])

    schema = T.StructType([*(scanned.schema[c] for c in first), T.StructField("weight", T.LongType()), T.StructField("score", T.LongType())])
    scored = scanned.mapInArrow(weigh, schema).withColumn("__in", F.col("__words") >= least)
    order = [F.col("__in").desc(), F.col("score").desc(), F.col("__id").asc_nulls_last(), F.col("n_features").asc()]
    ranked = scratch.keep(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranked.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum(F.col("__in").cast("long")).alias("inside")).orderBy("part").collect()
    drawn = percent * sum(r["inside"] for r in sizes) // 100
    before = np.concatenate([[0], np.cumsum([r["n"] for r in sizes])]).tolist()
    offsets = spark.createDataFrame([(r["part"], k) for r, k in zip(sizes, before, strict=False)], "__part long, __before long")
    number = F.col("__before") + within + 1
    out = ranked.withColumn("__part", part).join(F.broadcast(offsets), "__part", "left")
    return out.select(*[F.col(i).alias(c) for i, c in zip(inner, keep, strict=True)], "n_features", "weight", "score", F.when(number <= drawn, number).alias("rank"))
