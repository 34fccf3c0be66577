"""Quality classifier: importance resampling with hashed n-gram generative models.

A document's log importance weight is the log ratio of two generative models of
its n-grams, the sum over all of them:

* the target, from labelled documents of good quality that aren't toxic;
* raw text, from all documents.

N-grams are hashed words, pairs of words, and the event that a word stands there
for the third time in a row. Every n-gram has its own ratio, shrunk towards 1 by
the evidence that it tells good from rejected documents at all; without that, the
noise of thousands of common words would outweigh a few telling ones in long
texts. A Gumbel top-k draw without replacement then keeps a stated share, or as
many documents as are likelier target than not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axonspark.llm import words, worker
from axonspark.llm.names import unused
from axonspark.llm.scratch import Scratch

#: Hashed n-grams. The first stands for any word for the third time in a row.
BITS = 21
#: Occurrences, as rare in the target as in raw text, that are added to each n-gram's.
PRIOR = 0.02
#: An n-gram with this likelihood ratio statistic keeps half of its log ratio; others keep g**3 / (g**3 + HALF**3) of it.
HALF = 24.0
#: The models are fitted to so many labelled rows at most (those of the smallest hashes).
LABELLED = 200_000
#: Counts move in slices of so many n-grams.
SLICE = 1 << 16


def pack(at: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending places in a slice and their counts, as compressed byte planes."""
    planes = [np.diff(at, prepend=0).astype("<u2").view(np.uint8).reshape(-1, 2), n.astype("<i8").view(np.uint8).reshape(-1, 8)]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(np.ascontiguousarray(p.T).tobytes() for p in planes))


def unpack(x: bytes) -> tuple[np.ndarray, np.ndarray]:
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(10, -1)
    return np.cumsum(np.ascontiguousarray(body[:2].T).view("<u2").ravel(), dtype=np.int64), np.ascontiguousarray(body[2:].T).view("<i8").ravel()


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of a slice of texts: (hashed n-grams, their rows)."""
    body, ends = words.raw(column)
    start, end, first = words.spans(body, ends)
    exact = words.hashes(body, start, end, fold=False)
    made, of, rows = [], [], np.arange(len(column))
    shift = np.uint64(64 - BITS)
    for size, source in ((1, words.hashes(body, start, end)), (2, exact)):
        g, at = words.grams(source, first, size)
        g = np.maximum(g >> shift, 1).astype(np.int64)
        made.append(g)
        of.append(np.repeat(rows, np.diff(at)))
    row = of[0]
    again = row[2:][(exact[2:] == exact[1:-1]) & (exact[1:-1] == exact[:-2]) & (row[2:] == row[:-2])]
    return np.concatenate([*made, np.zeros(len(again), np.int64)]), np.concatenate([*of, again])


#: What is counted: occurrences in all and in good documents, and good and rejected documents with the n-gram.
KINDS = ("all", "good", "good_documents", "bad_documents")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: the counts of KINDS, and the numbers of labelled documents. Column 0: text, column 1: good (null: not labelled)."""
    worker.begin("quality")
    size = 1 << BITS
    made = [np.zeros(size, np.int64 if k == "all" else np.int32) for k in KINDS]
    n = np.zeros(2, np.int64)
    for b in batches:
        label = b.column(1).to_pandas()
        good, bad = label.eq(True).to_numpy(), label.eq(False).to_numpy()
        for at, col in words.slices(b.column(0)):
            g, row = features(col)
            made[0] += np.bincount(g, minlength=size)
            for k, side in ((2, good), (3, bad)):
                mine = side[at : at + len(col)]
                if mine.any():
                    x = g[mine[row]]
                    np.add.at(made[k], np.unique(row[mine[row]] << BITS | x) & (size - 1), 1)
                    if k == 2:
                        np.add.at(made[1], x, 1)
        n += [int(good.sum()), int(bad.sum())]
    for kind, a in enumerate((*made, n)):
        hit = np.flatnonzero(a)
        if not len(hit):
            continue
        cuts = np.flatnonzero(np.diff(hit // SLICE, prepend=-1))
        for i, j in zip(cuts, [*cuts[1:], len(hit)], strict=True):
            at = hit[i:j]
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([int(at[0]) // SLICE], pa.int32()), pa.array([pack(at % SLICE, a[at])])], names=["kind", "slice", "payload"])


def _add(t: pa.Table) -> pa.Table:
    a = np.zeros(SLICE, np.int64)
    for x in t["payload"].to_pylist():
        at, n = unpack(x)
        a[at] += n
    hit = np.flatnonzero(a)
    return pa.table({"kind": t["kind"][:1], "slice": t["slice"][:1], "payload": pa.array([pack(hit, a[hit])])})


def differs(a: np.ndarray, n: float, b: np.ndarray, m: float) -> np.ndarray:
    """The likelihood ratio statistic of ``a`` of ``n`` against ``b`` of ``m`` having one rate."""

    def fit(x, size):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-300) / size), 0.0)

    if not n or not m:
        return np.zeros(len(a))
    return 2 * (fit(a, n) + fit(n - a, n) + fit(b, m) + fit(m - b, m) - fit(a + b, n + m) - fit(n + m - a - b, n + m))


def ratios(counts: dict[str, np.ndarray], n_good: int, n_bad: int) -> np.ndarray:
    """The shrunk log ratio of the target's to the raw model's rate of each n-gram."""
    share = float(counts["good"].sum()) / max(float(counts["all"].sum()), 1.0)
    out = np.zeros(len(counts["all"]), np.float32)
    for at in range(0, len(out), SLICE):  # little memory at a time
        c = {k: counts[k][at : at + SLICE].astype(np.float64) for k in KINDS}
        g = np.maximum(differs(c["good_documents"], n_good, c["bad_documents"], n_bad), 0.0) / HALF
        ratio = np.log((c["good"] + PRIOR) / (share * c["all"] + PRIOR))
        out[at : at + SLICE] = ratio * (g**3 / (g**3 + 1))
    return out


class Model:
    """The log ratios, and from which log weight on a document is likelier target than not (0 at most: what nothing speaks against stays)."""

    def __init__(self, parts: list):
        made = [np.zeros(1 << BITS, np.int64 if k == "all" else np.int32) for k in KINDS] + [np.zeros(2, np.int64)]
        for p in parts:
            at, n = unpack(p["payload"])
            made[p["kind"]][p["slice"] * SLICE + at] = n
        good, bad = made[-1].tolist()
        self.ratio = ratios(dict(zip(KINDS, made, strict=False)), good, bad)
        self.even = min(0.0, float(np.log((good + bad) / (2 * good)))) if good and bad else 0.0

    def __getstate__(self) -> dict:
        """Compressed, since every executor keeps what is broadcast."""
        return {"ratio": zstandard.ZstdCompressor(level=3).compress(self.ratio.tobytes()), "even": self.even}

    def __setstate__(self, state: dict) -> None:
        self.ratio, self.even = np.frombuffer(zstandard.ZstdDecompressor().decompress(state["ratio"]), np.float32), state["even"]

    def weights(self, column: pa.Array) -> np.ndarray:
        """The log importance weight of each text."""
        g, row = features(column)
        return np.bincount(row, weights=self.ratio[g], minlength=len(column))


def gumbel(column: pa.Array, ids: np.ndarray, seed: int) -> np.ndarray:
    """Standard Gumbel noise, the same for the same id and text."""
    body, ends = words.raw(column)
    whole = words.hashes(body, ends[:-1], ends[1:], fold=False) if len(body) else np.zeros(len(column), np.uint64)
    h = words.mix(words.mix(ids.astype(np.int64).astype(np.uint64) + np.uint64(seed)) ^ whole)
    u = ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return -np.log(-np.log(u))


def kth_largest(values: DataFrame, k: int) -> float:
    """The ``k``-th largest of column ``key`` (1: the largest), by histograms over all rows; only counts reach the driver."""
    lo, hi = values.agg(F.min("key"), F.max("key")).first()
    while lo < hi:
        width = (hi - lo) / 1024
        bin_ = F.least(F.greatest(F.floor((F.col("key") - lo) / width), F.lit(0)), F.lit(1023))
        inside = values.where((F.col("key") >= lo) & (F.col("key") <= hi))
        rows = inside.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        for r in sorted(rows, key=lambda r: -r["bin"]):
            if k <= r["n"]:
                if (r["lo"], r["hi"]) == (lo, hi):
                    return hi if k == 1 else lo
                lo, hi = r["lo"], r["hi"]
                break
            k -= r["n"]
    return lo


def classify(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", seed: int = 5, carry: list[str] | None = None, share: float | None = None) -> DataFrame:
    """Every row of ``docs`` (its columns ``carry``, or all) with log_weight and keep.

    ``labels`` has (id, quality, toxic); good is quality 1 and toxic 0, a null
    in either leaves the row out, and a repeated id is good if all its rows are.
    Null and empty texts have no n-grams and the log weight 0;
    null ids draw like id 0; rows with the same id and text share their fate.
    ``share`` of all rows are drawn, or, by default, as many as are likelier
    target than not: that is where log_weight is at least log((good + rejected)
    / (2 good)) of the labels, or 0 where good ones are fewer.
    Without good or without rejected labels all weights are 0 and all rows are
    kept; an empty table gives an empty result. A column of ``docs`` named
    log_weight or keep is replaced.

    Documents aren't shuffled: the bounded sample of labels is broadcast, each
    task adds up its counts, and the log ratios, of a fixed size, go to all.
    Each text is scored once, and the rows are written with their weights;
    the draw then needs counts of the written weights alone.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    good = labels.select(F.col(id).alias("__id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("__good")).where("__id is not null and __good is not null")
    good = good.groupBy("__id").agg(F.min("__good").alias("__good"))
    good = scratch.keep(good.orderBy(F.xxhash64("__id"), "__id").limit(LABELLED), "labels")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text")
    marked = docs.select(body, F.col(f"`{id}`").alias("__id")).join(F.broadcast(good), "__id", "left").select("__text", "__good")
    kind = "kind int, slice int, payload binary"
    shared = spark.sparkContext.broadcast(Model(marked.mapInArrow(_count, kind).groupBy("kind", "slice").applyInArrow(_add, kind).collect()))
    keep = [c for c in carry or docs.columns if c not in ("log_weight", "keep")]
    key = unused(docs.columns, "draw_key")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("quality")
        for b in batches:
            ids = pa.compute.fill_null(b.column(1).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
            w, drawn = [np.zeros(0)], [np.zeros(0)]
            for at, col in words.slices(b.column(0)):
                w.append(shared.value.weights(col))
                drawn.append(w[-1] + gumbel(col, ids[at : at + len(col)], seed))
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(np.concatenate(w)), pa.array(np.concatenate(drawn))], names=[*keep, "log_weight", key])

    whole = docs.select(body.alias(unused(docs.columns, "body")), F.col(f"`{id}`").alias(unused(docs.columns, "row_id")), *[F.col(f"`{c}`") for c in keep])
    scored = scratch.keep(whole.mapInArrow(score, T.StructType([*(docs.schema[c] for c in keep), T.StructField("log_weight", T.DoubleType()), T.StructField(key, T.DoubleType())])), "scored")
    k = scored.where(F.col("log_weight") >= shared.value.even).count() if share is None else int(share * scored.count())
    least = kth_largest(scored.select(F.col(f"`{key}`").alias("key")), k) if k else float("inf")
    return scored.withColumn("keep", F.col(f"`{key}`") >= least).drop(key)
