"""Mixing sources to target weights: subset-sum budget fitting over exact lengths."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axonspark.llm.scratch import Scratch

#: A word of the size measure, as a Java pattern.
WORD = r"[^\x20\x09-\x0D]+"
#: Budgets up to this many words are fitted by dynamic programming.
EXACT = 1 << 16
#: Where they are left with a gap, all documents of a source are fitted anew: over tables of sums if these take at most so many bits, else over lists of sums.
TABLES = 1 << 31
#: Sums in a list, and the longest lengths (in powers of two of their counts) that it is made of. Up to so many sums the fit is exact; beyond, a sum is off by a step's share of the budget at most.
SUMS, STEPS = 1 << 17, 64
#: Sources are configuration: one row each on the driver, at most so many.
MOST_SOURCES = 1_000_000


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> list[tuple[str | None, int, float]]:
    """(source, size, target) by code point, null last.

    ``weights`` repeat over the sources and divide ``share`` of all sizes; a
    target above ``most`` times its source's size stops there, and the excess is
    shared among the others by weight, until none is above.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8", "surrogatepass")))
    w = [float(weights[k % len(weights)]) for k in range(len(order))]
    left = share * sum(s for _, s in order)
    out, open_ = [0.0] * len(order), list(range(len(order)))
    while open_:
        total = sum(w[k] for k in open_)
        above = [k for k in open_ if left * w[k] / total > most * order[k][1]]
        if not above:
            for k in open_:
                out[k] = left * w[k] / total
            break
        for k in above:
            out[k] = most * order[k][1]
            left -= out[k]
        open_ = [k for k in open_ if k not in set(above)]
    return [(s, n, t) for (s, n), t in zip(order, out, strict=True)]


def _knapsack(room: dict[int, int], goal: int, order: list[int]) -> dict[int, int]:
    """Of each length at most ``room``, in sum as near below ``goal`` as possible: one bit a reachable sum."""
    bound = (1 << (goal + 1)) - 1
    reach, steps, take = 1, [], dict.fromkeys(room, 0)
    for k in order:
        n = min(room[k], goal // k) if k else 0
        m = 1
        while n > 0 and not reach >> goal & 1:
            m = min(m, n)
            steps.append((k, m, reach))
            reach |= reach << k * m & bound
            n -= m
            m *= 2
        if reach >> goal & 1:
            break
    at = reach.bit_length() - 1
    for k, m, before in reversed(steps):
        if not before >> at & 1:
            take[k] += m
            at -= k * m
    return take


def _listed(room: dict[int, int], goal: int, lengths: list[int]) -> tuple[np.ndarray, Callable[[int], dict[int, int]]]:
    """(sums up to ``goal`` of at most ``room`` of each of ``lengths``, how many of each make one of them)."""
    sums, steps = np.zeros(1, np.int64), []
    for k in lengths:
        n, m = min(room[k], goal // k), 1
        while n > 0:
            m = min(m, n)
            steps.append((k, m, sums))
            more = sums + k * m
            sums = np.union1d(sums, more[more <= goal])
            if len(sums) > SUMS:  # of sums that are nearly the same one stays
                step = sums * SUMS // (goal + 1)
                last = np.append(step[1:] != step[:-1], True)
                sums = sums[last]
            n -= m
            m *= 2

    def made(at: int) -> dict[int, int]:
        take = dict.fromkeys(room, 0)
        for k, m, before in reversed(steps):
            i = int(np.searchsorted(before, at))
            if i == len(before) or before[i] != at:
                take[k] += m
                at -= k * m
        return take

    return sums, made


def _few_long(counts: dict[int, int], budget: int, seed: int) -> dict[int, int]:
    """The fit by lists of sums of the longest documents, what they leave filled by the others."""
    lengths, steps = [], 0
    for k in sorted((k for k in counts if 0 < k <= budget), reverse=True):
        steps += min(counts[k], budget // k).bit_length()
        if steps > STEPS:
            break
        lengths.append(k)
    rest = {k: n for k, n in counts.items() if k not in set(lengths)}
    sums, made = _listed(counts, budget, lengths)
    room = sum(k * n for k, n in rest.items())
    best, least = dict.fromkeys(counts, 0), budget
    # what is left should be no more than the others can fill; of several such sums the fit is compared
    fitting = sums[budget - sums <= room]
    for at in dict.fromkeys([int(sums[-1]), *(fitting[np.linspace(0, len(fitting) - 1, 8).astype(int)].tolist() if len(fitting) else ())]):
        take = made(at)
        if rest:
            take |= fit(rest, budget - at, seed, lists=False)
        gap = budget - sum(k * n for k, n in take.items())
        if gap < least:
            best, least = take, gap
    return best


def fit(counts: dict[int, int], budget: int, seed: int = 7, lists: bool = True) -> dict[int, int]:
    """How many documents of each length to take so that their lengths sum as near below ``budget`` as can be found.

    Every length first gives its even share, rounded down; lengths in seeded
    order then give one more each while over EXACT words remain; where only
    documents longer than the table of sums are left, the longest that fits is
    taken; the rest is a bounded knapsack over reachable sums. If that leaves a
    gap, a source of few, long documents is solved over all of them: by a table
    of all sums where it fits TABLES, by lists of the sums there are where not.
    """
    total = sum(k * n for k, n in counts.items())
    if budget >= total:
        return dict(counts)
    take = {k: n * budget // total for k, n in counts.items()}
    left = budget - sum(k * n for k, n in take.items())
    order = sorted(counts, key=lambda k: (zlib.crc32(f"{seed}:{k}".encode()), k))
    while left > EXACT:
        before = left
        for k in order:
            if left - k < EXACT // 2:
                continue
            if take[k] < counts[k] and left > EXACT:
                take[k] += 1
                left -= k
        if left == before:
            break
    while left > 4 * EXACT:
        k = max((k for k in order if take[k] < counts[k] and 0 < k <= left), default=0)
        if not k:
            break
        take[k] += 1
        left -= k
    more = _knapsack({k: n - take[k] for k, n in counts.items()}, min(max(0, left), 4 * EXACT), order)
    take = {k: n + more[k] for k, n in take.items()}
    gap = budget - sum(k * n for k, n in take.items())
    if gap > 0 and budget * sum(min(n, budget // k).bit_length() for k, n in counts.items() if k) <= TABLES:
        return _knapsack(counts, budget, order)
    if gap > 0 and lists:
        other = _few_long(counts, budget, seed)
        if budget - sum(k * n for k, n in other.items()) < gap:
            return other
    return take


def _take(seed: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        target, total = float(rows["target"].iloc[0]), int(rows["source_size"].iloc[0])
        whole = int(target // total) if total else 0
        take = fit(dict(zip(rows["size"].tolist(), rows["c"].tolist(), strict=True)), round(target) - whole * total, seed)
        return pd.DataFrame({"place": rows["place"], "size": rows["size"], "whole": whole, "take": rows["size"].map(take)})

    return run


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7, parts: int = 256, carry: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` as struct ``row`` (of the columns ``carry``, or all), with size, source_size, target, copies and taken.

    A source whose target is at least its size is taken whole, once or twice;
    what its target leaves is filled with one more copy of seeded documents, as
    many of each length as ``fit`` says. Null texts have size 0 and, like all
    empty ones, are never taken; null is a source of its own; repeated rows and
    ids are separate documents; an empty table gives an empty result. Rows with
    equal hash, id and text are interchangeable, so reruns agree.

    Documents are ranked inside (source, length, hash part), and the counts of
    the parts say which are taken whole, so that one source or length with a
    third of all rows is never one group.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    order = F.xxhash64(F.lit(seed), F.col(f"`{id}`"), body)
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in (carry or docs.columns)]).alias("row"), F.col(f"`{source}`").alias("source"), F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"), order.alias("h"))
    sized = scratch.keep(sized, "sized")
    found = sized.groupBy("source").agg(F.sum("size").alias("s"))
    if found.count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    goal = targets([(r["source"], r["s"]) for r in found.collect()], weights, share, most)
    kind = sized.schema["source"].dataType.simpleString()
    goal = spark.createDataFrame([(k, *g) for k, g in enumerate(goal)], f"place int, source {kind}, source_size long, target double")
    placed = sized.join(F.broadcast(goal.withColumnRenamed("source", "s2")), F.col("source").eqNullSafe(F.col("s2"))).drop("s2", "source")
    placed = placed.withColumn("part", F.pmod(F.col("h"), F.lit(parts)).cast("int"))
    counts = scratch.keep(placed.where("size > 0").groupBy("place", "size", "part", "source_size", "target").agg(F.count("*").alias("c")), "counts")
    hist = counts.groupBy("place", "size", "source_size", "target").agg(F.sum("c").alias("c"))
    take = hist.groupBy("place").applyInPandas(_take(seed), "place int, size long, whole int, take long")
    ahead = counts.select("place", "size", "part", "c", (F.sum("c").over(Window.partitionBy("place", "size").orderBy("part")) - F.col("c")).alias("ahead"))
    ahead = ahead.join(take, ["place", "size"]).select("place", "size", "part", "whole", F.least("c", F.greatest(F.lit(0).cast("long"), F.col("take") - F.col("ahead"))).alias("n"), "c")
    ahead = scratch.keep(ahead, "ahead")
    # a row per (source, length, part) has no bound, so this side is never broadcast, at any size
    full = placed.join(ahead.hint("merge"), ["place", "size", "part"], "left")
    rank = F.row_number().over(Window.partitionBy("place", "size", "part").orderBy("h"))
    sure = full.where("size = 0 or n = 0 or n = c").withColumn("copies", F.coalesce(F.col("whole") + F.when(F.col("n") == 0, 0).otherwise(1), F.lit(0)))
    split = full.where("size > 0 and n > 0 and n < c").withColumn("copies", F.col("whole") + (rank <= F.col("n")).cast("int"))
    names = ["row", "size", "source_size", "target", "copies"]
    out = sure.select(*names).unionByName(split.select(*names))
    return out.withColumn("taken", F.col("copies") * F.col("size"))
