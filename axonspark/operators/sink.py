"""Results as text, and the cache of results."""

from __future__ import annotations

import csv
import datetime
import hashlib
import io
import json
import textwrap
import uuid
from collections.abc import Callable, Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonspark.functions.numeric import shown
from axonspark.sources import store

FORMATS = ("table", "csv", "json", "jsonl")


def _cell(x: object) -> str:
    """Null is empty and integral numbers have no point."""
    return "" if x is None else shown(x) if isinstance(x, float) and x == x and abs(x) != float("inf") else str(x)


def rows_of(df: DataFrame) -> list[dict[str, str]]:
    """A (limited) result as text cells."""
    return [{c: _cell(v) for c, v in r.asDict().items()} for r in df.collect()]


def widths(df: DataFrame) -> list[int]:
    """The length of each column's longest cell, by one aggregation."""
    names = [f"c{k}" for k in range(len(df.columns))]

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = [0] * len(names)
        for b in batches:
            most = [max(n, *(len(_cell(x)) for x in c.to_pylist()), 0) for n, c in zip(most, b.columns, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()) for n in most], names=names)

    return list(df.toDF(*names).mapInArrow(longest, ", ".join(f"{n} long" for n in names)).agg(*[F.max(n).alias(n) for n in names]).first())


def stream(df: DataFrame, columns: list[str] | None = None, form: str = "table", few: int = 10_000) -> Iterator[str]:
    """``render`` of a result of any length, in pieces and in its order.

    Rows come a partition at a time. Up to ``few`` are held back: if these are
    all, they are rendered as they are; else the widths of a table are
    aggregated by Spark first.
    """
    rows = ({c: _cell(v) for c, v in r.asDict().items()} for r in df.toLocalIterator(prefetchPartitions=True))
    held = list(islice(rows, few + 1))
    if len(held) <= few:
        yield render(held, columns, form)
        return
    columns = columns or df.columns
    rows = chain(held, rows)
    if form == "json":
        for k, r in enumerate(rows):
            yield ("[\n" if not k else ",\n") + textwrap.indent(json.dumps(r, indent=2), "  ")
        yield "\n]\n"
    elif form == "jsonl":
        for r in rows:
            yield json.dumps(r, separators=(",", ":")) + "\n"
    elif form == "csv":
        out = io.StringIO()
        w = csv.DictWriter(out, columns, extrasaction="ignore")
        w.writeheader()
        for r in rows:
            w.writerow(r)
            yield out.getvalue()
            out.seek(0)
            out.truncate()
    else:
        size = dict(zip(df.columns, widths(df), strict=True))
        line = _lines([max(len(c), size.get(c, 0)) for c in columns])
        yield line(columns) + line(["-" * max(len(c), size.get(c, 0)) for c in columns])
        for r in rows:
            yield line([r.get(c, "") for c in columns])


def _lines(width: list[int]) -> Callable[[list[str]], str]:
    return lambda cells: "  ".join(x.ljust(n) for x, n in zip(cells, width, strict=True)).rstrip() + "\n"


def render(rows: list[dict[str, str]], columns: list[str] | None = None, form: str = "table") -> str:
    """``rows`` in one of FORMATS; without rows and columns there is no output, not even a header."""
    columns = columns if columns is not None else list(rows[0]) if rows else []
    if form == "json":
        return json.dumps(rows, indent=2) + "\n"
    if form == "jsonl":
        return "".join(json.dumps(r, separators=(",", ":")) + "\n" for r in rows)
    if not columns:
        return ""
    if form == "csv":
        out = io.StringIO()
        w = csv.DictWriter(out, columns, extrasaction="ignore")
        w.writeheader()
        w.writerows(rows)
        return out.getvalue()
    width = [max([len(c), *(len(r.get(c, "")) for r in rows)]) for c in columns]
    line = _lines(width)
    return line(columns) + line(["-" * n for n in width]) + "".join(line([r.get(c, "") for c in columns]) for r in rows)


def cache_key(dataset: str, action: str, query: dict) -> str:
    """Twenty hex digits of the checksum of the canonical JSON."""
    text = json.dumps({"dataset": dataset, "action": action, "query": query}, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()[:20]


def payload(arguments: dict) -> dict:
    """The arguments that say something."""
    return {k: v for k, v in arguments.items() if not (v is None or v is False or (hasattr(v, "__len__") and not len(v)))}


def get_or_fetch(spark: SparkSession, root: str, dataset: str, action: str, query: dict, fetch: Callable[[], DataFrame], refresh: bool = False, offline_only: bool = False) -> tuple[DataFrame | None, str]:
    """(result, where from): the cached table if there is one, else the fetched one, which is written; a miss if only the cache may be asked.

    A result is written to a path of its own, and the note that names it is
    replaced last: a refresh that breaks off leaves the old result. The cache
    may be on any store that Spark writes to.
    """
    key = cache_key(dataset, action, query)
    base = f"{root.rstrip('/')}/{dataset}/{action}/{key}"
    note = store.read_text(spark, base + ".json")
    old = json.loads(note)["path"] if note else None
    if old and not refresh:
        return spark.read.parquet(old), "cache"
    if offline_only:
        return None, "miss"
    path = f"{base}-{uuid.uuid4().hex[:12]}.parquet"
    fetch().write.parquet(path)
    out = spark.read.parquet(path)
    made = {"key": key, "dataset": dataset, "action": action, "query": query, "rows": out.count(), "columns": sorted(out.columns), "path": path, "created_at": datetime.datetime.now(datetime.timezone.utc).isoformat()}
    store.write_text(spark, base + ".json", json.dumps(made, indent=2))
    if old:
        store.delete(spark, old)
    return out, "live"


def cached(spark: SparkSession, root: str) -> list[dict]:
    """The notes of all cached results, by path; those that can't be read are skipped."""
    out = []
    for path in store.files(spark, root, ".json"):
        try:
            out.append(json.loads(store.read_text(spark, path)))
        except ValueError:
            continue
    return out
