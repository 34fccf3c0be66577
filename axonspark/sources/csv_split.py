"""CSV files whose quoted fields may hold line breaks, read by many tasks a file.

Spark splits a file into byte ranges at line breaks, and a range can't know by
itself whether it starts inside a quoted field. Each line is a function of that
state (two values in, two out); those of a range are composed where the range is
read, those of the ranges before it by a window over one small row a range. Then
every range knows its state, and a second scan puts lines together to records.
What a range has of a record begun in another one is put together by a group.
Tasks work on whole Arrow batches; lines are tested by regular expressions.

Files without a record over several lines, which the first scan finds out, are
left to Spark's own reader, split as well.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTE = '"'
#: Of types, in order, the first that every value of a column can be.
GUESSES = (("bigint", None), ("double", None), ("boolean", "lower({0}) IN ('true', 'false')"), ("date", "{0} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$'"), ("timestamp", None))

#: So many lines of a file are looked at for types that its columns can't be.
FIRST = 400


def _closing(line: str, at: int) -> int:
    """After the quote that ends a quoted field with text from ``at`` on; -1 if none does. Two quotes are one of the text."""
    while (k := line.find(QUOTE, at)) >= 0:
        if line[k + 1 : k + 2] != QUOTE:
            return k + 1
        at = k + 2
    return -1


def ends_inside(line: str, inside: bool, sep: str = ",") -> bool:
    """Whether the end of a line is inside a quoted field, if its beginning is or isn't. A quote opens a field only at its start."""
    at = 0
    while True:
        if inside or line[at : at + 1] == QUOTE:
            at = _closing(line, at + (not inside))
            if at < 0:
                return True
            inside = False
        at = line.find(sep, at) + 1
        if not at:
            return False


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, block, value): every line with its file and the start of the byte range it was read in, in order inside a range."""
    df = spark.read.option("lineSep", "\n").text(paths)
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _leads(values: pa.Array, sep: str) -> tuple[np.ndarray, np.ndarray]:
    """``ends_inside`` of every line, if its beginning isn't and if it is inside a quoted field. Lines without quotes keep the state."""
    quoted = pa.compute.match_substring(values, QUOTE).to_numpy(zero_copy_only=False)
    zero, one = np.zeros(len(values), bool), np.ones(len(values), bool)
    if not quoted.any():
        return zero, one
    some = values.filter(pa.array(quoted))
    if len(sep.encode()) > 1:
        texts = some.to_pylist()
        found = ([ends_inside(x, inside, sep) for x in texts] for inside in (False, True))
    else:
        other, s = f'[^"{re.escape(sep)}]', re.escape(sep)
        text, rest = '(?:[^"]|"")*', f"(?:{other}[^{s}]*)?"
        opened = f'(?:(?:"{text}")?{rest}{s})*"{text}\\z'
        raw = some.cast(pa.binary())  # so that classes are of bytes
        found = (pa.compute.match_substring_regex(raw, x).to_numpy(zero_copy_only=False) for x in (f"\\A{opened}", f'\\A{text}(?:\\z|"{rest}{s}{opened})'))
    zero[quoted], one[quoted] = found
    return zero, one


def _after(zero: np.ndarray, one: np.ndarray, inside: bool) -> np.ndarray:
    """The state after each line: that of the last line which leads to one from both, turned by each line since that turns it."""
    turns = np.cumsum(zero & ~one)
    last = np.maximum.accumulate(np.where(zero == one, np.arange(len(zero)), -1))
    known = last >= 0
    return np.where(known, zero[last], inside) ^ ((turns - np.where(known, turns[last], 0)) % 2 == 1)


def _runs(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of rows with the same keys."""
    n = len(keys[0])
    cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1 if n else []
    return zip([0, *cuts], [*cuts, n], strict=True) if n else iter(())


def _functions(sep: str):
    """Of lines that hold quotes: the composed function of each range, and whether any of its lines leads into a quoted field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], tuple[bool, bool, bool]] = {}
        for b in batches:
            files, blocks, values = b.columns
            zero, one = _leads(values, sep)
            for i, j in _runs(blocks.to_numpy(zero_copy_only=False), files.dictionary_encode().indices.to_numpy(zero_copy_only=False)):
                key = (files[i].as_py(), blocks[i].as_py())
                low, high, opens = found.get(key, (False, True, False))
                low, high = (bool(_after(zero[i:j], one[i:j], x)[-1]) for x in (low, high))
                found[key] = (low, high, opens or bool(zero[i:j].any()))
        if found:
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "block", "low", "high", "opens"), (*k, *v), strict=True)) for k, v in found.items()], schema=pa.schema([("file", pa.string()), ("block", pa.int64()), ("low", pa.bool_()), ("high", pa.bool_()), ("opens", pa.bool_())]))

    return run


def functions(spark: SparkSession, paths: list[str], sep: str = ",") -> DataFrame:
    """One row a range that has a line with quotes: where it leads from outside (low) and from inside (high) a quoted field."""
    return lines(spark, paths).where(F.contains("value", F.lit(QUOTE))).mapInArrow(_functions(sep), "file string, block long, low boolean, high boolean, opens boolean")


def _kept(df: DataFrame) -> DataFrame:
    """A result of a row a range, worked out once for all scans that use it."""
    return df.sparkSession.createDataFrame(df.toArrow())


def states(spark: SparkSession, paths: list[str], sep: str = ",", found: DataFrame | None = None) -> DataFrame:
    """(source, file, block, inside, open) of every range: the number of its file, whether it begins, and whether the next one begins, inside a quoted field.

    A range without quotes keeps the state. The state before a range follows
    from the last one with a constant function and the number of negations since.
    ``found`` are the functions, if known.
    """
    ranges = lines(spark, paths).select("file", "block").groupBy("file", "block").agg(F.lit(1).alias("one"))
    found = functions(spark, paths, sep) if found is None else found
    all_ = ranges.join(found, ["file", "block"], "left").select("file", "block", F.coalesce("low", F.lit(False)).alias("low"), F.coalesce("high", F.lit(True)).alias("high"))
    order = Window.partitionBy("file").orderBy("block")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turned = all_.withColumn("turns", F.sum((F.col("low") & ~F.col("high")).cast("int")).over(upto))
    last = F.last(F.when(F.col("low") == F.col("high"), F.struct("low", "turns")), ignorenulls=True).over(upto)
    since = F.coalesce(last["turns"], F.lit(0))
    after = turned.withColumn("after", F.coalesce(last["low"], F.lit(False)) != ((F.col("turns") - since) % 2 == 1))
    numbered = F.dense_rank().over(Window.orderBy("file")).alias("source")
    return after.select(numbered, "file", "block", F.coalesce(F.lag("after").over(order), F.lit(False)).alias("inside"), F.col("after").alias("open"))


WHOLE = "source int, number long, record string"
PARTS = "source int, block long, begin boolean, number long, record string"


def _joined(lists: list[pa.Array], ends: np.ndarray) -> pa.Array:
    """Lines to records, which end before the lines ``ends``."""
    values = pa.concat_arrays(lists)
    return pa.compute.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), values), "\n")


def _assemble(sep: str, whole: bool):
    """Lines to records, numbered by their place in the file: those that a range has whole, or its parts of others (begin: the first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[int, int] | None = None
        head, inside, count, held = False, False, 0, []

        def part(lists: list[pa.Array]) -> pa.RecordBatch:
            text = _joined(lists, np.array([sum(map(len, lists))]))
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]]), pa.array([not head]), pa.array([now[1] + count]), text], names=["source", "block", "begin", "number", "record"])

        for b in batches:
            sources, blocks, begins, values = b.columns
            zero, one = _leads(values, sep)
            for i, j in _runs(blocks.to_numpy(zero_copy_only=False), sources.fill_null(-1).to_numpy(zero_copy_only=False)):
                key = (sources[i].as_py(), blocks[i].as_py())
                if key != now:
                    if held and not whole:
                        yield part(held)
                    if key[0] is None:
                        raise RuntimeError("the ranges of a file changed between two scans")
                    now, count, held = key, 0, []
                    head = inside = begins[i].as_py()
                after = _after(zero[i:j], one[i:j], inside)
                inside = bool(after[-1])
                ends = np.flatnonzero(~after) + 1
                here = values.slice(i, j - i)
                if not len(ends):
                    held.append(here)
                    continue
                if whole:
                    texts = _joined([*held, here.slice(0, ends[-1])], ends + sum(map(len, held)))
                    n = len(ends) - head
                    if n:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, now[0], np.int32)), pa.array(now[1] + count + head + np.arange(n)), texts.slice(int(head))], names=["source", "number", "record"])
                elif head:
                    yield part([*held, here.slice(0, ends[0])])
                head, count = False, count + len(ends)
                held = [here.slice(ends[-1])] if ends[-1] < j - i else []
        if held and not whole:
            yield part(held)

    return run


def records(spark: SparkSession, paths: list[str], sep: str = ",", known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(source, number, record) of all records, headers too, where number grows with the place in the file; and (source, file).

    Sent to all tasks is one row a range, 20 bytes and its file's name. Only
    ranges that a record crosses into or out of are read for parts. ``known``
    are the states, if worked out before.
    """
    known = _kept(states(spark, paths, sep)) if known is None else known
    taken = ["source", "block", "inside", "value"]
    placed = lines(spark, paths).join(F.broadcast(known), ["file", "block"], "left")
    whole = placed.select(*taken).mapInArrow(_assemble(sep, True), WHOLE)
    crossed = lines(spark, paths).join(F.broadcast(known.where("inside or open")), ["file", "block"])
    parts = crossed.select(*taken).mapInArrow(_assemble(sep, False), PARTS)
    upto = Window.partitionBy("source").orderBy("block", "number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("begun", F.sum(F.col("begin").cast("int")).over(upto))
    joined = parts.groupBy("source", "begun").agg(F.min_by("number", F.struct("block", "number")).alias("number"), F.sort_array(F.collect_list(F.struct("block", "number", "record"))).alias("all"))
    return whole.unionByName(joined.select("source", "number", F.array_join(F.col("all.record"), "\n").alias("record"))), known.select("source", "file").distinct()


def spans_lines(spark: SparkSession, paths: list[str], sep: str = ",") -> bool:
    """Whether any record lies over several lines, by one scan of the lines that hold quotes."""
    return not functions(spark, paths, sep).where("opens").limit(1).isEmpty()


def _records(values: list[str], sep: str) -> list[str]:
    """The records that lines from the beginning of a file hold to their end."""
    out, held, inside = [], [], False
    for value in values:
        held.append(value)
        inside = ends_inside(value, inside, sep)
        if not inside:
            out.append("\n".join(held))
            held = []
    return out


def header(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """The names in the first record of a file."""
    held: list[str] = []
    size = 1
    while True:
        got = [r.value for r in spark.read.option("lineSep", "\n").text(path).limit(size).collect()]
        inside, held = False, []
        for value in got:
            held.append(value)
            inside = ends_inside(value, inside, sep)
            if not inside:
                break
        if not inside or len(got) < size:
            break
        size *= 4
    text = "\n".join(held).removeprefix("\ufeff").removesuffix("\r")
    return next(csv.reader(io.StringIO(text, newline=""), delimiter=sep), [])


def parsed(found: DataFrame, n: int, sep: str = ",") -> DataFrame:
    """Records as (source, number) and their fields as text, c0 and so on. Empty lines are no records."""
    kind = ", ".join(f"`c{k}` string" for k in range(n))
    record = F.col("record")
    text = F.when(F.endswith(record, F.lit("\r")), F.expr("left(record, length(record) - 1)")).otherwise(record)
    fields = F.from_csv(text, kind, {"sep": sep, "escape": QUOTE, "multiLine": "true"})
    return found.where(F.rtrim(record, F.lit("\r")) != "").select("source", "number", fields.alias("r")).select("source", "number", "r.*")


def read_text(spark: SparkSession, paths: list[str], columns: list[str], sep: str = ",") -> DataFrame:
    """(file, number) and all cells as text of files that share the header ``columns``."""
    found, files = records(spark, paths, sep)
    names = files.withColumnsRenamed({"source": "_source", "file": "_name"})
    cells = parsed(found.where("number > 0"), len(columns), sep)
    return cells.join(F.broadcast(names), F.col("source") == F.col("_source")).select(F.col("_name").alias("file"), "number", *[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)])


def _fits(c: Column, kind: str, only: str | None, name: str) -> Column:
    ok = c.try_cast(kind).isNotNull()
    return F.bool_and(c.isNull() | (ok if only is None else ok & F.expr(only.format(f"`{name}`"))))


def _possible(df: DataFrame, kinds: dict[str, list[int]], none: list[int]) -> dict[str, list[int]]:
    """Those of each column's ``kinds`` (places in GUESSES) that all its values are, by one aggregation; ``none`` for a column without values."""
    tests = [_fits(F.col(f"`{c}`"), *GUESSES[k], c).alias(f"t{i}_{k}") for i, (c, ks) in enumerate(kinds.items()) for k in ks]
    some = [F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, (c, ks) in enumerate(kinds.items()) if ks]
    got = df.agg(*tests, *some).first() if tests else {}
    return {c: [k for k in ks if got[f"t{i}_{k}"]] if ks and got[f"n{i}"] else none for i, (c, ks) in enumerate(kinds.items())}


def typed(df: DataFrame, columns: list[str], first: DataFrame | None = None) -> DataFrame:
    """Text columns cast to the first of GUESSES that all their values are, by one aggregation.

    What a value in the rows ``first`` rules out isn't tried on the others: casts that fail cost much more than those that don't.
    """
    every = list(range(len(GUESSES)))
    kinds = dict.fromkeys(columns, every)
    if first is not None:
        kinds = _possible(first, kinds, every)
    kinds = _possible(df, kinds, [])
    return df.select(*[F.col(f"`{c}`").cast(GUESSES[kinds[c][0]][0] if kinds[c] else "string").alias(c) for c in columns])


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, sep: str = ",") -> DataFrame:
    """One CSV file with a header. Without ``schema`` whole numbers become long, so that ids keep all digits."""
    found = _kept(functions(spark, [path], sep))
    if found.where("opens").isEmpty():
        options = spark.read.option("header", True).option("escape", QUOTE).option("sep", sep)
        if schema:
            return options.schema(schema).csv(path)
        df = options.option("inferSchema", True).csv(path)
        return df.select(*[F.col(f"`{c}`").cast("long").alias(c) if k == "int" else F.col(f"`{c}`") for c, k in df.dtypes])
    columns = header(spark, path, sep)
    known = _kept(states(spark, [path], sep, found))
    named = lambda found: parsed(found, len(columns), sep).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)])
    cells = named(records(spark, [path], sep, known)[0].where("number > 0"))
    if not schema:
        few = [r.value for r in lines(spark, [path]).select("value").limit(FIRST).collect()]
        some = pa.array(_records(few, sep)[1:], pa.string())
        first = pa.table({"source": pa.nulls(len(some), pa.int32()), "number": pa.nulls(len(some), pa.int64()), "record": some})
        return typed(cells, columns, named(spark.createDataFrame(first)))
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return cells.select(*[F.col(f"`{c}`").cast(f.dataType).alias(f.name) for c, f in zip(columns, wanted, strict=False)])
