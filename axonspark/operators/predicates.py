"""Filters, projections and limits on tables whose columns may be missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonspark.functions.text import contains_folded

Pairs = list[tuple[str, str]]


def parse_filters(items: list[str]) -> Pairs:
    """``column=value`` texts, split at the first =."""
    out = []
    for item in items:
        column, eq, value = item.partition("=")
        if not eq:
            raise ValueError(f"a filter needs the form column=value: {item}")
        out.append((column, value))
    return out


def split_list(text: str | None) -> list[str]:
    return [x.strip() for x in (text or "").split(",") if x.strip()]


def cell(df: DataFrame, column: str) -> Column:
    """A column as text; a missing column is all empty, and so is a null."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")) if column in df.columns else F.lit("")


def where(df: DataFrame, exact: Pairs = (), contains: Pairs = ()) -> DataFrame:
    """Rows that pass all exact (case-sensitive) and all substring (case-insensitive) conditions."""
    tests = [cell(df, c) == F.lit(v) for c, v in exact] + [contains_folded(cell(df, c), v) for c, v in contains]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def project(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The columns in the order asked for; an unknown one is empty."""
    return df.select(*[cell(df, c).alias(c) for c in columns]) if columns else df


def first(df: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    """The first rows by ``order``; a negative limit leaves out so many at the end. Without a limit all rows, and no global sort."""
    if limit is None:
        return df
    return df.orderBy(*order).limit(limit if limit >= 0 else max(df.count() + limit, 0))


def head(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows, at least one."""
    return df.limit(max(n, 1))


def equal(df: DataFrame, conditions: Pairs = (), columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Typed equality: each text is read as its column's type, so the filter reaches the scan; a text that can't be read matches nothing."""
    for c, v in conditions:
        kind = df.schema[c].dataType.simpleString()
        df = df.where(F.col(f"`{c}`") == (F.lit(v) if kind == "string" else F.lit(v).try_cast(kind)))
    df = df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df
    return df if limit is None else df.limit(limit)


def member(df: DataFrame, exact: dict[str, object] | None = None, within: dict[str, list] | None = None, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Equality and membership filters of a table query."""
    for c, v in (exact or {}).items():
        df = df.where(F.col(f"`{c}`") == F.lit(v))
    for c, v in (within or {}).items():
        df = df.where(F.col(f"`{c}`").isin(list(v)))
    df = df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df
    return df if limit is None else df.limit(limit)


def parse_ids(items: list[str]) -> list[int]:
    """Repeatable, comma-separated ids; anything but digits is an error."""
    out = []
    for x in (y for item in items for y in split_list(item)):
        if not x.isdigit():
            raise ValueError(f"not an id: {x}")
        out.append(int(x))
    return out


def parse_scalar(text: str) -> int | str:
    return int(text) if text.isdigit() else text


def parse_memberships(items: list[str]) -> dict[str, list]:
    return {c: [parse_scalar(x) for x in split_list(v)] for c, v in parse_filters(items)}
