"""Column names that don't clash."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame


def unused(columns: Iterable[str], name: str) -> str:
    """``name``, with underscores before it until no column has it, whatever the case."""
    have = {c.lower() for c in columns}
    while name.lower() in have:
        name = "_" + name
    return name


def apart(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with columns called like ``names`` renamed, and what turns a result back into the columns of ``df``."""
    have, moved = list(df.columns), {}
    for c in df.columns:
        if c.lower() in {n.lower() for n in names}:
            moved[c] = unused([*have, *names, *moved.values()], f"kept_{c}")
    out = df.withColumnsRenamed(moved)
    now = out.columns

    def back(result: DataFrame) -> DataFrame:
        return result.select(*[result[f"`{n}`"].alias(c) for n, c in zip(now, have, strict=True)])

    return out, back
