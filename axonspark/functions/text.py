"""Text predicates with exact, literal semantics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: LIKE patterns from users carry no escape character; this one never occurs in text.
NO_ESCAPE = "\u0001"


def contains_folded(c: Column, needle: str) -> Column:
    """Case-insensitive literal substring; null counts as the empty text."""
    return F.lower(F.coalesce(c, F.lit(""))).contains(needle.lower())


def ilike(name: str, pattern: str) -> Column:
    """``name`` ILIKE ``pattern`` where % and _ are wildcards and nothing escapes them."""
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    return F.expr(f"`{name}` ILIKE '{quoted}' ESCAPE '\\u0001'")


def listed(values: Column, separator: str = ",") -> Column:
    """The sorted distinct values of an array in one string; null only if there is no value. Empty strings take part."""
    some = F.filter(values, lambda x: x.isNotNull())
    return F.when(F.size(some) > 0, F.array_join(F.array_sort(F.array_distinct(some)), separator))


def literal(text: str) -> str:
    """An SQL literal of a text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def flags_sql(c: str, values: Sequence[str], low: int = 0) -> str:
    """A number with one bit, from ``low`` on, for the place of the text in ``values``; 0 for others. ``bit_or`` of it is a set."""
    return f"CASE {c} " + " ".join(f"WHEN {literal(v)} THEN {1 << k}L" for k, v in enumerate(values, low)) + " ELSE 0L END" if values else "0L"


def flagged(bits: str, values: Sequence[str], low: int = 0, separator: str = ",") -> Column:
    """The values in a set of ``flags_sql``, joined; null for the empty set."""
    some = ", ".join(f"CASE WHEN {bits} & {1 << k}L <> 0 THEN {literal(v)} END" for k, v in enumerate(values, low))
    mask = sum(1 << k for k in range(low, low + len(values)))
    return F.expr(f"CASE WHEN {bits} & {mask}L <> 0 THEN concat_ws({literal(separator)}, {some}) END" if values else "CAST(NULL AS STRING)")
