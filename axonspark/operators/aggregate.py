"""Grouped counts, sums and means over text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonspark.functions.numeric import number
from axonspark.operators.predicates import Pairs, cell, first, where


def aggregate(df: DataFrame, by: list[str], sums: list[str] = (), means: list[str] = (), exact: Pairs = (), contains: Pairs = (), limit: int | None = None) -> DataFrame:
    """by, count, sum_*, mean_*; with a limit the first groups in the order of their keys (all but the last ones where it is negative), else all, unordered.

    A mean's denominator counts the cells that aren't empty, so that text which
    isn't a number weighs as 0; a group without such cells has a null mean.
    """
    if not by:
        raise ValueError("a group column is needed")
    kept = where(df, exact, contains)
    keys = [cell(kept, c).alias(c) for c in by]
    made = [F.count("*").alias("count")]
    made += [F.sum(number(cell(kept, c))).alias(f"sum_{c}") for c in sums]
    made += [(F.sum(number(cell(kept, c))) / F.nullif(F.count_if(cell(kept, c) != ""), F.lit(0))).alias(f"mean_{c}") for c in means]
    return first(kept.groupBy(*keys).agg(*made), [F.col(f"`{c}`").asc() for c in by], limit)
