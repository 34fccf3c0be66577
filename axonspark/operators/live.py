"""Questions that go to live services elsewhere, here to tables of the session."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonspark.operators.predicates import member

# The synapse table and its columns.
SYNAPSES, SYNAPSE_COLUMNS = "synapses_nt_v1", ("id", "pre_pt_root_id", "post_pt_root_id")


def neurons(df: DataFrame, ids: list[int] | None = None, type_contains: str | None = None, instance_contains: str | None = None, limit: int | None = 20) -> DataFrame:
    """By id and by substrings of type and instance; with a limit the first by type, instance and id."""
    out = df.where(F.col("bodyId").isin(ids)) if ids else df
    for c, v in (("type", type_contains), ("instance", instance_contains)):
        if v:
            out = out.where(F.lower(c).contains(v.lower()))
    return out if limit is None else out.orderBy(F.asc_nulls_last("type"), F.asc_nulls_last("instance"), F.asc("bodyId")).limit(limit)


def connections(edges: DataFrame, cells: DataFrame, upstream: list[int] | None = None, downstream: list[int] | None = None, min_weight: int = 1, limit: int | None = 50) -> DataFrame:
    """One hop with both ends' types, heaviest first. ``edges`` has pre_id, post_id and weight; filters apply before the joins."""
    e = edges.where(F.col("weight") >= min_weight)
    e = e.where(F.col("pre_id").isin(upstream)) if upstream else e
    e = e.where(F.col("post_id").isin(downstream)) if downstream else e
    up = cells.select(F.col("bodyId").alias("pre_id"), F.col("type").alias("upstream_type"), F.col("instance").alias("upstream_instance"))
    down = cells.select(F.col("bodyId").alias("post_id"), F.col("type").alias("downstream_type"), F.col("instance").alias("downstream_instance"))
    out = e.join(up, "pre_id").join(down, "post_id")
    out = out.select(F.col("pre_id").alias("upstream_bodyId"), "upstream_type", "upstream_instance", F.col("post_id").alias("downstream_bodyId"), "downstream_type", "downstream_instance", "weight")
    return out if limit is None else out.orderBy(F.desc("weight"), *[F.asc_nulls_last(c) for c in out.columns if c != "weight"]).limit(limit)


def hops(found: DataFrame, upstream: list[int] | None = None, downstream: list[int] | None = None, min_weight: int = 1, limit: int | None = 50) -> DataFrame:
    """Connections as a service gives them, both ends already named: the filters reach the request, heaviest first."""
    out = found.where(F.col("weight") >= min_weight)
    out = out.where(F.col("upstream_bodyId").isin(upstream)) if upstream else out
    out = out.where(F.col("downstream_bodyId").isin(downstream)) if downstream else out
    return out if limit is None else out.orderBy(F.desc("weight"), "upstream_bodyId", "downstream_bodyId").limit(limit)


def statement(spark: SparkSession, text: str, limit: int | None = None) -> DataFrame:
    """A statement as it is; the limit applies unless the text has one."""
    out = spark.sql(text)
    return out if limit is None or re.search(r"\slimit\s", text, re.I) else out.limit(limit)


def table(spark: SparkSession, name: str, exact: dict | None = None, within: dict | None = None, columns: list[str] | None = None, limit: int | None = 50, version: int | None = None) -> DataFrame:
    """A table by name (and version suffix) with equality and membership filters."""
    return member(spark.table(f"{name}_v{version}" if version is not None else name), exact, within, columns, limit)


def synapse_filters(pre: list[int] | None, post: list[int] | None) -> dict[str, list[int]]:
    return {c: v for c, v in zip(SYNAPSE_COLUMNS[1:], (pre, post), strict=True) if v}


def synapses(spark: SparkSession, pre: list[int] | None = None, post: list[int] | None = None, limit: int | None = 50, version: int | None = None) -> DataFrame:
    return table(spark, SYNAPSES, None, synapse_filters(pre, post), list(SYNAPSE_COLUMNS), limit, version)


def table_names(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())
