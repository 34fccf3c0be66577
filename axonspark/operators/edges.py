"""Connection tables: which column plays which role, neighbours, views and layout."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Candidate names of each role, the first that a table has is taken.
PRE = ("pre_pt_root_id", "pre_root_id", "upstream_bodyId", "upstream_bodyid", "bodyId_pre", "bodyid_pre", "pre")
POST = ("post_pt_root_id", "post_root_id", "downstream_bodyId", "downstream_bodyid", "bodyId_post", "bodyid_post", "post")
WEIGHT = ("n_synapses", "syn_count", "weight", "count", "synapses")
ROI = ("neuropil", "roi", "ROI", "region")
#: By folded name: the roles that a column may play, with the place of the name among the candidates.
RANKS: dict[str, list[tuple[str, int]]] = {}
for _role, _names in (("pre", PRE), ("post", POST), ("weight", WEIGHT), ("roi", ROI)):
    for _rank, _name in reversed([*enumerate(_names)]):
        RANKS.setdefault(_name.lower(), []).append((_role, _rank))


@dataclass(frozen=True)
class Roles:
    pre: str
    post: str
    weight: str
    roi: str = ""


def identifier(text: str) -> str:
    """A safe table or view name."""
    return re.sub(r"^(?=\d|$)", "t_", re.sub(r"\W", "_", text))


def roles(columns: list[str]) -> Roles:
    """The roles of a table's columns, by name and whatever the case; pre, post and weight must be there."""
    found: dict[str, tuple[int, str]] = {}
    for c in columns:
        for role, rank in RANKS.get(c.lower(), ()):
            if role not in found or rank <= found[role][0]:
                found[role] = rank, c
    missing = [r for r in ("pre", "post", "weight") if r not in found]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)} among {columns}")
    return Roles(**{role: c for role, (_, c) in found.items()})


def _named(df: DataFrame) -> tuple[DataFrame, bool]:
    r = roles(df.columns)
    cols = [F.col(f"`{r.pre}`").alias("pre_id"), F.col(f"`{r.post}`").alias("post_id"), F.col(f"`{r.weight}`").alias("weight")]
    return df.select(*cols, *([F.col(f"`{r.roi}`").alias("roi")] if r.roi else [])), bool(r.roi)


def edges(df: DataFrame) -> DataFrame:
    """pre_id, post_id, weight and, if there is one, roi."""
    return _named(df)[0]


def connections(df: DataFrame, pre: int | str | None = None, post: int | str | None = None, min_weight: int = 1, limit: int | None = 50) -> DataFrame:
    """The table's own rows from ``pre`` to ``post``, heaviest first; other columns break ties. Without a limit all rows, unordered."""
    r = roles(df.columns)
    for c, v in ((r.pre, pre), (r.post, post)):
        if v is not None:
            df = df.where(F.col(f"`{c}`") == F.lit(v).cast(df.schema[c].dataType))
    df = df.where(F.col(f"`{r.weight}`") >= min_weight)
    rest = [F.col(f"`{c}`").asc_nulls_last() for c in df.columns if c != r.weight]
    return df if limit is None else df.orderBy(F.col(f"`{r.weight}`").desc_nulls_last(), *rest).limit(limit)


def neighbours(df: DataFrame, body: int | str, inputs: bool, min_weight: int = 1, limit: int | None = 50) -> DataFrame:
    """partner_id (and roi) with total_weight and connection_rows; ``min_weight`` is on single rows, before the sum."""
    named, has_roi = _named(df)
    own, other = ("post_id", "pre_id") if inputs else ("pre_id", "post_id")
    by = [F.col(other).alias("partner_id"), *([F.col("roi")] if has_roi else [])]
    kept = named.where((F.col(own) == F.lit(body).cast(named.schema[own].dataType)) & (F.col("weight") >= min_weight))
    out = kept.groupBy(*by).agg(F.sum("weight").alias("total_weight"), F.count("*").alias("connection_rows"))
    return out if limit is None else out.orderBy(F.desc("total_weight"), F.asc("partner_id"), *([F.asc_nulls_last("roi")] if has_roi else [])).limit(limit)


def partners(df: DataFrame, body: int | str, min_weight: int = 1, limit: int | None = 50) -> DataFrame:
    """Inputs and outputs, each with its own limit, tagged by direction."""
    both = [neighbours(df, body, side == "input", min_weight, limit).select(F.lit(side).alias("direction"), "*") for side in ("input", "output")]
    return both[0].unionByName(both[1])


def partner_totals(df: DataFrame) -> DataFrame:
    """body_id, partner_id, direction (and roi) with total_weight and connection_rows, over both ends of each edge."""
    named, has_roi = _named(df)
    roi = ["roi"] if has_roi else []
    ends = F.explode(F.array(F.struct(F.col("pre_id").alias("body_id"), F.col("post_id").alias("partner_id"), F.lit("output").alias("direction")), F.struct(F.col("post_id").alias("body_id"), F.col("pre_id").alias("partner_id"), F.lit("input").alias("direction"))))
    pairs = named.groupBy("pre_id", "post_id", *roi).agg(F.sum("weight").alias("total_weight"), F.count("*").alias("connection_rows"))
    return pairs.select(ends.alias("e"), *roi, "total_weight", "connection_rows").select("e.*", *roi, "total_weight", "connection_rows")


def create_views(spark: SparkSession, table: str, prefix: str | None = None) -> list[str]:
    """Registers ``{prefix}_edges`` and ``{prefix}_partners`` over a connection table."""
    prefix = identifier(prefix or table)
    df = spark.table(identifier(table))
    edges(df).createOrReplaceTempView(f"{prefix}_edges")
    partner_totals(df).createOrReplaceTempView(f"{prefix}_partners")
    return [f"{prefix}_edges", f"{prefix}_partners"]


def buckets_for(size: int, each: int = 256 << 20) -> int:
    """A power of two of buckets for ``size`` bytes, so that each holds about ``each``: at least 8, at most 65,536."""
    return 1 << min(16, max(3, (-(-size // each) - 1).bit_length()))


def _place(df: DataFrame, column: str, bits: int) -> tuple[DataFrame, str]:
    """``df`` with the place of a column's value among 2**bits parts of about as many rows each, by quantiles from one sketch."""
    name = f"__{column}_place"
    kind = df.schema[column].dataType
    # numbers as they are; of texts the first seven bytes, in the same order
    key = F.col(f"`{column}`").cast("double") if isinstance(kind, T.NumericType) else F.conv(F.rpad(F.hex(F.substring(F.col(f"`{column}`").cast("string"), 1, 7)), 14, "0"), 16, 10).cast("double")
    n = 1 << bits
    cuts = df.agg(F.percentile_approx(key, [k / n for k in range(1, n)], 10_000)).first()[0]
    splits = [float("-inf"), *sorted(set(cuts or [0.0])), float("inf")]
    keyed = df.withColumn("__key", F.coalesce(key, F.lit(0.0)))
    return Bucketizer(splits=splits, inputCol="__key", outputCol=name, handleInvalid="keep").transform(keyed).drop("__key"), name


def interleaved(a: Column, b: Column, bits: int) -> Column:
    """The bits of two numbers in turn: places that are near by it are near in both (Morton order)."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        for shift, x in ((2 * k, a), (2 * k + 1, b)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(x.cast("long"), k).bitwiseAND(F.lit(1).cast("long")), shift))
    return out


def by_both_ends(df: DataFrame, a: str, b: str, bits: int = 8) -> DataFrame:
    """``df`` dealt and sorted so that every stretch of rows has few values of ``a`` and few of ``b``. A hub's rows are dealt to several parts."""
    placed, x = _place(df, a, bits)
    placed, y = _place(placed, b, bits)
    order = [interleaved(F.col(f"`{x}`"), F.col(f"`{y}`"), bits), F.col(f"`{a}`"), F.col(f"`{b}`")]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).drop(x, y)


def optimize(spark: SparkSession, table: str, prefix: str | None = None, buckets: int | None = None, how: str = "both", group_bytes: int = 8 << 20) -> list[dict[str, str]]:
    """Lays the table out for neighbour queries, and computes column statistics.

    ``both``: one copy in Morton order of its ends, with Bloom filters of both
    and row groups of ``group_bytes``, so that a lookup by either end skips
    nearly all of them. ``buckets``: two copies, bucketed (as many buckets as
    the size asks for) and sorted by either end, over which aggregations by that
    end plan no exchange.
    """
    table = identifier(table)
    prefix = identifier(prefix or table)
    df = spark.table(table)
    r = roles(df.columns)
    done = []
    if how == "both":
        name = f"{prefix}_by_both"
        w = by_both_ends(df, r.pre, r.post).write.mode("overwrite").format("parquet").option("parquet.block.size", group_bytes).option("parquet.bloom.filter.adaptive.enabled", "true")
        for c in (r.pre, r.post):
            w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
        w.saveAsTable(name)
        done.append({"action": "order", "name": name, "column": f"{r.pre},{r.post}"})
    else:
        buckets = buckets or buckets_for(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
        for role, c in (("pre", r.pre), ("post", r.post)):
            name = f"{prefix}_by_{role}"
            df.repartition(buckets, c).write.mode("overwrite").bucketBy(buckets, c).sortBy(c).format("parquet").saveAsTable(name)
            done.append({"action": "bucket", "name": name, "column": c})
    for name in (table, *[x["name"] for x in done]):
        spark.sql(f"ANALYZE TABLE `{name}` COMPUTE STATISTICS FOR ALL COLUMNS")
        done.append({"action": "analyze", "name": name, "column": ""})
    return done
