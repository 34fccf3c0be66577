"""Questions to the derived atlas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axonspark.functions import labels as L
from axonspark.functions.text import ilike
from axonspark.operators.edges import identifier
from axonspark.plans.atlas import TABLES, open_table, published

NEURON_LIST = (
    "dataset", "body_id", "primary_name", "instance", "cell_class", "glomerulus", "side", "regions", "hemispheres", "input_synapses", "output_synapses", "total_synapses", "aliases",
    "top1_nt", "top1_probability", "top2_nt", "top2_probability", "top3_nt", "top3_probability",
)


def select_neurons(neurons: DataFrame, dataset: str | None = None, region: str | None = None, cell_class: str | None = None, glomerulus: str | None = None, contains: str | None = None) -> DataFrame:
    out = neurons.where(F.col("dataset") == dataset) if dataset else neurons
    if region:
        out = out.where(ilike("regions", f"%{region.upper()}%"))
    if cell_class:
        out = out.where(F.col("cell_class") == cell_class.upper())
    if glomerulus:
        out = out.where(F.col("glomerulus") == glomerulus)
    if contains:
        out = out.where(reduce(lambda a, b: a | b, [ilike(c, f"%{contains}%") for c in ("body_id", "primary_name", "instance", "aliases")]))
    return out


def _first(df: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    """The first rows by ``order``; without a limit all rows, and no global sort."""
    return df if limit is None else df.orderBy(*order).limit(limit)


def neuron_list(neurons: DataFrame, limit: int | None = 50, **filters: str | None) -> DataFrame:
    out = select_neurons(neurons, **filters).select(*NEURON_LIST)
    return _first(out, [F.desc("total_synapses"), F.asc("dataset"), F.asc("body_id")], limit)


def projection_neurons(neurons: DataFrame, dataset: str | None = None, glomerulus: str | None = None, limit: int | None = 50) -> DataFrame:
    return neuron_list(neurons, limit, dataset=dataset, cell_class="PN", glomerulus=glomerulus)


def edge_list(edges: DataFrame, dataset: str | None = None, region: str | None = None, pre_id: str | None = None, post_id: str | None = None, min_synapses: int = 1, limit: int | None = 50) -> DataFrame:
    """Strongest edges first; neuropil breaks the last ties."""
    out = edges.where(F.col("synapses") >= min_synapses)
    for c, v in (("dataset", dataset), ("region", region.upper() if region else None), ("pre_id", pre_id), ("post_id", post_id)):
        if v:
            out = out.where(F.col(c) == v)
    out = out.select("dataset", "pre_id", "post_id", "neuropil", "region", "hemisphere", "synapses", "source_table")
    return _first(out, [F.desc("synapses"), *[F.asc(c) for c in ("dataset", "pre_id", "post_id", "neuropil")]], limit)


def _labelled_once(edges: DataFrame, neurons: DataFrame, wanted: Column, some: bool) -> DataFrame:
    """``edges`` from receptor to ``wanted`` projection neurons with the labels of both ends.

    Both joins take the same columns of one relation by the same key, so that it
    is aggregated, and shuffled or sent, once. What is asked of one end alone is
    tied to the edge's dataset: else it would move below its join and make the
    two relations differ.
    """
    names = ("cell_class", "glomerulus", "side", "primary_name")
    cells = neurons.where(F.col("cell_class").isin("ORN", "PN"))
    cells = cells.select(F.col("dataset").alias("of"), "body_id", F.array(*names, F.coalesce(wanted, F.lit(False)).cast("string")).alias("known"))
    tied = lambda c, value: F.concat_ws("/", "dataset", c) == F.concat_ws("/", "dataset", F.lit(value))
    at = lambda end, k: F.col(end)[(*names, "wanted").index(k)]
    e = edges
    for x, key, kind in (("orn", "pre_id", "ORN"), ("pn", "post_id", "PN")):
        end = cells.withColumnsRenamed({"of": f"{x}_of", "body_id": f"{x}_body", "known": x})
        on = (F.col("dataset") == F.col(f"{x}_of")) & (F.col(key) == F.col(f"{x}_body")) & tied(at(x, "cell_class"), kind)
        e = e.join(end, on & tied(at(x, "wanted"), "true") if x == "pn" and some else on).drop(f"{x}_of", f"{x}_body")
    labels = [at("orn", "glomerulus").alias("orn_glomerulus"), at("orn", "side").alias("own_side"), at("pn", "primary_name").alias("pn_name"), at("pn", "glomerulus").alias("glomerulus"), at("pn", "side").alias("pn_side")]
    return e.select("dataset", "pre_id", "post_id", "hemisphere", "synapses", *labels)


def receptor_inputs(edges: DataFrame, neurons: DataFrame, dataset: str | None = None, glomerulus: str | None = None, pn_type: str | None = None, by_side: bool = False, limit: int | None = 50, once: bool = False) -> DataFrame:
    """Receptor neurons onto projection neurons: how many, with how many synapses, and with ``by_side`` on which side.

    ``neurons`` is the derived table, whose scans take the filters on dataset
    and class, or, since an edge proves that its neurons are there, the
    ``labels`` alone, which saves the rollup of all edges. Labels have to be
    aggregated, so with ``once`` both ends join one relation of them.
    """
    e = edges.where(F.col("dataset") == dataset) if dataset else edges
    e = e.select("dataset", "pre_id", "post_id", "hemisphere", "synapses")
    wanted = (F.col("primary_name") == pn_type) | (F.col("instance") == pn_type) | ilike("aliases", f"%{pn_type}%") if pn_type else F.lit(True)
    if once:
        joined = _labelled_once(e, neurons.where(F.col("dataset") == dataset) if dataset else neurons, wanted, bool(pn_type))
    else:
        orn = neurons.where("cell_class = 'ORN'").select("dataset", F.col("body_id").alias("pre_id"), F.col("glomerulus").alias("orn_glomerulus"), F.col("side").alias("own_side"))
        pn = neurons.where("cell_class = 'PN'").where(wanted).select("dataset", F.col("body_id").alias("post_id"), F.col("primary_name").alias("pn_name"), "glomerulus", F.col("side").alias("pn_side"))
        joined = e.join(orn, ["dataset", "pre_id"]).join(pn, ["dataset", "post_id"])
    if glomerulus:
        joined = joined.where((F.col("orn_glomerulus") == glomerulus) | (F.col("glomerulus") == glomerulus))
    keys = ["dataset", F.col("post_id").alias("pn_id"), "pn_name", "glomerulus"]
    made = ["dataset", "pn_id", "pn_name", "glomerulus", "orn_count", "synapses"]
    ties = []
    if by_side:
        orn_side = F.coalesce(F.nullif(F.col("own_side"), F.lit("")), F.nullif(F.col("hemisphere"), F.lit("")), F.lit(""))
        joined = joined.withColumn("orn_side", orn_side)
        keys += ["pn_side", "orn_side", L.relation(F.col("pn_side"), F.col("orn_side")).alias("side_relation")]
        ties = ["pn_side", "orn_side"]
        made += ["pn_side", "orn_side", "side_relation"]
    out = joined.groupBy(*keys).agg(F.count_distinct("pre_id").alias("orn_count"), F.sum("synapses").alias("synapses")).select(*made)
    return _first(out, [F.desc("synapses"), F.asc("dataset"), F.asc("pn_id"), *[F.asc(c) for c in ties]], limit)


def table_counts(spark: SparkSession, prefix: str = "olf") -> list[tuple[str, int]]:
    """Rows of each derived table that exists."""
    prefix = identifier(prefix)
    whole = published(spark, prefix)
    return [(f"{prefix}_{t}", open_table(spark, t, prefix).count()) for t in TABLES if whole or spark.catalog.tableExists(f"{prefix}_{t}")]
