"""Searches over families of summary tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonspark.functions.text import contains_folded
from axonspark.operators.aggregate import aggregate
from axonspark.operators.predicates import cell
from axonspark.sources.catalog import Catalog, Table

# Table families and columns in order of preference.
FAMILIES = ("full_summary", "ln_observations_by_hemisphere", "flywire_ln_aliases", "flywire_ln_nt_top3_by_hemisphere", "matched_ln_class_similarity", "ln_class_inventory", "shared_type_comparison")
PREFERRED = ("LN_type", "combined_LN_type", "comparison_name", "recommended_match_group", "primary_flywire_name", "hemibrain_type_names", "all_names", "bodyId", "root_id", "source_root_id")
SHOWN = ("LN_type", "combined_LN_type", "comparison_name", "recommended_match_group", "bodyId", "root_id", "hemisphere", "input_preference", "top_nt", "top_nt_conf")
COMPARED = ("LN_class", "flywire_raw_LN_types", "flywire_primary_flywire_names", "flywire_hemibrain_types")


def any_contains(df: DataFrame, columns: tuple[str, ...], needle: str) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [contains_folded(cell(df, c), needle) for c in columns]))


def local_neurons(df: DataFrame, needle: str, limit: int | None = 200) -> DataFrame:
    """Rows of a table with _rank, _dataset, _table, _file and _ordinal in which a preferred column contains ``needle``; the first such column is reported. With a limit the first rows in that order, else all, unordered."""
    hits = [F.when(contains_folded(cell(df, c), needle), F.struct(F.lit(c).alias("c"), cell(df, c).alias("v"))) for c in PREFERRED]
    found = df.select("*", F.coalesce(*hits).alias("_hit")).where("_hit is not null")
    shown = [cell(df, c).alias(c) for c in SHOWN]
    found = found if limit is None else found.orderBy("_rank", "_file", "_ordinal").limit(max(limit, 1))
    return found.select(F.col("_dataset").alias("dataset"), F.col("_table").alias("file_id"), F.col("_hit.c").alias("matched_column"), F.col("_hit.v").alias("matched_value"), *shown)


def ranked_tables(catalog: Catalog, dataset: str | None = None) -> list[tuple[int, Table]]:
    out = []
    for t in catalog.tables(dataset):
        rank = next((k for k, f in enumerate(FAMILIES) if f in t.relative_path.lower()), None)
        if rank is not None:
            out.append((rank, t))
    return sorted(out, key=lambda x: (x[0], x[1].relative_path))


def find_local_neurons(catalog: Catalog, needle: str, dataset: str | None = None, limit: int | None = 200) -> DataFrame | None:
    """``local_neurons`` over all tables of the families; None if there is no such table.

    With a limit the families are asked in order, each for as many rows as are
    still wanted; once there are enough, later ones aren't opened.
    """
    ranked = ranked_tables(catalog, dataset)
    if not ranked:
        return None
    if limit is None:
        return local_neurons(_family(catalog, ranked), needle, None)
    wanted, found = max(limit, 1), []
    for rank in sorted({k for k, _ in ranked}):
        df = local_neurons(_family(catalog, [x for x in ranked if x[0] == rank]), needle, wanted)
        rows = df.collect()  # no more than are wanted
        found.append(catalog.spark.createDataFrame(rows, df.schema))
        wanted -= len(rows)
        if wanted <= 0:
            break
    return reduce(DataFrame.unionByName, found)


def _family(catalog: Catalog, ranked: list[tuple[int, Table]]) -> DataFrame:
    ranks = catalog.spark.createDataFrame([(t.relative_path, k) for k, t in ranked], "_file string, _rank int")
    return catalog.open(*[t for _, t in ranked]).join(F.broadcast(ranks), "_file")


def compare(df: DataFrame, needle: str) -> DataFrame:
    return any_contains(df, COMPARED, needle)


def partners_by_root(df: DataFrame, needle: str, kind: str, limit: int | None = None) -> DataFrame:
    """Summed synapses of the rows whose type, instance or root id contains ``needle``."""
    by = ["source_root_id", "LN_type", "analysis_hemisphere", "glomerulus", "input_relation" if kind == "orn" else "cell_sub_class"]
    return aggregate(any_contains(df, ("LN_type", "LN_instance", "source_root_id"), needle), by, ["n_synapses"], limit=limit)


def partners_by_file(df: DataFrame, kind: str, limit: int | None = None) -> DataFrame:
    """Summaries of the per-neuron tables; ``df`` has their rows and, for pn, the column table."""
    if kind == "orn":
        return aggregate(df, ["LN_instance", "LN_bodyid", "glomerulus"], ["n_inputs", "n_ipsi_inputs", "n_contra_inputs"], limit=limit)
    return aggregate(df, ["table", "glomerulus"], ["weight", "LN_total_connections"], ["LN_to_PN_perct"], limit=limit)


def find_partners(catalog: Catalog, dataset: str, name: str, kind: str, limit: int | None = 100) -> DataFrame | None:
    """Partner summaries by dataset; every collection whose name holds the family's is read, its variants too."""
    if dataset == "flywire":
        t = catalog.resolve(f"flywire:source_audit/{kind}_partner_counts_by_hemisphere")
        return partners_by_root(catalog.open(t), name, kind, limit)
    family = "ln_orn_by_glomerulus" if kind == "orn" else "ln_to_pn_connections"
    chosen = [t for t in catalog.tables("hemibrain") if family in t.collection and name.lower() in t.relative_path.lower()]
    return partners_by_file(catalog.open(*chosen).withColumnRenamed("_table", "table"), kind, limit) if chosen else None
