"""The derived atlas: region edges, membership, neurons with labels, totals and provenance.

The build is one plan. Annotations that elsewhere would be updates in place are
aggregated to one row an id and joined once, so no join multiplies rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonspark.functions import labels as L
from axonspark.functions.text import flagged, flags_sql, listed
from axonspark.operators.edges import identifier
from axonspark.sources import store


@dataclass(frozen=True)
class Spec:
    """A dataset's connection table and its columns."""

    dataset: str
    table: str
    pre: str
    post: str
    roi: str
    weight: str


# Where each dataset's connections are, and the names of the derived tables.
SPECS = (
    Spec("hemibrain", "hemibrain_traced_roi_connections", "bodyId_pre", "bodyId_post", "roi", "weight"),
    Spec("flywire", "flywire_proofread_connections", "pre_pt_root_id", "post_pt_root_id", "neuropil", "syn_count"),
)
TABLES = ("provenance", "edges_by_neuropil", "edges_total", "neuropil_membership", "neurons", "annotations")
#: What the rows of a written table are sorted by inside each file.
ORDER = {"edges_by_neuropil": ("pre_id", "post_id"), "edges_total": ("pre_id", "post_id"), "neuropil_membership": ("body_id",), "neurons": ("cell_class", "glomerulus"), "annotations": ("body_id",)}
NEURON_COLUMNS = (
    "dataset", "body_id", "regions", "hemispheres", "input_synapses", "output_synapses", "total_synapses", "primary_name", "instance", "cell_class", "glomerulus", "side", "aliases",
    "top1_nt", "top1_probability", "top2_nt", "top2_probability", "top3_nt", "top3_probability",
)
ANNOTATION_COLUMNS = ("dataset", "body_id", "primary_name", "instance", "cell_class", "glomerulus", "side", "aliases", "top1_nt", "top1_probability", "top2_nt", "top2_probability", "top3_nt", "top3_probability")


def edges_by_neuropil(raw: DataFrame, spec: Spec) -> DataFrame:
    """Edges with positive weight inside the three regions."""
    roi, weight = f"CAST(`{spec.roi}` AS STRING)", f"`{spec.weight}`"
    if dict(raw.dtypes)[spec.weight] not in ("bigint", "int", "smallint", "tinyint"):
        weight = f"bround(CAST({weight} AS DOUBLE), 0)"  # half to even
    out = raw.selectExpr(
        f"'{spec.dataset}' AS dataset", f"CAST(`{spec.pre}` AS STRING) AS pre_id", f"CAST(`{spec.post}` AS STRING) AS post_id", f"{roi} AS neuropil",
        f"{L.region_sql(roi)} AS region", f"{L.hemisphere_sql(roi)} AS hemisphere", f"CAST({weight} AS BIGINT) AS synapses", f"'{spec.table}' AS source_table",
    )
    return out.where("region <> '' and synapses > 0")


def ends(edges: DataFrame) -> DataFrame:
    """Each edge at both of its neurons, from one scan: what it adds to their inputs and outputs."""
    rows = edges.selectExpr("dataset", "neuropil", "region", "hemisphere", "inline(array(struct(post_id AS body_id, synapses AS input_synapses, 0L AS output_synapses), struct(pre_id AS body_id, 0L AS input_synapses, synapses AS output_synapses)))")
    return rows.selectExpr("dataset", "body_id", "neuropil", "region", "hemisphere", "input_synapses", "output_synapses", "input_synapses + output_synapses AS total_synapses")


def membership(edges: DataFrame) -> DataFrame:
    """Synapses of each neuron in each neuropil, by direction."""
    return ends(edges).groupBy("dataset", "body_id", "neuropil", "region", "hemisphere").agg(*[F.sum(c).alias(c) for c in ("input_synapses", "output_synapses", "total_synapses")])


def neurons(members: DataFrame) -> DataFrame:
    """One row per neuron with its regions and hemispheres, annotation columns still empty.

    ``members`` is the membership table where that has been written, else the
    edges' ends, which saves a shuffle.
    """
    bits = F.bit_or(L.traits()).alias("bits")
    sums = ("input_synapses", "output_synapses", "total_synapses")
    out = members.groupBy("dataset", "body_id").agg(bits, *[F.sum(c).alias(c) for c in sums])
    out = out.select("dataset", "body_id", L.regions("bits").alias("regions"), L.hemispheres("bits").alias("hemispheres"), *sums)
    empty = [F.lit("").alias(c) for c in ("primary_name", "instance", "cell_class", "glomerulus", "side", "aliases")]
    none = [x for k in (1, 2, 3) for x in (F.lit("").alias(f"top{k}_nt"), F.lit(None).cast("double").alias(f"top{k}_probability"))]
    return out.select("*", *empty, *none)


def labels(instances: DataFrame | None = None, hierarchy: DataFrame | None = None, tags: DataFrame | None = None) -> DataFrame | None:
    """(dataset, body_id) with primary_name, instance, cell_class, glomerulus, side and aliases of every annotated id, from one aggregation of all sources.

    ``instances`` (bodyId, type, instance) name the first dataset; of repeated
    ids the smallest (type, instance) is taken. In the second the values of
    ``hierarchy`` (pt_root_id, classification_system, cell_type) come first, and
    ``tags`` (pt_root_id, tag) fill what these leave empty and are appended to
    the aliases. None without any source.
    """
    parts = []
    for df, key, dataset, source, x, y in (
        (instances, "bodyId", "hemibrain", "instance", "type", "instance"),
        (hierarchy, "pt_root_id", "flywire", "value", "cell_type", "classification_system"),
        (tags, "pt_root_id", "flywire", "tag", "tag", "NULL"),
    ):
        if df is not None:
            parts.append(df.where(f"{key} IS NOT NULL").selectExpr(f"'{dataset}' AS dataset", f"CAST({key} AS STRING) AS body_id", f"'{source}' AS source", f"CAST({x} AS STRING) AS a", f"CAST({y} AS STRING) AS b"))
    if not parts:
        return None
    one = reduce(DataFrame.unionByName, parts).groupBy("dataset", "body_id").agg(
        F.expr("min(CASE WHEN source = 'instance' THEN struct(coalesce(a, ''), coalesce(b, ''), a AS t, b AS i) END)").alias("least"),
        F.expr("collect_set(CASE WHEN source <> 'instance' THEN struct(source, a) END)").alias("values"),
        F.expr("min(CASE WHEN source = 'value' AND b = 'cell_type' THEN a END)").alias("p"),
        F.expr("min(CASE WHEN source = 'value' AND b = 'cell_class' THEN a END)").alias("k"),
    )
    some = lambda source: f"transform(filter(values, x -> x.source = '{source}' AND x.a IS NOT NULL), x -> x.a)"
    joined = lambda source: f"CASE WHEN size({some(source)}) > 0 THEN array_join(array_sort({some(source)}), '; ') END"
    one = one.selectExpr("dataset", "body_id", "least.t AS t", "least.i AS i", "least IS NOT NULL AS named", "p", "k", f"{joined('value')} AS n", f"{joined('tag')} AS g", "exists(values, x -> x.source = 'tag') AS hit")
    one = one.selectExpr("*", "coalesce(t, i, '') AS ti", "coalesce(i, t, '') AS it", "coalesce(p, n, '') AS first", "coalesce(k, p, n, '') AS of_class")
    by = lambda f, own, first: f"CASE WHEN named THEN {f(own)} ELSE coalesce(nullif({f(first)}, ''), CASE WHEN g IS NOT NULL THEN {f('g')} ELSE '' END) END"
    return one.selectExpr(
        "dataset", "body_id",
        "CASE WHEN named THEN coalesce(t, '') ELSE coalesce(nullif(p, ''), split_part(g, ';', 1), '') END AS primary_name",
        "coalesce(i, '') AS instance",
        f"{by(L.cell_class_sql, 'ti', 'of_class')} AS cell_class",
        f"{by(L.glomerulus_sql, 'ti', 'first')} AS glomerulus",
        f"{by(L.side_sql, 'it', 'first')} AS side",
        "CASE WHEN named THEN coalesce(t, '') WHEN NOT hit THEN coalesce(n, '') ELSE trim(concat_ws('; ', nullif(n, ''), g)) END AS aliases",
    )


def annotate(base: DataFrame, **sources: DataFrame | None) -> DataFrame:
    """The neurons ``base`` with the ``labels`` of ``sources``: one join, and none without a source."""
    found = labels(**sources)
    if found is None:
        return base
    names = ("primary_name", "instance", "cell_class", "glomerulus", "side", "aliases")
    joined = base.drop(*names).join(found, ["dataset", "body_id"], "left")
    return joined.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in names else F.col(c) for c in NEURON_COLUMNS])


#: Neuropils and source tables are sets of bits, in words of so many, up to so many words; more of them are sets of texts.
WORD, WORDS = 48, 8


def edges_total(edges: DataFrame) -> DataFrame:
    """One row a pair of neurons.

    The names of neuropils are few: they are looked up once, and a pair's lists
    are then numbers with a bit a name, which aggregate by hash as sums do.
    """
    keys = ("dataset", "pre_id", "post_id")
    known = edges.select("neuropil", "source_table").distinct().limit(WORD * WORDS + 1).collect()
    neuropils, sources = (sorted({r[c] for r in known if r[c] is not None}) for c in ("neuropil", "source_table"))
    total = F.sum("synapses").alias("synapses")
    if len(known) > WORD * WORDS or len(sources) > WORD:
        out = edges.groupBy(*keys).agg(F.collect_set("neuropil").alias("n"), F.collect_set("source_table").alias("s"), F.bit_or(L.traits()).alias("bits"), total)
        n, s = listed(F.col("n")), listed(F.col("s"))
    else:
        words = [neuropils[k : k + WORD] for k in range(0, len(neuropils), WORD)]
        made = [F.expr(f"bit_or({flags_sql('neuropil', w)})").alias(f"w{k}") for k, w in enumerate(words)]
        bits = L.traits()
        out = edges.groupBy(*keys).agg(*made, F.expr(f"bit_or({flags_sql('source_table', sources)})").alias("s"), F.bit_or(bits).alias("bits"), total)
        n = F.nullif(F.concat_ws(",", *[flagged(f"w{k}", w) for k, w in enumerate(words)]), F.lit(""))
        s = flagged("s", sources)
    return out.select(*keys, n.alias("neuropils"), L.regions("bits").alias("regions"), L.hemispheres("bits").alias("hemispheres"), "synapses", s.alias("source_tables"))


def provenance(raw: dict[str, DataFrame], edges: DataFrame, store: str = "") -> DataFrame:
    """Rows read and rows kept per source; a missing source isn't listed."""
    spark = edges.sparkSession
    read = [df.agg(F.count("*").alias("source_rows")).select(F.lit(s.dataset).alias("dataset"), F.lit(s.table).alias("source_table"), "source_rows") for s in SPECS if (df := raw.get(s.dataset)) is not None]
    if not read:
        return spark.createDataFrame([], "dataset string, source_table string, source_rows long, imported_rows long, status string, store string")
    kept = edges.groupBy("dataset").agg(F.count("*").alias("imported_rows"))
    return reduce(DataFrame.unionByName, read).join(kept, "dataset", "left").select("dataset", "source_table", "source_rows", F.coalesce("imported_rows", F.lit(0).cast("long")).alias("imported_rows"), F.lit("imported").alias("status"), F.lit(store).alias("store"))


def build(raw: dict[str, DataFrame], instances: DataFrame | None = None, hierarchy: DataFrame | None = None, tags: DataFrame | None = None, store: str = "") -> dict[str, DataFrame]:
    """The six derived tables of the given connection tables (by dataset) and annotation sources."""
    parts = [edges_by_neuropil(raw[s.dataset], s) for s in SPECS if s.dataset in raw]
    if not parts:
        raise ValueError("no connection table")
    edges = reduce(DataFrame.unionByName, parts)
    cells = annotate(neurons(ends(edges)), instances=instances, hierarchy=hierarchy, tags=tags)
    return {"provenance": provenance(raw, edges, store), "edges_by_neuropil": edges, "edges_total": edges_total(edges), "neuropil_membership": membership(edges), "neurons": cells, "annotations": cells.select(*ANNOTATION_COLUMNS)}


# Where annotations are looked for, in order of preference.
INSTANCE_TABLES = ("hemibrain_olfaction_neuron_annotations", "hemibrain_traced_neurons")
HIERARCHY_TABLE, TAG_TABLE = "flywire_hierarchical_neuron_annotations", "flywire_neuron_information_v2"


def _pointer(spark: SparkSession, prefix: str) -> str:
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{prefix}_atlas.current"


def published(spark: SparkSession, prefix: str = "olf") -> str | None:
    """The version of the atlas that readers see."""
    return store.read_text(spark, _pointer(spark, identifier(prefix)))


def open_table(spark: SparkSession, table: str, prefix: str = "olf") -> DataFrame:
    """A derived table of the published version."""
    prefix = identifier(prefix)
    version = published(spark, prefix)
    return spark.table(f"{prefix}_{table}__{version}" if version else f"{prefix}_{table}")


def _publish(spark: SparkSession, prefix: str, version: str) -> None:
    """Makes a version whose tables are all written the one that readers see: the pointer turns in one step, the plain names follow."""
    store.write_text(spark, _pointer(spark, prefix), version)
    _name(spark, prefix, version)


def _name(spark: SparkSession, prefix: str, version: str) -> None:
    """The plain names as views of a version."""
    for t in TABLES:
        name = f"{prefix}_{t}"
        if spark.catalog.tableExists(name) and spark.catalog.getTable(name).tableType not in ("VIEW", "TEMPORARY"):
            spark.sql(f"DROP TABLE `{name}`")
        spark.sql(f"CREATE OR REPLACE VIEW `{name}` AS SELECT * FROM `{name}__{version}`")


def _sweep(spark: SparkSession, prefix: str, *kept: str | None) -> None:
    """Drops the tables of all versions but ``kept``, those of builds that broke off too."""
    for found in spark.catalog.listTables():
        stem, mark, version = found.name.rpartition("__")
        if mark and version not in kept and stem in {f"{prefix}_{t}" for t in TABLES}:
            spark.sql(f"DROP TABLE IF EXISTS `{found.name}`")


def build_tables(spark: SparkSession, datasets: tuple[str, ...] = ("hemibrain", "flywire"), replace: bool = True, prefix: str = "olf") -> list[dict[str, str]]:
    """Writes the derived tables of the session's catalog; returns a row per source, then per table.

    Edges and neurons are written first and read back by what depends on them,
    partitioned by dataset and sorted in each file by what questions filter on,
    so that their statistics skip row groups. A rebuild holds only the chosen
    datasets. All tables of a build belong to one version, which readers see
    once the last is written: a build that breaks off leaves the old atlas whole.
    """
    prefix = identifier(prefix)
    have = spark.catalog.tableExists
    rows, raw = [], {}
    old = published(spark, prefix)
    if old and have(f"{prefix}_neurons__{old}"):
        _name(spark, prefix, old)  # the last build may have ended between the pointer and the names
    if (old or have(f"{prefix}_neurons")) and not replace:
        return [{"dataset": "all", "table": f"{prefix}_{t}", "rows": str(open_table(spark, t, prefix).count()), "status": "built"} for t in TABLES if old or have(f"{prefix}_{t}")]
    for s in SPECS:
        if s.dataset in datasets and have(s.table):
            raw[s.dataset] = spark.table(s.table)
    found = lambda *names: next((spark.table(n) for n in names if have(n)), None)
    for s in SPECS:
        if s.dataset in datasets and s.dataset not in raw:
            rows.append({"dataset": s.dataset, "table": s.table, "rows": "0", "status": "missing"})
    if not raw:
        return rows
    version = uuid.uuid4().hex[:12]
    name = lambda t: f"{prefix}_{t}__{version}"
    _sweep(spark, prefix, old)

    def write(t: str, df: DataFrame) -> DataFrame:
        w = df.sortWithinPartitions("dataset", *ORDER[t]).write.format("parquet") if t in ORDER else df.write.format("parquet")
        (w.partitionBy("dataset") if "dataset" in df.columns and t != "provenance" else w).saveAsTable(name(t))
        spark.sql(f"ANALYZE TABLE `{name(t)}` COMPUTE STATISTICS")
        return spark.table(name(t)).select(*df.columns)

    edges = write("edges_by_neuropil", reduce(DataFrame.unionByName, [edges_by_neuropil(raw[s.dataset], s) for s in SPECS if s.dataset in raw]))
    members = write("neuropil_membership", membership(edges))
    cells = write("neurons", annotate(neurons(members), instances=found(*INSTANCE_TABLES), hierarchy=found(HIERARCHY_TABLE), tags=found(TAG_TABLE)))
    write("annotations", cells.select(*ANNOTATION_COLUMNS))
    write("edges_total", edges_total(edges))
    write("provenance", provenance(raw, edges))
    _publish(spark, prefix, version)
    kept = {r["dataset"]: r["n"] for r in edges.groupBy("dataset").agg(F.count("*").alias("n")).collect()}
    rows = [{"dataset": s.dataset, "table": s.table, "rows": str(kept.get(s.dataset, 0)) if s.dataset in raw else "0", "status": "imported" if s.dataset in raw else "missing"} for s in SPECS if s.dataset in datasets]
    return rows + [{"dataset": "all", "table": f"{prefix}_{t}", "rows": str(spark.table(name(t)).count()), "status": "built"} for t in TABLES]


def limit_annotations(source: DataFrame, id_column: str, cells: DataFrame) -> DataFrame:
    """The annotation rows whose id is one of the atlas's neurons: one semi-join instead of lists of ids."""
    ids = cells.select(F.col("body_id").alias("__body")).distinct()
    return source.withColumn("__body", F.col(f"`{id_column}`").cast("string")).join(ids, "__body", "left_semi").drop("__body")
