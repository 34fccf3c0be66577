"""The registered queries over the driver's test tables, and the same questions as plain SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import astuple, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonspark.functions import labels as L
from axonspark.operators import aggregate as agg
from axonspark.operators import edges as ed
from axonspark.operators import live, plotdata, predicates, search
from axonspark.plans import adaptor as A
from axonspark.plans import atlas, questions
from axonspark.sources import bulk

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# -- SQL pieces ------------------------------------------------------------------------------------------------------


def sql_region(c: str) -> str:
    return f"CASE WHEN starts_with(upper({c}), 'AL') THEN 'AL' WHEN starts_with(upper({c}), 'LH') THEN 'LH' WHEN starts_with(upper({c}), 'MB') THEN 'MB' ELSE '' END"


def sql_hemisphere(c: str) -> str:
    """R before L: in brackets, after any one character at the end, or inside, between any two."""
    return f"CASE WHEN regexp_matches(upper({c}), '\\(R\\)|.R$|.R.') THEN 'R' WHEN regexp_matches(upper({c}), '\\(L\\)|.L$|.L.') THEN 'L' ELSE '' END"


def sql_class(c: str) -> str:
    return f"""CASE WHEN regexp_matches({c}, 'ORN', 'i') THEN 'ORN' WHEN regexp_matches({c}, 'PN|PROJECTION NEURON', 'i') THEN 'PN' WHEN regexp_matches({c}, 'LN|LOCAL', 'i') THEN 'LN' WHEN regexp_matches({c}, '^KC|KENYON', 'i') THEN 'KC'
        WHEN regexp_matches({c}, 'MBON', 'i') THEN 'MBON' WHEN regexp_matches({c}, 'APL', 'i') THEN 'APL' WHEN regexp_matches({c}, 'DAN|PAM|PPL', 'i') THEN 'DAN' ELSE '' END"""


def sql_glomerulus(c: str) -> str:
    return f"""CASE WHEN regexp_matches({c}, 'ORN_[^_;, ]') THEN regexp_extract({c}, 'ORN_([^_;, ]+)', 1) WHEN regexp_matches({c}, '(^|[ ;,])[^_;, ]+_ORN') THEN regexp_extract({c}, '(^|[ ;,])([^_;, ]+)_ORN', 2)
        WHEN regexp_matches({c}, '(^|[ ;,])[^_;, ]+_[lvm]?PN') THEN regexp_extract({c}, '(^|[ ;,])([^_;, ]+)_[lvm]?PN', 2) WHEN regexp_matches({c}, 'PN_[^_;, ]') THEN regexp_extract({c}, 'PN_([^_;, ]+)', 1) ELSE '' END"""


def sql_side(c: str) -> str:
    """A word that is R or L, or ends in one after _ or -, or the side spelt out."""
    return f"""CASE WHEN regexp_matches(upper({c}), '(^|[ ;,])([^ ;,]*[_-])?R($|[ ;,])') OR contains(upper({c}), ' RIGHT') OR lower({c}) = 'right' THEN 'R'
        WHEN regexp_matches(upper({c}), '(^|[ ;,])([^ ;,]*[_-])?L($|[ ;,])') OR contains(upper({c}), ' LEFT') OR lower({c}) = 'left' THEN 'L' ELSE '' END"""


EDGE_CTE = f"""
conn AS ({A.EDGES}),
e AS (
    SELECT dataset, CAST(pre AS STRING) AS pre_id, CAST(post AS STRING) AS post_id, neuropil, {sql_region('neuropil')} AS region, {sql_hemisphere('neuropil')} AS hemisphere,
           weight AS synapses, CASE dataset WHEN 'hemibrain' THEN 'hemibrain_traced_roi_connections' ELSE 'flywire_proofread_connections' END AS source_table
    FROM conn WHERE weight > 0 AND {sql_region('neuropil')} <> ''
)"""
MEMBER_CTE = f"""{EDGE_CTE},
m AS (
    SELECT dataset, body_id, neuropil, region, hemisphere, CAST(sum(i) AS BIGINT) AS input_synapses, CAST(sum(o) AS BIGINT) AS output_synapses, CAST(sum(i + o) AS BIGINT) AS total_synapses
    FROM (SELECT dataset, post_id AS body_id, neuropil, region, hemisphere, synapses AS i, 0 AS o FROM e UNION ALL SELECT dataset, pre_id, neuropil, region, hemisphere, 0, synapses FROM e) x
    GROUP BY ALL
)"""
ROLLUP_CTE = f"""{MEMBER_CTE},
n0 AS (
    SELECT dataset, body_id, string_agg(DISTINCT region, ',' ORDER BY region) AS regions, string_agg(DISTINCT hemisphere, ',' ORDER BY hemisphere) AS hemispheres,
           CAST(sum(input_synapses) AS BIGINT) AS input_synapses, CAST(sum(output_synapses) AS BIGINT) AS output_synapses, CAST(sum(total_synapses) AS BIGINT) AS total_synapses
    FROM m GROUP BY dataset, body_id
)"""
SUMS = "regions, hemispheres, input_synapses, output_synapses, total_synapses"
HEMI_CTE = f"""{ROLLUP_CTE},
inst AS ({A.INSTANCES}),
n1 AS (
    SELECT n.dataset, n.body_id, {SUMS}, coalesce(type, '') AS primary_name, coalesce(instance, '') AS instance, CASE WHEN h.bodyId IS NULL THEN '' ELSE {sql_class("coalesce(type, instance, '')")} END AS cell_class,
           CASE WHEN h.bodyId IS NULL THEN '' ELSE {sql_glomerulus("coalesce(type, instance, '')")} END AS glomerulus, CASE WHEN h.bodyId IS NULL THEN '' ELSE {sql_side("coalesce(instance, type, '')")} END AS side, coalesce(type, '') AS aliases
    FROM n0 n LEFT JOIN inst h ON n.dataset = 'hemibrain' AND n.body_id = CAST(h.bodyId AS STRING)
)"""
FLY_CTE = f"""{HEMI_CTE},
hier AS ({A.HIERARCHY}),
ct AS (
    SELECT CAST(pt_root_id AS STRING) AS body_id, string_agg(DISTINCT cell_type, '; ' ORDER BY cell_type) AS n, min(CASE WHEN classification_system = 'cell_type' THEN cell_type END) AS p,
           min(CASE WHEN classification_system = 'cell_class' THEN cell_type END) AS k
    FROM hier WHERE pt_root_id IS NOT NULL GROUP BY pt_root_id
),
n2 AS (
    SELECT n.dataset, n.body_id, {SUMS}, coalesce(nullif(p, ''), primary_name) AS primary_name, instance, CASE WHEN c.body_id IS NULL THEN cell_class ELSE coalesce(nullif({sql_class("coalesce(k, p, c.n, '')")}, ''), cell_class) END AS cell_class,
           CASE WHEN c.body_id IS NULL THEN glomerulus ELSE coalesce(nullif({sql_glomerulus("coalesce(p, c.n, '')")}, ''), glomerulus) END AS glomerulus,
           CASE WHEN c.body_id IS NULL THEN side ELSE coalesce(nullif({sql_side("coalesce(p, c.n, '')")}, ''), side) END AS side, coalesce(nullif(c.n, ''), aliases) AS aliases
    FROM n1 n LEFT JOIN ct c ON n.dataset = 'flywire' AND n.body_id = c.body_id
)"""
TAG_CTE = f"""{FLY_CTE},
tags AS ({A.TAGS}),
tg AS (SELECT CAST(pt_root_id AS STRING) AS body_id, string_agg(DISTINCT tag, '; ' ORDER BY tag) AS g FROM tags WHERE pt_root_id IS NOT NULL GROUP BY pt_root_id),
n AS (
    SELECT n.dataset, n.body_id, {SUMS}, CASE WHEN t.body_id IS NULL THEN primary_name ELSE coalesce(nullif(primary_name, ''), split_part(g, ';', 1)) END AS primary_name, instance,
           CASE WHEN t.body_id IS NULL THEN cell_class ELSE coalesce(nullif(cell_class, ''), {sql_class('g')}) END AS cell_class, CASE WHEN t.body_id IS NULL THEN glomerulus ELSE coalesce(nullif(glomerulus, ''), {sql_glomerulus('g')}) END AS glomerulus,
           CASE WHEN t.body_id IS NULL THEN side ELSE coalesce(nullif(side, ''), {sql_side('g')}) END AS side, CASE WHEN t.body_id IS NULL THEN aliases ELSE trim(concat_ws('; ', nullif(aliases, ''), g)) END AS aliases,
           '' AS top1_nt, CAST(NULL AS DOUBLE) AS top1_probability, '' AS top2_nt, CAST(NULL AS DOUBLE) AS top2_probability, '' AS top3_nt, CAST(NULL AS DOUBLE) AS top3_probability
    FROM n2 n LEFT JOIN tg t ON n.dataset = 'flywire' AND n.body_id = t.body_id
)"""
LABELLED = "primary_name, instance, cell_class, glomerulus, side, aliases"
CONN_CTE = f"conn AS ({A.EDGES}), c AS (SELECT pre, post, neuropil AS roi, weight FROM conn)"


def _edges(s: SparkSession, d: str) -> DataFrame:
    raw = A.raw(s, d)
    return atlas.edges_by_neuropil(raw["hemibrain"], atlas.SPECS[0]).unionByName(atlas.edges_by_neuropil(raw["flywire"], atlas.SPECS[1]))


def _build(s: SparkSession, d: str, *sources: str) -> dict[str, DataFrame]:
    found = A.annotations(s, d)
    return atlas.build(A.raw(s, d), **{k: found[k] for k in sources or found})


def _connections(s: SparkSession, d: str) -> DataFrame:
    return A.load(s, d, A.EDGES).select("pre", "post", F.col("neuropil").alias("roi"), "weight")


# -- the derived atlas -----------------------------------------------------------------------------------------------


@register(f"WITH {EDGE_CTE} SELECT * FROM e")
def edges_by_neuropil(s: SparkSession, d: str) -> DataFrame:
    return _edges(s, d)


@register(f"""WITH {EDGE_CTE} SELECT dataset, pre_id, post_id, string_agg(DISTINCT neuropil, ',' ORDER BY neuropil) AS neuropils, string_agg(DISTINCT region, ',' ORDER BY region) AS regions,
    string_agg(DISTINCT hemisphere, ',' ORDER BY hemisphere) AS hemispheres, CAST(sum(synapses) AS BIGINT) AS synapses, string_agg(DISTINCT source_table, ',' ORDER BY source_table) AS source_tables FROM e GROUP BY dataset, pre_id, post_id""")
def edges_total(s: SparkSession, d: str) -> DataFrame:
    return atlas.edges_total(_edges(s, d))


@register(f"WITH {MEMBER_CTE} SELECT * FROM m")
def membership(s: SparkSession, d: str) -> DataFrame:
    return atlas.membership(_edges(s, d))


@register(f"WITH {ROLLUP_CTE} SELECT dataset, body_id, {SUMS} FROM n0")
def neurons_rollup(s: SparkSession, d: str) -> DataFrame:
    return atlas.neurons(atlas.ends(_edges(s, d))).select("dataset", "body_id", *SUMS.split(", "))


@register(f"WITH {HEMI_CTE} SELECT dataset, body_id, {LABELLED} FROM n1 WHERE dataset = 'hemibrain'")
def neurons_annotated_hemibrain(s: SparkSession, d: str) -> DataFrame:
    return _build(s, d, "instances")["neurons"].where("dataset = 'hemibrain'").select("dataset", "body_id", *LABELLED.split(", "))


@register(f"WITH {FLY_CTE} SELECT dataset, body_id, {LABELLED} FROM n2 WHERE dataset = 'flywire'")
def neurons_annotated_flywire(s: SparkSession, d: str) -> DataFrame:
    return _build(s, d, "instances", "hierarchy")["neurons"].where("dataset = 'flywire'").select("dataset", "body_id", *LABELLED.split(", "))


@register(f"WITH {TAG_CTE} SELECT dataset, body_id, {SUMS}, {LABELLED} FROM n")
def neurons_tagged(s: SparkSession, d: str) -> DataFrame:
    return _build(s, d)["neurons"].select("dataset", "body_id", *SUMS.split(", "), *LABELLED.split(", "))


@register(f"WITH {TAG_CTE} SELECT {', '.join(atlas.ANNOTATION_COLUMNS)} FROM n")
def annotations(s: SparkSession, d: str) -> DataFrame:
    return _build(s, d)["annotations"]


@register(f"""WITH {EDGE_CTE} SELECT c.dataset, CASE c.dataset WHEN 'hemibrain' THEN 'hemibrain_traced_roi_connections' ELSE 'flywire_proofread_connections' END AS source_table,
    c.n AS source_rows, coalesce(k.n, 0) AS imported_rows, 'imported' AS status, '' AS store
    FROM (SELECT dataset, count(*) AS n FROM conn GROUP BY dataset) c LEFT JOIN (SELECT dataset, count(*) AS n FROM e GROUP BY dataset) k ON c.dataset = k.dataset""")
def provenance(s: SparkSession, d: str) -> DataFrame:
    return _build(s, d)["provenance"]


@register(f"""WITH {TAG_CTE} SELECT 'edges_by_neuropil' AS name, count(*) AS n FROM e UNION ALL SELECT 'neuropil_membership', count(*) FROM m UNION ALL SELECT 'neurons', count(*) FROM n UNION ALL SELECT 'annotations', count(*) FROM n
    UNION ALL SELECT 'edges_total', count(*) FROM (SELECT DISTINCT dataset, pre_id, post_id FROM e) UNION ALL SELECT 'provenance', count(DISTINCT dataset) FROM conn""")
def atlas_counts(s: SparkSession, d: str) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, df in _build(s, d).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# -- questions to it -------------------------------------------------------------------------------------------------

_LIST = ", ".join(questions.NEURON_LIST)


@register(f"WITH {TAG_CTE} SELECT {_LIST} FROM n WHERE dataset = 'flywire' AND regions ILIKE '%AL%' AND (body_id ILIKE '%DM1%' OR primary_name ILIKE '%DM1%' OR instance ILIKE '%DM1%' OR aliases ILIKE '%DM1%') ORDER BY total_synapses DESC, dataset, body_id LIMIT 50")
def olf_neurons_filter(s: SparkSession, d: str) -> DataFrame:
    return questions.neuron_list(_build(s, d)["neurons"], 50, dataset="flywire", region="al", contains="dm1")


@register(f"WITH {EDGE_CTE} SELECT * FROM e WHERE synapses >= 5 AND region = 'AL' ORDER BY synapses DESC, dataset, pre_id, post_id, neuropil LIMIT 50")
def olf_edges_topk(s: SparkSession, d: str) -> DataFrame:
    return questions.edge_list(_edges(s, d), region="al", min_synapses=5)


@register(f"WITH {TAG_CTE} SELECT {_LIST} FROM n WHERE cell_class = 'PN' AND glomerulus = 'DM1'")
def olf_pns(s: SparkSession, d: str) -> DataFrame:
    return questions.projection_neurons(_build(s, d)["neurons"], glomerulus="DM1", limit=None)


_JOIN = "FROM e JOIN n o ON o.dataset = e.dataset AND o.body_id = e.pre_id JOIN n p ON p.dataset = e.dataset AND p.body_id = e.post_id WHERE o.cell_class = 'ORN' AND p.cell_class = 'PN'"
_SIDE = "coalesce(nullif(o.side, ''), nullif(e.hemisphere, ''), '')"
_RELATION = f"CASE WHEN p.side = '' OR {_SIDE} = '' THEN 'unknown' WHEN p.side = {_SIDE} THEN 'ipsi' ELSE 'contra' END"
_COUNTS = "e.dataset, p.body_id AS pn_id, p.primary_name AS pn_name, p.glomerulus AS glomerulus, count(DISTINCT o.body_id) AS orn_count, CAST(sum(e.synapses) AS BIGINT) AS synapses"


@register(f"WITH {TAG_CTE} SELECT {_COUNTS} {_JOIN} AND (o.glomerulus = 'DM1' OR p.glomerulus = 'DM1') GROUP BY e.dataset, p.body_id, p.primary_name, p.glomerulus")
def orn_inputs(s: SparkSession, d: str) -> DataFrame:
    return questions.receptor_inputs(_edges(s, d), atlas.labels(**A.annotations(s, d)), glomerulus="DM1", limit=None, once=True)


@register(f"WITH {TAG_CTE} SELECT {_COUNTS}, p.side AS pn_side, {_SIDE} AS orn_side, {_RELATION} AS side_relation {_JOIN} GROUP BY e.dataset, p.body_id, p.primary_name, p.glomerulus, p.side, {_SIDE}, {_RELATION}")
def orn_inputs_by_side(s: SparkSession, d: str) -> DataFrame:
    return questions.receptor_inputs(_edges(s, d), atlas.labels(**A.annotations(s, d)), by_side=True, limit=None, once=True)


@register(f"WITH {TAG_CTE} SELECT {_COUNTS} {_JOIN} AND e.dataset = 'flywire' AND (p.primary_name = 'DM2_lPN' OR p.instance = 'DM2_lPN' OR p.aliases ILIKE '%DM2_lPN%') GROUP BY e.dataset, p.body_id, p.primary_name, p.glomerulus")
def orn_inputs_pn_type(s: SparkSession, d: str) -> DataFrame:
    return questions.receptor_inputs(_edges(s, d), atlas.labels(**A.annotations(s, d)), dataset="flywire", pn_type="DM2_lPN", limit=None, once=True)


# -- connection tables -----------------------------------------------------------------------------------------------


@register(f"WITH {CONN_CTE} SELECT * FROM c WHERE pre = 1 AND weight >= 10 ORDER BY weight DESC, pre, post, roi LIMIT 50")
def conn_topk(s: SparkSession, d: str) -> DataFrame:
    return ed.connections(_connections(s, d), pre=1, min_weight=10)


@register(f"WITH {CONN_CTE} SELECT pre AS partner_id, roi, CAST(sum(weight) AS BIGINT) AS total_weight, count(*) AS connection_rows FROM c WHERE post = 7 AND weight >= 2 GROUP BY pre, roi")
def inputs(s: SparkSession, d: str) -> DataFrame:
    return ed.neighbours(_connections(s, d), 7, inputs=True, min_weight=2, limit=None)


@register(f"WITH {CONN_CTE} SELECT post AS partner_id, roi, CAST(sum(weight) AS BIGINT) AS total_weight, count(*) AS connection_rows FROM c WHERE pre = 7 AND weight >= 2 GROUP BY post, roi")
def outputs(s: SparkSession, d: str) -> DataFrame:
    return ed.neighbours(_connections(s, d), 7, inputs=False, min_weight=2, limit=None)


_PART = "SELECT '{0}' AS direction, {1} AS partner_id, roi, CAST(sum(weight) AS BIGINT) AS total_weight, count(*) AS connection_rows FROM c WHERE {2} = 7 AND weight >= 1 GROUP BY {1}, roi ORDER BY total_weight DESC, partner_id, roi LIMIT 50"


@register(f"WITH {CONN_CTE} (SELECT * FROM ({_PART.format('input', 'pre', 'post')}) a) UNION ALL (SELECT * FROM ({_PART.format('output', 'post', 'pre')}) b)")
def partners(s: SparkSession, d: str) -> DataFrame:
    return ed.partners(_connections(s, d), 7)


@register(f"WITH {CONN_CTE} SELECT pre AS pre_id, post AS post_id, weight, roi FROM c")
def edges_view(s: SparkSession, d: str) -> DataFrame:
    return ed.edges(_connections(s, d))


@register(f"""WITH {CONN_CTE} SELECT pre AS body_id, post AS partner_id, 'output' AS direction, roi, CAST(sum(weight) AS BIGINT) AS total_weight, count(*) AS connection_rows FROM c GROUP BY pre, post, roi
    UNION ALL SELECT post, pre, 'input', roi, CAST(sum(weight) AS BIGINT), count(*) FROM c GROUP BY post, pre, roi""")
def partners_view(s: SparkSession, d: str) -> DataFrame:
    return ed.partner_totals(_connections(s, d))


@register(f"WITH {CONN_CTE} SELECT pre, post, weight FROM c WHERE pre = 3 AND roi = 'AL_R'")
def bulk_query_eq(s: SparkSession, d: str) -> DataFrame:
    return predicates.equal(_connections(s, d), [("pre", "3"), ("roi", "AL_R")], ["pre", "post", "weight"])


# -- text tables -----------------------------------------------------------------------------------------------------

#: A summary table in text cells, some of them empty or no number.
SUMMARY = """SELECT l_returnflag AS LN_type, CASE WHEN l_linestatus = 'O' THEN 'ipsi' ELSE 'contra' END AS input_relation, concat('DM', CAST(l_partkey % 7 AS STRING)) AS glomerulus,
    CASE WHEN l_quantity < 5 THEN '' WHEN l_quantity < 8 THEN 'n/a' ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) END AS n_synapses, CAST(l_suppkey AS STRING) AS source_root_id,
    CASE WHEN l_linenumber % 2 = 0 THEN 'L' ELSE 'R' END AS analysis_hemisphere, concat('sub', CAST(l_linenumber AS STRING)) AS cell_sub_class FROM lineitem"""
_NUM = "coalesce(try_cast(n_synapses AS DOUBLE), 0.0)"


def _summary(s: SparkSession, d: str) -> DataFrame:
    return A.load(s, d, SUMMARY)


@register(f"WITH t AS ({SUMMARY}) SELECT LN_type, glomerulus, count(*) AS count, sum({_NUM}) AS sum_n_synapses, sum({_NUM}) / nullif(count(*) FILTER (n_synapses <> ''), 0) AS mean_n_synapses FROM t GROUP BY LN_type, glomerulus")
def agg_sum_mean(s: SparkSession, d: str) -> DataFrame:
    return agg.aggregate(_summary(s, d), ["LN_type", "glomerulus"], ["n_synapses"], ["n_synapses"])


@register(f"WITH t AS ({SUMMARY}) SELECT LN_type, count(*) AS count, sum({_NUM}) AS sum_n_synapses FROM t WHERE input_relation = 'ipsi' AND contains(lower(glomerulus), 'dm1') GROUP BY LN_type")
def agg_filtered(s: SparkSession, d: str) -> DataFrame:
    return agg.aggregate(_summary(s, d), ["LN_type"], ["n_synapses"], exact=[("input_relation", "ipsi")], contains=[("glomerulus", "dM1")])


@register(f"WITH t AS ({SUMMARY}) SELECT glomerulus, n_synapses, '' AS no_such_column FROM t WHERE LN_type = 'R' AND analysis_hemisphere = 'L'")
def query_exact(s: SparkSession, d: str) -> DataFrame:
    return predicates.project(predicates.where(_summary(s, d), [("LN_type", "R"), ("analysis_hemisphere", "L")]), ["glomerulus", "n_synapses", "no_such_column"])


@register("SELECT CAST(p_partkey AS STRING) AS p_partkey, p_type, p_brand FROM part WHERE contains(lower(p_brand), 'd#1') AND contains(lower(CAST(p_partkey AS STRING)), '1')")
def query_contains(s: SparkSession, d: str) -> DataFrame:
    return predicates.project(predicates.where(s.read.parquet(f"{d}/part.parquet"), contains=[("p_brand", "D#1"), ("p_partkey", "1")]), ["p_partkey", "p_type", "p_brand"])


@register("SELECT CAST(p_partkey AS STRING) AS p_partkey, p_name FROM part ORDER BY part.p_partkey LIMIT 10")
def head(s: SparkSession, d: str) -> DataFrame:
    return predicates.head(predicates.project(s.read.parquet(f"{d}/part.parquet").orderBy("p_partkey"), ["p_partkey", "p_name"]), 10)


#: A table as the searches see it: with its rank, place and order.
FOUND = f"""SELECT 0 AS _rank, 'flywire' AS _dataset, 'parts' AS _table, 'parts.csv' AS _file, p_partkey AS _ordinal, {A.TYPE} AS LN_type, p_brand AS comparison_name, p_name AS all_names, CAST(p_partkey AS STRING) AS root_id, p_type AS hemisphere FROM part"""


@register(f"""WITH t AS ({FOUND}) SELECT _dataset AS dataset, _table AS file_id, CASE WHEN contains(lower(LN_type), 'd#1') THEN 'LN_type' WHEN contains(lower(comparison_name), 'd#1') THEN 'comparison_name' WHEN contains(lower(all_names), 'd#1') THEN 'all_names' ELSE 'root_id' END AS matched_column,
    CASE WHEN contains(lower(LN_type), 'd#1') THEN LN_type WHEN contains(lower(comparison_name), 'd#1') THEN comparison_name WHEN contains(lower(all_names), 'd#1') THEN all_names ELSE root_id END AS matched_value,
    LN_type, '' AS combined_LN_type, comparison_name, '' AS recommended_match_group, '' AS bodyId, root_id, hemisphere, '' AS input_preference, '' AS top_nt, '' AS top_nt_conf
    FROM t WHERE contains(lower(LN_type), 'd#1') OR contains(lower(comparison_name), 'd#1') OR contains(lower(all_names), 'd#1') OR contains(root_id, 'd#1')""")
def ln_search(s: SparkSession, d: str) -> DataFrame:
    return search.local_neurons(A.load(s, d, FOUND), "D#1", limit=None)


COMPARED = f"SELECT {A.TYPE} AS LN_class, p_brand AS flywire_raw_LN_types, p_name AS flywire_primary_flywire_names, p_type AS flywire_hemibrain_types FROM part"


@register(f"WITH t AS ({COMPARED}) SELECT * FROM t WHERE contains(lower(LN_class), 'lln') OR contains(lower(flywire_raw_LN_types), 'lln') OR contains(lower(flywire_primary_flywire_names), 'lln') OR contains(lower(flywire_hemibrain_types), 'lln')")
def compare_search(s: SparkSession, d: str) -> DataFrame:
    return search.compare(A.load(s, d, COMPARED), "lLN")


@register(f"WITH t AS ({SUMMARY}) SELECT source_root_id, LN_type, analysis_hemisphere, glomerulus, input_relation, count(*) AS count, sum({_NUM}) AS sum_n_synapses FROM t WHERE contains(lower(LN_type), '1') OR contains(source_root_id, '1') GROUP BY ALL")
def orn_partner_summary(s: SparkSession, d: str) -> DataFrame:
    return search.partners_by_root(_summary(s, d), "1", "orn")


@register(f"WITH t AS ({SUMMARY}) SELECT source_root_id, LN_type, analysis_hemisphere, glomerulus, cell_sub_class, count(*) AS count, sum({_NUM}) AS sum_n_synapses FROM t WHERE contains(lower(LN_type), '2') OR contains(source_root_id, '2') GROUP BY ALL")
def pn_partner_summary(s: SparkSession, d: str) -> DataFrame:
    return search.partners_by_root(_summary(s, d), "2", "pn")


PER_FILE = "SELECT concat('t', CAST(l_suppkey % 9 AS STRING)) AS \"table\", concat('DM', CAST(l_partkey % 7 AS STRING)) AS glomerulus, CAST(CAST(l_quantity AS BIGINT) AS STRING) AS weight, '100' AS LN_total_connections, CAST(CAST(l_quantity AS BIGINT) AS STRING) AS LN_to_PN_perct FROM lineitem"


@register(f'WITH t AS ({PER_FILE}) SELECT "table", glomerulus, count(*) AS count, sum(CAST(weight AS DOUBLE)) AS sum_weight, CAST(100 * count(*) AS DOUBLE) AS sum_LN_total_connections, sum(CAST(weight AS DOUBLE)) / count(*) AS mean_LN_to_PN_perct FROM t GROUP BY ALL')
def pn_file_summary(s: SparkSession, d: str) -> DataFrame:
    return search.partners_by_file(A.load(s, d, PER_FILE.replace('"table"', "`table`")), "pn")


# -- questions that go to services elsewhere -------------------------------------------------------------------------


@register(f"WITH t AS ({A.INSTANCES}) SELECT * FROM t WHERE bodyId IN (1, 2, 7, 13, 20, 31) AND contains(lower(type), 'pn')")
def neurons_by_ids(s: SparkSession, d: str) -> DataFrame:
    return live.neurons(A.load(s, d, A.INSTANCES), [1, 2, 7, 13, 20, 31], type_contains="PN", limit=None)


@register(f"""WITH {CONN_CTE}, i AS ({A.INSTANCES}) SELECT pre AS "upstream_bodyId", u.type AS upstream_type, u.instance AS upstream_instance, post AS "downstream_bodyId", w.type AS downstream_type, w.instance AS downstream_instance, weight
    FROM c JOIN i u ON c.pre = u.bodyId JOIN i w ON c.post = w.bodyId WHERE pre IN (1, 2, 3) AND weight >= 20""")
def connections_by_ids(s: SparkSession, d: str) -> DataFrame:
    e = _connections(s, d).select(F.col("pre").alias("pre_id"), F.col("post").alias("post_id"), "weight")
    return live.connections(e, A.load(s, d, A.INSTANCES), upstream=[1, 2, 3], min_weight=20, limit=None)


@register(f"WITH {CONN_CTE} SELECT pre, post, weight FROM c WHERE roi = 'LH_L' AND pre IN (1, 4, 5)")
def table_in_filter(s: SparkSession, d: str) -> DataFrame:
    return predicates.member(_connections(s, d), {"roi": "LH_L"}, {"pre": [1, 4, 5]}, ["pre", "post", "weight"])


@register(f"WITH {MEMBER_CTE}, i AS ({A.INSTANCES}) SELECT * FROM i WHERE CAST(bodyId AS STRING) IN (SELECT body_id FROM m WHERE dataset = 'hemibrain')")
def semi_join_annotations(s: SparkSession, d: str) -> DataFrame:
    return atlas.limit_annotations(A.load(s, d, A.INSTANCES), "bodyId", atlas.membership(_edges(s, d)).where("dataset = 'hemibrain'"))


# -- labels ----------------------------------------------------------------------------------------------------------


@register(f"WITH t AS ({A.INSTANCES}) SELECT instance, {sql_class('instance')} AS label, count(*) AS n FROM t GROUP BY ALL")
def classify_labels(s: SparkSession, d: str) -> DataFrame:
    return A.load(s, d, A.INSTANCES).groupBy("instance", L.cell_class(F.col("instance")).alias("label")).agg(F.count("*").alias("n"))


@register(f"WITH t AS ({A.INSTANCES}) SELECT instance, {sql_glomerulus('instance')} AS label, count(*) AS n FROM t GROUP BY ALL")
def glomerulus_labels(s: SparkSession, d: str) -> DataFrame:
    return A.load(s, d, A.INSTANCES).groupBy("instance", L.glomerulus(F.col("instance")).alias("label")).agg(F.count("*").alias("n"))


@register(f"WITH t AS ({A.INSTANCES}) SELECT instance, {sql_side('instance')} AS label, count(*) AS n FROM t GROUP BY ALL")
def side_labels(s: SparkSession, d: str) -> DataFrame:
    return A.load(s, d, A.INSTANCES).groupBy("instance", L.side(F.col("instance")).alias("label")).agg(F.count("*").alias("n"))


@register(f"WITH conn AS ({A.EDGES}) SELECT neuropil, {sql_region('neuropil')} AS region, {sql_hemisphere('neuropil')} AS hemisphere, count(*) AS n FROM conn GROUP BY ALL")
def region_labels(s: SparkSession, d: str) -> DataFrame:
    n = F.col("neuropil")
    return A.load(s, d, A.EDGES).groupBy("neuropil", L.region(n).alias("region"), L.hemisphere(n).alias("hemisphere")).agg(F.count("*").alias("n"))


# -- plot data -------------------------------------------------------------------------------------------------------


@register("""WITH v AS (SELECT p_retailprice AS v FROM part), l AS (SELECT min(v) AS lo, max(v) AS hi, least(40, greatest(8, CAST(floor(sqrt(CAST(greatest(count(*), 1) AS DOUBLE))) AS BIGINT))) AS bins FROM v)
    SELECT CAST(least(CAST(floor((v - lo) / ((hi - lo) / bins)) AS BIGINT), bins - 1) AS BIGINT) AS bin, count(*) AS count FROM v, l GROUP BY 1""")
def hist_bins(s: SparkSession, d: str) -> DataFrame:
    return plotdata.histogram(s.read.parquet(f"{d}/part.parquet"), "p_retailprice").select("bin", "count")


@register("SELECT p_brand AS y, p_type AS x, max_by(CAST(p_size AS DOUBLE), p_partkey) AS value FROM part GROUP BY p_brand, p_type")
def heatmap_cells(s: SparkSession, d: str) -> DataFrame:
    return plotdata.heatmap(s.read.parquet(f"{d}/part.parquet"), "p_type", "p_brand", "p_size", "p_partkey")


@register("""SELECT CAST(p_partkey AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y, p_brand AS color, CASE WHEN lo = hi THEN 130.0 ELSE 20.0 + (CAST(p_size AS DOUBLE) - lo) / (hi - lo) * (240.0 - 20.0) END AS area
    FROM part, (SELECT CAST(min(p_size) AS DOUBLE) AS lo, CAST(max(p_size) AS DOUBLE) AS hi FROM part) e""")
def bubble_scale(s: SparkSession, d: str) -> DataFrame:
    return plotdata.bubbles(s.read.parquet(f"{d}/part.parquet"), "p_partkey", "p_size", "p_size", "p_brand")


@register("""SELECT p_brand AS "group", count(*) AS count, CAST(min(p_size) AS DOUBLE) AS low, CAST(max(p_size) AS DOUBLE) AS high, CAST(quantile_cont(CAST(p_size AS DOUBLE), 0.25) AS DOUBLE) AS q1, CAST(quantile_cont(CAST(p_size AS DOUBLE), 0.5) AS DOUBLE) AS median, CAST(quantile_cont(CAST(p_size AS DOUBLE), 0.75) AS DOUBLE) AS q3 FROM part GROUP BY p_brand""")
def violin_stats(s: SparkSession, d: str) -> DataFrame:
    return plotdata.violins(s.read.parquet(f"{d}/part.parquet"), "p_brand", "p_size")


@register("SELECT CAST(p_partkey AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y, p_brand AS color FROM part")
def scatter_points(s: SparkSession, d: str) -> DataFrame:
    return plotdata.points(s.read.parquet(f"{d}/part.parquet"), "p_partkey", "p_size", "p_brand")


@register("SELECT CAST(p_partkey AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y, p_type AS color FROM part")
def line_points(s: SparkSession, d: str) -> DataFrame:
    return plotdata.lines(s.read.parquet(f"{d}/part.parquet"), "p_partkey", "p_size", "p_type")


@register("SELECT p_name AS label, CAST(p_size AS DOUBLE) AS height FROM part")
def bar_heights(s: SparkSession, d: str) -> DataFrame:
    return plotdata.bars(s.read.parquet(f"{d}/part.parquet"), "p_name", "p_size")


# -- catalogs --------------------------------------------------------------------------------------------------------


_FILES = " UNION ALL ".join(f"SELECT file FROM ({sql}) AS {name}" for name, sql in A.CATALOG.items())


@register(f"SELECT split_part(file, '/', 1) AS dataset, count(DISTINCT file) AS tables FROM ({_FILES}) x GROUP BY 1")
def manifest_counts(s: SparkSession, d: str) -> DataFrame:
    return A.catalog(s, d).datasets()


@register(f"""SELECT file AS relative_path, split_part(file, '/', 1) AS dataset, CASE WHEN file LIKE '%/%/%' THEN split_part(file, '/', 2) ELSE 'root' END AS collection,
    trim(lower(regexp_replace(replace(file, '.csv', ''), '[^0-9A-Za-z]+', '_', 'g')), '_') AS file_id, count(*) AS rows FROM ({_FILES}) x GROUP BY file""")
def manifest_files(s: SparkSession, d: str) -> DataFrame:
    return A.catalog(s, d).frame().select("relative_path", "dataset", "collection", "file_id", "rows")


@register(f"""SELECT LN_instance AS "LN_instance", CAST(LN_bodyid AS STRING) AS "LN_bodyid", glomerulus, count(*) AS count, CAST(sum(n_inputs) AS DOUBLE) AS sum_n_inputs,
    CAST(sum(n_ipsi_inputs) AS DOUBLE) AS sum_n_ipsi_inputs, CAST(sum(n_contra_inputs) AS DOUBLE) AS sum_n_contra_inputs FROM ({A.CATALOG['inputs']}) x GROUP BY LN_instance, LN_bodyid, glomerulus""")
def orn_file_summary(s: SparkSession, d: str) -> DataFrame:
    return search.find_partners(A.catalog(s, d, "inputs"), "hemibrain", "lns_", "orn", None)


_FAMILY = f"""SELECT 0 AS rank, file, k, LN_type AS "LN_type", '' AS "bodyId", '' AS comparison_name, hemisphere FROM ({A.CATALOG['summary']}) a
    UNION ALL SELECT 2, file, k, '', CAST(bodyId AS STRING), comparison_name, '' FROM ({A.CATALOG['aliases']}) b
    UNION ALL SELECT 6, file, k, '', '', comparison_name, '' FROM ({A.CATALOG['comparison']}) c"""


@register(f"""WITH t AS ({_FAMILY}), f AS (SELECT * FROM t WHERE contains(lower("LN_type"), 'd#11') OR contains(lower(comparison_name), 'd#11') OR contains("bodyId", 'd#11') ORDER BY rank, file, k LIMIT 40)
    SELECT CASE WHEN rank = 6 THEN 'comparison' ELSE 'flywire' END AS dataset, replace(replace(file, '.csv', ''), '/', '_') AS file_id, CASE WHEN rank = 0 THEN 'LN_type' ELSE 'comparison_name' END AS matched_column, CASE WHEN rank = 0 THEN "LN_type" ELSE comparison_name END AS matched_value,
    "LN_type", '' AS "combined_LN_type", comparison_name, '' AS recommended_match_group, "bodyId", '' AS root_id, hemisphere, '' AS input_preference, '' AS top_nt, '' AS top_nt_conf FROM f""")
def ln_families(s: SparkSession, d: str) -> DataFrame:
    return search.find_local_neurons(A.catalog(s, d, "summary", "aliases", "comparison"), "D#11", limit=40)


_SOURCES = " UNION ALL ".join("SELECT " + ", ".join(f"'{v}' AS {f.name}" for f, v in zip(fields(bulk.Release), astuple(r), strict=True)) for r in bulk.RELEASES)


@register(f"WITH conn AS ({A.EDGES}) SELECT r.*, coalesce(n.rows, 0) AS connection_rows FROM ({_SOURCES}) r LEFT JOIN (SELECT dataset, count(*) AS rows FROM conn GROUP BY dataset) n ON r.dataset = n.dataset")
def bulk_sources(s: SparkSession, d: str) -> DataFrame:
    counts = A.load(s, d, A.EDGES).groupBy("dataset").agg(F.count("*").alias("connection_rows"))
    return bulk.releases(s).join(counts, "dataset", "left").withColumn("connection_rows", F.coalesce("connection_rows", F.lit(0).cast("long")))


_ROLE_ROWS = "SELECT '{0}' AS pre, '{1}' AS post, '{2}' AS weight, '{3}' AS roi, count(*) AS rows, CAST(sum(weight) AS BIGINT) AS total FROM conn WHERE dataset = '{4}'"


@register(f"WITH conn AS ({A.EDGES}) " + _ROLE_ROWS.format("bodyId_pre", "bodyId_post", "weight", "roi", "hemibrain") + " UNION ALL " + _ROLE_ROWS.format("pre_pt_root_id", "post_pt_root_id", "syn_count", "neuropil", "flywire"))
def column_roles(s: SparkSession, d: str) -> DataFrame:
    """What each connection table's columns are taken for, with what is found in them."""
    out = []
    for df in A.raw(s, d).values():
        r = ed.roles(df.columns)
        named = ed.edges(df).agg(F.count("*").alias("rows"), F.sum("weight").alias("total"))
        out.append(named.select(*[F.lit(getattr(r, x)).alias(x) for x in ("pre", "post", "weight", "roi")], "rows", "total"))
    return out[0].unionByName(out[1])


_QUOTED = "SELECT l_orderkey AS id, l_linenumber AS n, concat('a \"b\", ', l_returnflag, chr(10), repeat(concat(l_linestatus, chr(10)), CAST(l_quantity AS INTEGER) % 5)) AS text FROM lineitem"


@register(f"SELECT CAST(id AS BIGINT) AS id, CAST(n AS BIGINT) AS n, text FROM ({_QUOTED}) q")
def import_quoted_csv(s: SparkSession, d: str) -> DataFrame:
    """Fields with line breaks, written as CSV and read again by ranges."""
    return A.through_csv(s, d, _QUOTED)
