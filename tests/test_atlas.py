"""The derived atlas on a fixture whose results are worked out by hand."""

import pytest

from axonspark.plans import atlas, questions

EDGES = [(1001, 2001, "AL_R", 12), (1002, 2001, "AL_L", 5), (3001, 2001, "LH_R", 3), (2001, 4001, "MB_CA_R", 7)]
HIERARCHY = [
    (1001, "cell_type", "ORN_DM1_R"), (1001, "cell_class", "ORN"), (1002, "cell_type", "ORN_DM1_L"), (1002, "cell_class", "ORN"), (2001, "cell_type", "DM1_lPN_R"),
    (2001, "cell_class", "PN"), (3001, "cell_type", "lLN1_R"), (3001, "cell_class", "LN"), (4001, "cell_type", "KCg_R"), (4001, "cell_class", "KC"),
]
TAGS = [(2001, "DM1"), (2001, "DM1_lPN_R")]
NEURONS = [(1001, "ORN_DM1", "ORN_DM1_R"), (1002, "ORN_DM1", "ORN_DM1_L"), (2001, "DM1_lPN", "DM1_lPN_R"), (3001, "lLN1", "lLN1_R"), (4001, "KCg", "KCg_R")]


@pytest.fixture(scope="module")
def built(spark):
    raw = {"flywire": spark.createDataFrame(EDGES, "pre_pt_root_id long, post_pt_root_id long, neuropil string, syn_count long")}
    hierarchy = spark.createDataFrame(HIERARCHY, "pt_root_id long, classification_system string, cell_type string")
    tags = spark.createDataFrame(TAGS, "pt_root_id long, tag string")
    return atlas.build(raw, hierarchy=hierarchy, tags=tags)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_edges(built):
    got = rows(built["edges_by_neuropil"], "pre_id", "post_id", "neuropil", "region", "hemisphere", "synapses")
    assert got == [("1001", "2001", "AL_R", "AL", "R", 12), ("1002", "2001", "AL_L", "AL", "L", 5), ("2001", "4001", "MB_CA_R", "MB", "R", 7), ("3001", "2001", "LH_R", "LH", "R", 3)]


def test_counts(built):
    assert {k: df.count() for k, df in built.items()} == {"provenance": 1, "edges_by_neuropil": 4, "edges_total": 4, "neuropil_membership": 8, "neurons": 5, "annotations": 5}
    assert [tuple(r) for r in built["provenance"].collect()] == [("flywire", "flywire_proofread_connections", 4, 4, "imported", "")]


def test_rollup(built):
    assert rows(built["neurons"], "body_id", "regions", "hemispheres", "input_synapses", "output_synapses", "total_synapses") == [
        ("1001", "AL", "R", 0, 12, 12), ("1002", "AL", "L", 0, 5, 5), ("2001", "AL,LH,MB", "L,R", 20, 7, 27), ("3001", "LH", "R", 0, 3, 3), ("4001", "MB", "R", 7, 0, 7)]


def test_annotations(built):
    assert rows(built["annotations"], "body_id", "primary_name", "cell_class", "glomerulus", "side", "aliases") == [
        ("1001", "ORN_DM1_R", "ORN", "DM1", "R", "ORN; ORN_DM1_R"), ("1002", "ORN_DM1_L", "ORN", "DM1", "L", "ORN; ORN_DM1_L"), ("2001", "DM1_lPN_R", "PN", "DM1", "R", "DM1_lPN_R; PN; DM1; DM1_lPN_R"),
        ("3001", "lLN1_R", "LN", "", "R", "LN; lLN1_R"), ("4001", "KCg_R", "KC", "", "R", "KC; KCg_R")]


def test_receptor_inputs(built):
    by_side = questions.receptor_inputs(built["edges_by_neuropil"], built["neurons"], "flywire", "DM1", by_side=True)
    assert [tuple(r) for r in by_side.collect()] == [("flywire", "2001", "DM1_lPN_R", "DM1", 1, 12, "R", "R", "ipsi"), ("flywire", "2001", "DM1_lPN_R", "DM1", 1, 5, "R", "L", "contra")]
    plain = questions.receptor_inputs(built["edges_by_neuropil"], built["neurons"], pn_type="dm1_lpn")
    assert [tuple(r) for r in plain.collect()] == [("flywire", "2001", "DM1_lPN_R", "DM1", 2, 17)]


def test_lists(built):
    assert [r.body_id for r in questions.neuron_list(built["neurons"]).collect()] == ["2001", "1001", "4001", "1002", "3001"]
    assert [r.body_id for r in questions.projection_neurons(built["neurons"], glomerulus="DM1").collect()] == ["2001"]
    assert [r.body_id for r in questions.neuron_list(built["neurons"], contains="L\\N1").collect()] == []
    assert [r.body_id for r in questions.neuron_list(built["neurons"], contains="lln_").collect()] == ["3001"]
    assert [(r.pre_id, r.synapses) for r in questions.edge_list(built["edges_by_neuropil"], region="al", min_synapses=6).collect()] == [("1001", 12)]


def test_synapses_add_up(built):
    e, m, t = built["edges_by_neuropil"], built["neuropil_membership"], built["edges_total"]
    total = e.groupBy().sum("synapses").first()[0]
    assert m.groupBy().sum("input_synapses", "output_synapses").first()[0:2] == (total, total)
    assert t.groupBy().sum("synapses").first()[0] == total == 27


def test_instances_win_by_order_and_never_multiply(spark):
    raw = {"hemibrain": spark.createDataFrame([(1001, 2001, "AL(R)", 3), (1, 2, "GNG", 9), (5, 6, "AL", 0)], "bodyId_pre long, bodyId_post long, roi string, weight long")}
    source = spark.createDataFrame([*NEURONS, (1001, "zzz", "zzz_L"), (None, "a", "b")], "bodyId long, type string, instance string")
    out = atlas.build(raw, instances=source)["annotations"]
    assert rows(out, "body_id", "primary_name", "instance", "cell_class", "glomerulus", "side", "aliases") == [
        ("1001", "ORN_DM1", "ORN_DM1_R", "ORN", "DM1", "R", "ORN_DM1"), ("2001", "DM1_lPN", "DM1_lPN_R", "PN", "DM1", "R", "DM1_lPN")]


def test_catalog_build(spark):
    spark.createDataFrame(EDGES, "pre_pt_root_id long, post_pt_root_id long, neuropil string, syn_count long").write.mode("overwrite").saveAsTable("flywire_proofread_connections")
    spark.createDataFrame(HIERARCHY, "pt_root_id long, classification_system string, cell_type string").write.mode("overwrite").saveAsTable(atlas.HIERARCHY_TABLE)
    out = atlas.build_tables(spark, prefix="t1")
    assert [(r["table"], r["rows"], r["status"]) for r in out[:2]] == [("hemibrain_traced_roi_connections", "0", "missing"), ("flywire_proofread_connections", "4", "imported")]
    assert dict(questions.table_counts(spark, "t1")) == {"t1_provenance": 1, "t1_edges_by_neuropil": 4, "t1_edges_total": 4, "t1_neuropil_membership": 8, "t1_neurons": 5, "t1_annotations": 5}
    assert all(r["status"] == "built" for r in atlas.build_tables(spark, replace=False, prefix="t1"))
    plan = questions.receptor_inputs(spark.table("t1_edges_by_neuropil"), spark.table("t1_neurons"), "flywire")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(dataset" in plan and "EqualTo(cell_class,ORN)" in plan
