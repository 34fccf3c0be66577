"""Text tables, connection tables, catalogs, imports, sinks and the command line."""

import csv
import io
import json
import os
import tarfile
import zipfile

import pyarrow as pa
import pyarrow.feather
import pytest

from axonspark import cli
from axonspark.operators import edges, live, plotdata, predicates, search, sink
from axonspark.operators.aggregate import aggregate
from axonspark.session import load_env, setting
from axonspark.sources import bulk, catalog

CONNECTIONS = [(101, 201, "AL_R", 7, "gaba"), (101, 202, "AL_R", 3, "acetylcholine"), (102, 201, "AL_L", 5, "glutamate"), (103, 201, "LH_R", 2, "gaba")]
KIND = "pre_pt_root_id long, post_pt_root_id long, neuropil string, n_synapses long, nt_type string"


@pytest.fixture(scope="module")
def connections(spark):
    return spark.createDataFrame(CONNECTIONS, KIND)


def all_rows(df):
    return [tuple(r) for r in df.collect()]


def test_parsing():
    assert predicates.parse_filters(["a=b=c", "x="]) == [("a", "b=c"), ("x", "")]
    with pytest.raises(ValueError, match="column=value"):
        predicates.parse_filters(["a"])
    assert predicates.parse_ids(["1,2", "3"]) == [1, 2, 3]
    with pytest.raises(ValueError, match="not an id"):
        predicates.parse_ids(["1,x"])
    assert predicates.parse_memberships(["a=1,b,2"]) == {"a": [1, "b", 2]}


def test_filters_and_projection(spark):
    df = spark.createDataFrame([("L", "x%y", None), ("l", "xay", "1"), ("R", "", "2")], "a string, b string, c string")
    assert len(all_rows(predicates.where(df, [("a", "L")]))) == 1
    assert len(all_rows(predicates.where(df, [("nothing", "")]))) == 3
    assert len(all_rows(predicates.where(df, contains=[("b", "X%")]))) == 1
    assert all_rows(predicates.project(predicates.where(df, [("a", "L")]), ["c", "zz", "a"])) == [("", "", "L")]
    assert len(all_rows(predicates.head(df, 0))) == 1


def test_aggregate(spark):
    df = spark.createDataFrame([("b", "2"), ("a", ""), ("a", "x"), ("a", "3"), ("c", "")], "k string, v string")
    assert [tuple(r) for r in aggregate(df, ["k"], ["v"], ["v"], limit=9).collect()] == [("a", 3, 3.0, 1.5), ("b", 1, 2.0, 2.0), ("c", 1, 0.0, None)]
    assert [r.k for r in aggregate(df, ["k"], limit=-1).collect()] == ["a", "b"] and aggregate(df, ["k"], limit=-5).count() == 0
    with pytest.raises(ValueError, match="group"):
        aggregate(df, [])


def test_buckets_follow_the_size():
    assert [edges.buckets_for(x) for x in (0, 1, 8 << 28, (8 << 28) + 1, 1 << 40, 10**18)] == [8, 8, 8, 16, 4096, 65536]


def test_roles():
    assert edges.roles(["Upstream_BodyId", "downstream_bodyId", "roi", "weight", "count"]) == edges.Roles("Upstream_BodyId", "downstream_bodyId", "weight", "roi")
    assert edges.roles(["pre", "post", "synapses"]).roi == ""
    with pytest.raises(ValueError, match="no column for post"):
        edges.roles(["pre", "weight"])
    assert [edges.identifier(x) for x in ("a-b.c", "1a", "")] == ["a_b_c", "t_1a", "t_"]


def test_neighbours(connections):
    assert all_rows(edges.neighbours(connections, "201", inputs=True)) == [(101, "AL_R", 7, 1), (102, "AL_L", 5, 1), (103, "LH_R", 2, 1)]
    assert all_rows(edges.neighbours(connections, 101, inputs=False, min_weight=4)) == [(201, "AL_R", 7, 1)]
    assert [r.direction for r in edges.partners(connections, 201, limit=2).collect()] == ["input", "input"]
    assert all_rows(edges.connections(connections, post=201, min_weight=3).select("pre_pt_root_id")) == [(101,), (102,)]
    assert edges.partner_totals(connections).count() == 8


def test_views_and_layout(spark, connections):
    connections.write.mode("overwrite").saveAsTable("conn_t")
    assert edges.create_views(spark, "conn_t", "cv") == ["cv_edges", "cv_partners"]
    assert all_rows(spark.sql("SELECT sum(total_weight) FROM cv_partners WHERE body_id = 201 AND direction = 'input'")) == [(14,)]
    done = edges.optimize(spark, "conn_t", buckets=4, how="buckets")
    assert [x["action"] for x in done] == ["bucket", "bucket", "analyze", "analyze", "analyze"]
    plan = spark.table("conn_t_by_pre").groupBy("pre_pt_root_id").sum("n_synapses")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_typed_equality(connections):
    assert predicates.equal(connections, [("pre_pt_root_id", "101"), ("nt_type", "gaba")]).count() == 1
    assert predicates.equal(connections, [("pre_pt_root_id", "abc")]).count() == 0


def make_catalog(tmp_path):
    files = {
        "hemibrain/ln_orn_by_glomerulus/A_['x_R']_y.csv": "LN_instance,LN_bodyid,glomerulus,n_inputs,n_ipsi_inputs,n_contra_inputs\nx_R,1,DM1,3,2,1\nx_R,1,,4,4,0\n",
        "hemibrain/ln_orn_by_glomerulus_individual_lns/A(+b).csv": "LN_instance,LN_bodyid,glomerulus,n_inputs,n_ipsi_inputs,n_contra_inputs\nx_R,1,DM1,5,5,0\n",
        "hemibrain/ln_to_pn_connections/B.csv": "glomerulus,weight,LN_total_connections,LN_to_PN_perct\nDM1,2,4,0.5\nDM2,1,4,0.25\n",
        "flywire/source_audit/orn_partner_counts_by_hemisphere.csv": "source_root_id,LN_type,LN_instance,analysis_hemisphere,glomerulus,input_relation,n_synapses\n720575940607198898,lLN2,l,L,DM1,ipsi,2\n720575940607198898,lLN2,l,L,DM1,ipsi,3\n",
        "comparison/matched_ln_class_similarity.csv": 'LN_class,flywire_raw_LN_types,flywire_primary_flywire_names,flywire_hemibrain_types,note\nlLN2,"a, b",c,d,"say ""hi"""\n',
        "flywire/full_summary.csv": "LN_type,bodyId,cell.type\nlLN2P,7,q\nother,8,\n",
    }
    for name, text in files.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return tmp_path


def test_manifest_and_catalog(spark, tmp_path):
    root = make_catalog(tmp_path)
    with pytest.raises(FileNotFoundError):
        catalog.Catalog(spark, str(root))
    assert catalog.write_manifest(spark, str(root)) == 6
    c = catalog.Catalog(spark, str(root))
    assert [tuple(r) for r in c.datasets().collect()] == [("comparison", 1), ("flywire", 2), ("hemibrain", 3)]
    t = c.resolve("flywire:full_summary")
    assert (t.collection, t.rows, t.columns, t.file_id) == ("root", 2, ("LN_type", "bodyId", "cell.type"), "flywire_full_summary")
    assert c.resolve("comparison:matched_ln_class_similarity.csv").dataset == "comparison"
    assert [x.file_id for x in c.tables("hemibrain", "INDIVIDUAL")] == ["hemibrain_ln_orn_by_glomerulus_individual_lns_a_b"]
    with pytest.raises(KeyError):
        c.resolve("nothing")
    with pytest.raises(KeyError):
        c.resolve("")
    with pytest.raises(KeyError):
        c.resolve("full_summary")
    assert c.resolve("flywire:summary") == t == c.resolve("flywire/full_summary.csv")
    with pytest.raises(ValueError, match="matches 2"):
        c.resolve("flywire:")
    assert c.resolve("comparison_matched_ln_class_similarity").dataset == "comparison"
    one = c.open(c.resolve("comparison:matched_ln_class_similarity")).collect()[0]
    assert one["flywire_raw_LN_types"] == "a, b" and one["note"] == 'say "hi"'
    assert predicates.project(c.open(t), ["cell.type"]).collect()[0][0] == "q"
    orn = [tuple(r) for r in search.find_partners(c, "hemibrain", "a", "orn").collect()]
    assert orn == [("x_R", "1", "", 1, 4.0, 4.0, 0.0), ("x_R", "1", "DM1", 2, 8.0, 7.0, 1.0)]
    assert [tuple(r) for r in search.find_partners(c, "hemibrain", "b.csv", "pn").collect()] == [("hemibrain_ln_to_pn_connections_b", "DM1", 1, 2.0, 4.0, 0.5), ("hemibrain_ln_to_pn_connections_b", "DM2", 1, 1.0, 4.0, 0.25)]
    fly = search.find_partners(c, "flywire", "lln", "orn").collect()
    assert [tuple(r) for r in fly] == [("720575940607198898", "lLN2", "L", "DM1", "ipsi", 2, 5.0)]
    found = [(r.file_id, r.matched_column, r.matched_value) for r in search.find_local_neurons(c, "lln2").collect()]
    assert found == [("flywire_full_summary", "LN_type", "lLN2P")]
    assert search.compare(c.open(c.resolve("comparison:matched_ln_class_similarity")), "LLN").count() == 1


def test_references_that_end_alike(spark, tmp_path):
    for name in ("a/full.csv", "b/a/full.csv", "c/not:so/x.csv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x,y\n1,2\n")
    catalog.write_manifest(spark, str(tmp_path))
    c = catalog.Catalog(spark, str(tmp_path))
    assert c.resolve("a/full").relative_path == "a/full.csv"
    assert c.resolve("b:full").relative_path == c.resolve("b:a/full").relative_path == "b/a/full.csv"
    assert c.resolve("c:not:so/x").relative_path == "c/not:so/x.csv"
    with pytest.raises(KeyError):
        c.resolve("full")


def test_family_scan_opens_its_files_alone(spark, tmp_path):
    root = make_catalog(tmp_path)
    catalog.write_manifest(spark, str(root))
    (root / "hemibrain/ln_orn_by_glomerulus/not in the manifest.csv").write_text("never,read\n1,2\n")
    c = catalog.Catalog(spark, str(root))
    wanted = [t for t in c.tables("hemibrain") if "ln_orn" in t.collection]
    df = c.open(*wanted)
    assert len(wanted) == 2 and sorted(os.path.basename(f) for f in catalog.read_csv(spark, c.root, [t.relative_path for t in wanted], list(wanted[0].columns)).inputFiles()) == ["A(+b).csv", "A_%5B'x_R'%5D_y.csv"]
    assert sorted({(r._file, r._table) for r in df.collect()}) == sorted((t.relative_path, t.file_id) for t in wanted)


def test_imports(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,w\n720575940607198898,3\n1,4\n")
    assert bulk.load(spark, str(tmp_path / "x.csv"), "imp-x", replace=True) == ("imp_x", 2)
    assert bulk.columns(spark.table("imp_x"))[0][:2] == ("id", "BIGINT")
    with pytest.raises(Exception, match="imp_x"):
        bulk.load(spark, str(tmp_path / "x.csv"), "imp_x")
    t = pa.table({"id": pa.array(range(10), pa.int64()), "s": [str(k) for k in range(10)]})
    pyarrow.feather.write_feather(t, str(tmp_path / "x.feather"), chunksize=3)
    df = bulk.read(spark, str(tmp_path / "x.feather"))
    assert df.rdd.getNumPartitions() == 4 and sorted(r.id for r in df.collect()) == list(range(10))
    with pytest.raises(ValueError, match="import"):
        bulk.read(spark, "x.txt")
    assert ("imp_x", 2) in bulk.tables(spark)


def test_archives(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/one.csv", "a\n1\n")
        z.writestr("d/skip.txt", "")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("e/two.csv")
        info.size = 4
        t.addfile(info, io.BytesIO(b"a\n2\n"))
    out = str(tmp_path / "out")
    assert [p.rsplit("/", 1)[1] for p in bulk.extract(str(tmp_path / "a.zip"), out) + bulk.extract(str(tmp_path / "b.tar.gz"), out)] == ["one.csv", "two.csv"]
    (tmp_path / "out/one.csv").write_text("kept")
    bulk.extract(str(tmp_path / "a.zip"), out)
    assert (tmp_path / "out/one.csv").read_text() == "kept"
    assert [bulk.archive_stem(x) for x in ("d/b.tar.gz", "b.tgz", "a.zip")] == ["b", "b", "a"]
    with pytest.raises(ValueError, match="archive"):
        bulk.extract("x.rar", out)


def test_registry(spark):
    assert [(r.dataset, r.kind) for r in bulk.releases(spark).collect()][4] == ("hemibrain", "compact-adjacencies")
    with pytest.raises(ValueError, match="there are"):
        bulk.release("x", "y")


def test_live(spark, connections):
    cells = spark.createDataFrame([(101, "ORN", "a_R"), (201, "PN", "b_L"), (202, None, None)], "bodyId long, type string, instance string")
    assert [r.bodyId for r in live.neurons(cells, type_contains="o").collect()] == [101]
    e = edges.edges(connections).select("pre_id", "post_id", "weight")
    assert [(r.upstream_bodyId, r.downstream_type, r.weight) for r in live.connections(e, cells, min_weight=3).collect()] == [(101, "PN", 7), (101, None, 3)]
    connections.createOrReplaceTempView("live_t")
    assert live.statement(spark, "SELECT * FROM live_t LIMIT 3", 1).count() == 3
    assert live.statement(spark, "SELECT * FROM live_t", 1).count() == 1
    assert live.table(spark, "live_t", {"nt_type": "gaba"}, {"pre_pt_root_id": [103]}, ["n_synapses"]).collect()[0][0] == 2


def test_sinks():
    rows = [{"a": "1", "b": "xyz"}]
    assert sink.render(rows, ["b", "a"]) == "b    a\n---  -\nxyz  1\n"
    assert sink.render(rows, ["a"], "csv") == "a\r\n1\r\n"
    assert json.loads(sink.render(rows, ["a"], "json")) == rows
    assert sink.render(rows, None, "jsonl") == '{"a":"1","b":"xyz"}\n'
    assert sink.render([], None, "csv") == ""


def test_cache(spark, tmp_path):
    calls = []

    def fetch():
        calls.append(1)
        return spark.createDataFrame([(1, "3")], "id long, weight string")

    ask = lambda **k: sink.get_or_fetch(spark, str(tmp_path), "flywire", "table", {"t": "x"}, fetch, **k)
    assert ask(offline_only=True) == (None, "miss")
    assert ask()[1] == "live" and ask()[1] == "cache" and len(calls) == 1
    (tmp_path / "bad.json").write_text("{")
    assert [x["rows"] for x in sink.cached(spark, str(tmp_path))] == [1]
    assert len(sink.cache_key("a", "b", {})) == 20 and sink.payload({"a": None, "b": [], "c": 0, "d": "x"}) == {"c": 0, "d": "x"}


def test_environment(tmp_path, monkeypatch):
    (tmp_path / "e").write_text("# c\nAX_A='1'\nAX_B=2\n\n")
    monkeypatch.setenv("AX_B", "kept")
    monkeypatch.delenv("AX_A", raising=False)
    load_env(str(tmp_path / "e"))
    assert setting("AX_NONE", "AX_A") == "1" and setting("AX_B") == "kept" and load_env("nothing") == {}
    with pytest.raises(KeyError):
        setting("AX_NONE", required=True)
    monkeypatch.delenv("AX_A", raising=False)


def test_plot_data(spark):
    df = spark.createDataFrame([("a", "1", "5", 0), ("a", "1", "7", 1), ("b", "x", "9", 2)], "g string, x string, v string, _ordinal long")
    assert [tuple(r) for r in plotdata.heatmap(df, "x", "g", "v").collect()] == [("a", "1", 7.0), ("b", "x", 9.0)]
    assert [r.area for r in plotdata.bubbles(df, "x", "v", "v").orderBy("y").collect()] == [20.0, 130.0, 240.0]
    assert {r.area for r in plotdata.bubbles(df.limit(1), "x", "v", "v").collect()} == {130.0}
    h = plotdata.histogram(df, "v").collect()
    assert sum(r["count"] for r in h) == 3 and h[-1].high == 9.0 and h[-1].bin == 7
    assert plotdata.histogram(df.limit(1), "v").collect()[0]["count"] == 1
    assert [(r.group, r.median) for r in plotdata.violins(df, "g", "v").collect()] == [("a", 6.0), ("b", 9.0)]
    assert [r.x for r in plotdata.lines(df, "x", "v", "g").collect()] == [1.0, 1.0, 0.0]
    with pytest.raises(ValueError, match="needed: y"):
        plotdata.points(df, "x", None)


def test_command_line(spark, tmp_path, capsys):
    root = make_catalog(tmp_path / "data")
    catalog.write_manifest(spark, str(root))

    def run(*argv):
        assert cli.main(["--data-dir", str(root), "--env-file", "", *argv]) == 0
        return capsys.readouterr().out

    assert "flywire" in run("datasets")
    assert run("head", "--table", "flywire:full_summary", "--limit", "1", "--format", "csv") == "LN_type,bodyId,cell.type\r\nlLN2P,7,q\r\n"
    assert run("aggregate", "--table", "flywire:source_audit/orn_partner_counts_by_hemisphere", "--by", "LN_type", "--sum", "n_synapses", "--format", "csv").splitlines()[1] == "lLN2,2,5"
    assert "lLN2P" in run("ln", "lln2p")
    assert run("path", "--table", "flywire_full_summary").strip().endswith("flywire/full_summary.csv")
    (tmp_path / "c.csv").write_text("pre,post,weight,roi\n1,2,5,AL_R\n1,3,2,AL_L\n")
    run("bulk", "import", "--path", str(tmp_path / "c.csv"), "--table", "cli_c", "--replace")
    assert list(csv.DictReader(run("bulk", "outputs", "--table", "cli_c", "--body-id", "1", "--format", "csv").splitlines()))[0] == {"partner_id": "2", "roi": "AL_R", "total_weight": "5", "connection_rows": "1"}
    assert "cli_c_edges" in run("bulk", "views", "--table", "cli_c")
    assert json.loads(run("bulk", "query", "--table", "cli_c", "--where", "post=3", "--format", "json"))[0]["weight"] == "2"
    assert "AL_R   5" in run("plot", "--csv", str(tmp_path / "c.csv"), "--kind", "bar", "--x", "roi", "--y", "weight")


def test_snapshot(spark, tmp_path):
    from axonspark.sources import snapshot

    root = make_catalog(tmp_path / "in")
    (tmp_path / "out").mkdir()
    (tmp_path / "out/old.csv").write_text("a\n")
    n = snapshot.build(spark, str(root), str(tmp_path / "out"), [("hemibrain", "hemibrain"), ("flywire", "flywire"), ("nothing", "x")], frozenset(["source_audit"]))
    assert n == 4 and {t.dataset for t in catalog.Catalog(spark, str(tmp_path / "out")).entries} == {"hemibrain", "flywire"}
    with pytest.raises(FileNotFoundError):
        snapshot.build(spark, "nowhere", str(tmp_path / "out"), [])


def test_drawing_needs_its_library(spark):
    from axonspark.operators import plots

    try:
        import matplotlib  # noqa: F401
    except ImportError:
        with pytest.raises(SystemExit):
            plots.save(spark.range(1), "bar", "x")


def test_atlas_and_cache_from_the_command_line(spark, tmp_path, capsys):
    def run(*argv, code=0):
        assert cli.main(["--env-file", "", *argv]) == code
        return capsys.readouterr().out

    (tmp_path / "e.csv").write_text("bodyId_pre,bodyId_post,roi,weight\n1001,2001,AL(R),12\n1002,2001,AL(L),5\n")
    (tmp_path / "n.csv").write_text("bodyId,type,instance\n1001,ORN_DM1,ORN_DM1_R\n1002,ORN_DM1,ORN_DM1_L\n2001,DM1_lPN,DM1_lPN_R\n9,x,y\n")
    run("bulk", "import", "--path", str(tmp_path / "e.csv"), "--table", "hemibrain_traced_roi_connections", "--replace")
    run("bulk", "import", "--path", str(tmp_path / "n.csv"), "--table", "hemibrain_traced_neurons", "--replace")
    built = run("olfaction", "build", "--prefix", "c1", "--dataset", "hemibrain", "--format", "csv")
    assert "hemibrain,hemibrain_traced_roi_connections,2,imported" in built
    sides = run("olfaction", "orn-inputs", "--prefix", "c1", "--glomerulus", "DM1", "--by-side", "--format", "csv").splitlines()
    assert sides[1] == "hemibrain,2001,DM1_lPN,DM1,1,12,R,R,ipsi" and sides[2].endswith("5,R,L,contra")
    assert "c1_neurons" in run("olfaction", "tables", "--prefix", "c1")
    assert run("olfaction", "pns", "--prefix", "c1", "--format", "csv").count("\n") == 2
    assert run("live", "hemibrain", "neurons", "--type-contains", "orn", "--format", "csv").count("\n") == 3
    cache = ["offline", "--cache-dir", str(tmp_path / "cache")]
    fetch = ["fetch", "--dataset", "hemibrain", "--action", "connections", "--upstream-body-id", "1001", "--format", "csv"]
    run(*cache, *fetch, "--offline-only", code=1)
    assert "DM1_lPN" in run(*cache, *fetch) and "DM1_lPN" in run(*cache, *fetch, "--offline-only")
    assert "connections" in run(*cache, "list")
    spark.sql("DROP TABLE hemibrain_traced_roi_connections")
    spark.sql("DROP TABLE hemibrain_traced_neurons")
