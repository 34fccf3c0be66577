"""What has to hold however large the data are: layouts, results of any length, quantiles, stores, builds that break off."""

import csv
import json
import os
import random
from collections import Counter

import pyarrow as pa
import pyarrow.feather
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from axonspark.operators import edges, plotdata, search, sink
from axonspark.plans import adaptor, atlas, questions
from axonspark.sources import arrow_ipc, catalog, store


def rows_scanned(df) -> int:
    """Rows that the file scan of a query gives after skipping."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(int(leaves.apply(k).metrics().apply("numOutputRows").value()) for k in range(leaves.size()))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_layout_by_both_ends(spark, kind):
    n = 240_000
    ids = lambda salt: (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(6000)) * 7 + 720575940600000000).cast(kind)
    hub = F.when(F.col("id") % 10 == 0, F.lit(720575940600000000).cast(kind))
    df = spark.range(n).select(F.coalesce(hub, ids(1)).alias("pre_pt_root_id"), ids(2).alias("post_pt_root_id"), F.lit("AL").alias("neuropil"), (F.col("id") % 9).alias("syn_count"))
    df.write.mode("overwrite").saveAsTable("wide")
    done = edges.optimize(spark, "wide", group_bytes=16 << 10)
    assert [(x["action"], x["name"]) for x in done] == [("order", "wide_by_both"), ("analyze", "wide"), ("analyze", "wide_by_both")]
    laid = spark.table("wide_by_both")
    assert laid.exceptAll(spark.table("wide")).isEmpty() and laid.count() == n
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        r = random.Random(1)
        for column in ("pre_pt_root_id", "post_pt_root_id"):
            for v in r.sample(range(1, 6000), 5):
                wanted = spark.table("wide_by_both").where(F.col(column) == F.lit(720575940600000000 + v * 7).cast(kind))
                assert rows_scanned(wanted) <= 0.1 * n and wanted.count() == spark.table("wide").where(F.col(column) == F.lit(720575940600000000 + v * 7).cast(kind)).count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_morton_order(spark):
    got = [r[0] for r in spark.createDataFrame([(0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (3, 3), (0, 2)], "a int, b int").select(edges.interleaved(F.col("a"), F.col("b"), 4)).collect()]
    assert got == [0, 1, 2, 3, 4, 15, 8]


@pytest.mark.parametrize("form", sink.FORMATS)
def test_results_of_any_length(spark, form):
    df = spark.range(250).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit('a"\n, '), F.col("id").cast("string"))).alias("text"), (F.col("id") / 4).alias("v"), F.repeat(F.lit("é"), (F.col("id") % 31).cast("int")).alias("w")).repartition(6, "id").sortWithinPartitions("id")
    whole = sink.render(sink.rows_of(df), df.columns, form)
    assert "".join(sink.stream(df, df.columns, form, few=20)) == whole == "".join(sink.stream(df, df.columns, form))
    none = df.where("id < 0")
    assert "".join(sink.stream(none, none.columns, form)) == sink.render([], none.columns, form)


def test_exact_quantiles_of_large_groups(spark):
    n = 90_000
    df = spark.range(n, numPartitions=5).select(
        F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 300 == 0, "few").otherwise("ties").alias("g"),
        F.when(F.col("id") % 3 > 0, F.exp(F.pmod(F.xxhash64("id"), F.lit(2000)) / 50.0)).otherwise(F.pmod(F.col("id"), F.lit(4)).cast("double")).alias("v"),
    )
    df = df.unionByName(spark.createDataFrame([("one", 2.5), ("two", 1.0), ("two", 4.0)], "g string, v double"))
    wanted = {"a": 0.0, "b": 0.01, "c": 0.25, "d": 0.5, "e": 0.75, "f": 1.0}
    got = {r.g: r for r in plotdata.quantiles(df, "g", "v", wanted).collect()}
    want = {r.g: r for r in df.groupBy("g").agg(F.count("*").alias("count"), F.min("v").alias("low"), F.max("v").alias("high"), *[F.percentile("v", q).alias(m) for m, q in wanted.items()]).collect()}
    assert got.keys() == want.keys() and got["hot"]["count"] > 3 * plotdata.SKETCH
    for g, w in want.items():
        assert (got[g]["count"], got[g].low, got[g].high) == (w["count"], w.low, w.high)
        assert [got[g][m] for m in wanted] == pytest.approx([w[m] for m in wanted], rel=1e-12)


def test_arrow_files_through_sparks_readers(spark, tmp_path):
    t = pa.table({"id": pa.array(range(100), pa.int64()), "s": [f"é{k}" for k in range(100)], "v": [None if k % 3 else k / 2 for k in range(100)]})
    path = str(tmp_path / "x y.feather")
    pyarrow.feather.write_feather(t, path, chunksize=30, compression="zstd")
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.shelf.link./data", f"file://{tmp_path}")
    for p, parts in ((path, 4), (f"file:{path}", 4), (f"file://{path}", 4), ("viewfs://shelf/data/x y.feather", 1)):
        df = arrow_ipc.read_arrow(spark, p)
        assert df.rdd.getNumPartitions() == parts and sorted(tuple(r) for r in df.collect()) == sorted(zip(*t.to_pydict().values(), strict=True))


def test_small_files_on_sparks_stores(spark, tmp_path):
    base = f"file://{tmp_path}/notes"
    assert store.read_text(spark, base + "/a.json") is None and store.files(spark, base, ".json") == []
    for text in ("é\n", "two"):
        store.write_text(spark, base + "/a.json", text)
        assert store.read_text(spark, base + "/a.json") == text
    assert [p.rsplit("/", 1)[1] for p in store.files(spark, base, ".json")] == ["a.json"]
    store.delete(spark, base + "/a.json")
    assert store.files(spark, base, ".json") == []


def test_a_refresh_that_breaks_off_leaves_the_old_result(spark, tmp_path):
    ask = lambda fetch, **k: sink.get_or_fetch(spark, f"file://{tmp_path}", "d", "a", {"q": 1}, fetch, **k)
    assert ask(lambda: spark.range(3))[1] == "live"
    broken = lambda: spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        ask(broken, refresh=True)
    assert ask(broken)[0].count() == 3 and ask(lambda: spark.range(4), refresh=True)[0].count() == 4
    assert len(list(tmp_path.glob("d/a/*.parquet"))) == 2  # the new one and what broke off


def test_a_build_that_breaks_off_leaves_the_old_atlas(spark, monkeypatch):
    schema = "pre_pt_root_id long, post_pt_root_id long, neuropil string, syn_count long"
    put = lambda rows: spark.createDataFrame(rows, schema).write.mode("overwrite").saveAsTable("flywire_proofread_connections")
    put([(1, 2, "AL_R", 3)])
    atlas.build_tables(spark, ("flywire",), prefix="v1")
    first = atlas.published(spark, "v1")
    put([(1, 2, "AL_R", 3), (2, 3, "LH_L", 4)])
    whole = atlas.edges_total
    monkeypatch.setattr(atlas, "edges_total", lambda e: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        atlas.build_tables(spark, ("flywire",), prefix="v1")
    counts = dict(questions.table_counts(spark, "v1"))
    assert atlas.published(spark, "v1") == first and set(counts.values()) == {1, 2} and counts["v1_edges_by_neuropil"] == counts["v1_edges_total"] == spark.table("v1_edges_total").count() == 1
    monkeypatch.setattr(atlas, "edges_total", whole)
    atlas.build_tables(spark, ("flywire",), prefix="v1")
    assert dict(questions.table_counts(spark, "v1"))["v1_edges_total"] == spark.table("v1_edges_total").count() == 2
    versions = {t.name.rpartition("__")[2] for t in spark.catalog.listTables() if t.name.startswith("v1_") and "__" in t.name}
    assert versions == {first, atlas.published(spark, "v1")}


def test_later_families_stay_closed(spark, tmp_path):
    for name, text in (("flywire/full_summary.csv", "LN_type,bodyId\nlLN2P,7\nlLN2F,8\n"), ("comparison/shared_type_comparison.csv", "comparison_name\nlLN2\n")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    catalog.write_manifest(spark, str(tmp_path))
    c = catalog.Catalog(spark, str(tmp_path))
    assert [r.matched_value for r in search.find_local_neurons(c, "lln2", limit=3).collect()] == ["lLN2P", "lLN2F", "lLN2"]
    (tmp_path / "comparison/shared_type_comparison.csv").unlink()
    assert [r.matched_value for r in search.find_local_neurons(c, "lln2", limit=2).collect()] == ["lLN2P", "lLN2F"]
    with pytest.raises(Exception):
        search.find_local_neurons(c, "lln2", limit=3)
    assert json.loads(sink.render([{"a": "1"}], None, "json")) == [{"a": "1"}]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_catalog_files_are_sorted_by_many_tasks(spark, tmp_path, monkeypatch):
    seen = []
    listed = store.files

    def spy(s, root, suffix):
        got = listed(s, root, suffix)
        seen.extend(sum(1 for _ in open(p.removeprefix("file:"), "rb")) for p in got)
        return got

    monkeypatch.setattr(store, "files", spy)
    monkeypatch.setattr(adaptor, "TASK_ROWS", 300, raising=False)
    monkeypatch.setattr(adaptor, "shared", lambda s, name: f"file://{tmp_path}/{name}")
    made = adaptor.catalog(spark, "/root/testdata/sf0.001", "inputs")
    rows = adaptor.load(spark, "/root/testdata/sf0.001", adaptor.CATALOG["inputs"]).collect()
    assert len(seen) > 16 and sum(seen) == len(rows) and max(seen) <= 600
    assert {t.relative_path: t.rows for t in made.entries} == dict(Counter(r.file for r in rows))
    names = ["LN_instance", "LN_bodyid", "glomerulus", "n_inputs", "n_ipsi_inputs", "n_contra_inputs"]
    for t in made.entries:
        with open(tmp_path / "catalog" / t.relative_path, newline="") as f:
            got = list(csv.reader(f))
        want = sorted((r.k, *[r[c] for c in names]) for r in rows if r.file == t.relative_path)
        assert got == [names, *[[str(x) for x in r[1:]] for r in want]]
    assert [p.name for p in (tmp_path / "catalog").iterdir() if "inputs" in p.name] == []


def test_files_of_a_manifest_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    for k in range(6):
        (tmp_path / f"{k}.csv").write_text("a\n1\n")

    def where(batches):
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_pydict({"path": b.column(0), "rows": pa.array([TaskContext.get().partitionId()] * n, pa.int64()), "columns": ["a"] * n, "sha256": [""] * n})

    monkeypatch.setattr(catalog, "_described", where)
    assert len({r.rows for r in catalog.build_manifest(spark, str(tmp_path)).collect()}) == 6
