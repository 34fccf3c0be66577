"""Command line: catalog tables, connection tables, the derived atlas, and live or cached questions."""

from __future__ import annotations

import argparse
import sys
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession

from axonspark.operators import edges, live, plotdata, predicates, search, sink
from axonspark.operators.aggregate import aggregate
from axonspark.plans import atlas, questions
from axonspark.session import load_env, session, setting
from axonspark.sources import bulk, catalog, services

DATASETS = ("hemibrain", "flywire", "comparison")


def _out(args: argparse.Namespace, df: DataFrame | None = None, rows: list[dict] | None = None, columns: list[str] | None = None) -> int:
    always = args.command in ("files", "schema", "head", "query", "aggregate", "ln", "partners")
    if df is None:
        sys.stdout.write(sink.render(rows or [], columns if rows or always else None, args.format))
        return 0
    for piece in sink.stream(df, columns or (df.columns if always else None), args.format):
        sys.stdout.write(piece)
    return 0


def _plain(df: DataFrame, columns: list[str]) -> DataFrame:
    return predicates.project(df, columns)


def _table(args, spark) -> tuple[DataFrame, list[str]]:
    c = catalog.Catalog(spark, args.data_dir)
    t = c.resolve(args.table)
    return c.open(t), list(t.columns)


def cmd_catalog(args: argparse.Namespace, spark: SparkSession) -> int:
    c = catalog.Catalog(spark, args.data_dir)
    if args.command == "datasets":
        return _out(args, c.datasets())
    if args.command == "files":
        names = [f.name for f in fields(catalog.Table) if f.name != "columns"]
        return _out(args, rows=[{n: str(getattr(t, n)) for n in names} for t in c.tables(args.dataset, args.contains)], columns=names)
    if args.command == "schema":
        return _out(args, rows=[dict(zip(("index", "column", "file_id"), map(str, r), strict=True)) for r in c.schema(args.table)], columns=["index", "column", "file_id"])
    print(c.path(args.table))
    return 0


def cmd_rows(args: argparse.Namespace, spark: SparkSession) -> int:
    df, columns = _table(args, spark)
    exact, contains = predicates.parse_filters(getattr(args, "where", [])), predicates.parse_filters(getattr(args, "contains", []))
    if args.command == "aggregate":
        return _out(args, aggregate(df, predicates.split_list(args.by), predicates.split_list(args.sum), predicates.split_list(args.mean), exact, contains, args.limit))
    kept = predicates.head(predicates.where(df, exact, contains).orderBy("_ordinal"), args.limit)
    return _out(args, _plain(kept, predicates.split_list(args.select) or columns))


def cmd_search(args: argparse.Namespace, spark: SparkSession) -> int:
    c = catalog.Catalog(spark, args.data_dir)
    if args.command == "ln":
        return _out(args, search.find_local_neurons(c, args.name, args.dataset, args.limit))
    if args.command == "partners":
        return _out(args, search.find_partners(c, args.dataset, args.name, args.kind, args.limit))
    t = c.resolve("comparison:matched_ln_class_similarity")
    return _out(args, _plain(search.compare(c.open(t), args.name).orderBy("_ordinal"), list(t.columns)))


def cmd_plot(args: argparse.Namespace, spark: SparkSession) -> int:
    """Prints the data behind a plot; drawing isn't part of the engine."""
    df = catalog.open_csv(spark, args.csv) if args.csv else _table(args, spark)[0]
    df = predicates.where(df, predicates.parse_filters(args.where), predicates.parse_filters(args.contains))
    df = df.orderBy("_ordinal").limit(args.limit) if args.limit else df
    made = {
        "scatter": lambda: plotdata.points(df, args.x, args.y, args.color), "line": lambda: plotdata.lines(df, args.x, args.y, args.color), "bar": lambda: plotdata.bars(df, args.x, args.y),
        "hist": lambda: plotdata.histogram(df, args.value or args.x), "violin": lambda: plotdata.violins(df, args.x, args.y), "bubble": lambda: plotdata.bubbles(df, args.x, args.y, args.size, args.color),
        "heatmap": lambda: plotdata.heatmap_table(df, args.x, args.y, args.value),
    }[args.kind]()
    return _out(args, made)


def _served(args: argparse.Namespace, spark: SparkSession, action: str) -> DataFrame | None:
    """The answer of a live service, if the environment has a token for it."""
    ids = predicates.parse_ids
    if action in ("neurons", "connections", "cypher"):
        if not setting(*services.GRAPH_TOKENS):
            return None
        if action == "neurons":
            contains = {k: v for k, v in (("type_contains", args.type_contains), ("instance_contains", args.instance_contains)) if v}
            return live.neurons(services.graph(spark, **contains), ids(args.body_id), limit=args.limit)
        if action == "connections":
            return live.hops(services.graph(spark, "connections"), ids(args.upstream_body_id), ids(args.downstream_body_id), args.min_weight, args.limit)
        return services.graph(spark, query=services.limited(args.query, args.limit))
    if not setting(*services.TABLE_TOKENS):
        return None
    if action == "tables":
        return spark.createDataFrame([(n,) for n in services.table_names()], "table string")
    options = {} if args.materialization_version is None else {"version": str(args.materialization_version)}
    if action == "synapses":
        df = services.table(spark, live.SYNAPSES, columns=",".join(live.SYNAPSE_COLUMNS), limit=str(args.limit), **options)
        return predicates.member(df, None, live.synapse_filters(ids(args.pre_root_id), ids(args.post_root_id)), list(live.SYNAPSE_COLUMNS), args.limit)
    exact = {c: predicates.parse_scalar(v) for c, v in predicates.parse_filters(args.where)}
    return predicates.member(services.table(spark, args.table, limit=str(args.limit), **options), exact, predicates.parse_memberships(args.within), predicates.split_list(args.select), args.limit)


def _live(args: argparse.Namespace, spark: SparkSession, action: str) -> DataFrame:
    """From the service, or, without a token for it, from the session's tables."""
    ids = predicates.parse_ids
    served = _served(args, spark, action)
    if served is not None:
        return served
    if action == "neurons":
        return live.neurons(spark.table(atlas.INSTANCE_TABLES[1]), ids(args.body_id), args.type_contains, args.instance_contains, args.limit)
    if action == "connections":
        e = edges.edges(spark.table(atlas.SPECS[0].table)).select("pre_id", "post_id", "weight")
        return live.connections(e, spark.table(atlas.INSTANCE_TABLES[1]), ids(args.upstream_body_id), ids(args.downstream_body_id), args.min_weight, args.limit)
    if action == "cypher":
        return live.statement(spark, args.query, args.limit)
    if action == "tables":
        return spark.createDataFrame([(n,) for n in live.table_names(spark)], "table string")
    if action == "synapses":
        return live.synapses(spark, ids(args.pre_root_id), ids(args.post_root_id), args.limit, args.materialization_version)
    exact = {c: predicates.parse_scalar(v) for c, v in predicates.parse_filters(args.where)}
    return live.table(spark, args.table, exact, predicates.parse_memberships(args.within), predicates.split_list(args.select), args.limit, args.materialization_version)


def cmd_live(args: argparse.Namespace, spark: SparkSession) -> int:
    return _out(args, _live(args, spark, args.action))


def cmd_offline(args: argparse.Namespace, spark: SparkSession) -> int:
    if args.offline_action == "list":
        return _out(args, rows=[{k: str(x.get(k, "")) for k in ("dataset", "action", "key", "rows", "created_at", "path")} for x in sink.cached(spark, args.cache_dir)])
    skip = ("func", "command", "format", "cache_dir", "refresh", "offline_only", "data_dir", "env_file", "offline_action", "action", "dataset", "warehouse")
    query = sink.payload({k: v for k, v in vars(args).items() if k not in skip})
    df, where = sink.get_or_fetch(spark, args.cache_dir, args.dataset, args.action, query, lambda: _live(args, spark, args.action), args.refresh, args.offline_only)
    if df is None:
        print("not in the cache", file=sys.stderr)
        return 1
    print(where, file=sys.stderr)
    return _out(args, df)


def cmd_bulk(args: argparse.Namespace, spark: SparkSession) -> int:
    a = args.action
    if a == "sources":
        return _out(args, bulk.releases(spark))
    if a == "download":
        return _out(args, rows=[{"path": bulk.download(args.dataset, args.kind, args.output, args.force)}])
    if a == "extract":
        return _out(args, rows=[{"path": p} for p in bulk.extract(args.path, args.output, args.force)])
    if a == "import":
        table, n = bulk.load(spark, args.path, args.table, args.replace)
        return _out(args, rows=[{"table": table, "rows": str(n)}])
    if a == "tables":
        return _out(args, rows=[{"table": t, "rows": str(n)} for t, n in bulk.tables(spark)])
    if a == "schema":
        return _out(args, rows=[dict(zip(("column", "type", "nullable"), r, strict=True)) for r in bulk.columns(spark.table(edges.identifier(args.table)))])
    if a == "views":
        return _out(args, rows=[{"view": v} for v in edges.create_views(spark, args.table, args.prefix)])
    if a == "optimize":
        return _out(args, rows=edges.optimize(spark, args.table, args.prefix))
    df = spark.table(edges.identifier(args.table))
    if a == "query":
        return _out(args, predicates.equal(df, predicates.parse_filters(args.where), predicates.split_list(args.select), args.limit))
    if a == "connections":
        return _out(args, edges.connections(df, args.pre, args.post, args.min_weight, args.limit))
    if a == "partners":
        return _out(args, edges.partners(df, args.body_id, args.min_weight, args.limit))
    return _out(args, edges.neighbours(df, args.body_id, a == "inputs", args.min_weight, args.limit))


def cmd_olfaction(args: argparse.Namespace, spark: SparkSession) -> int:
    t = lambda name: atlas.open_table(spark, name, args.prefix)
    a = args.action
    if a == "build":
        return _out(args, rows=atlas.build_tables(spark, tuple(args.dataset or ("hemibrain", "flywire")), not args.keep_existing, args.prefix))
    if a == "cache-annotations":
        if not atlas.published(spark, args.prefix) and not spark.catalog.tableExists(f"{edges.identifier(args.prefix)}_neurons"):
            atlas.build_tables(spark, prefix=args.prefix)
        cells = t("neurons")
        made = []
        for source, target, column in ((args.instances, atlas.INSTANCE_TABLES[0], "bodyId"), (args.hierarchy, atlas.HIERARCHY_TABLE, "pt_root_id"), (args.tags, atlas.TAG_TABLE, "pt_root_id")):
            if source:
                atlas.limit_annotations(bulk.read(spark, source), column, cells).write.mode("overwrite").format("parquet").saveAsTable(target)
                made.append({"table": target, "rows": str(spark.table(target).count())})
        return _out(args, rows=made + [{k: r[k] for k in ("table", "rows")} for r in atlas.build_tables(spark, prefix=args.prefix)])
    if a == "tables":
        return _out(args, rows=[{"table": n, "rows": str(k)} for n, k in questions.table_counts(spark, args.prefix)])
    if a == "neurons":
        return _out(args, questions.neuron_list(t("neurons"), args.limit, dataset=args.dataset, region=args.region, cell_class=args.cell_class, glomerulus=args.glomerulus, contains=args.contains))
    if a == "edges":
        return _out(args, questions.edge_list(t("edges_by_neuropil"), args.dataset, args.region, args.pre_id, args.post_id, args.min_synapses, args.limit))
    if a == "pns":
        return _out(args, questions.projection_neurons(t("neurons"), args.dataset, args.glomerulus, args.limit))
    return _out(args, questions.receptor_inputs(t("edges_by_neuropil"), t("neurons"), args.dataset, args.glomerulus, args.pn_type, args.by_side, args.limit))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="axonspark")
    p.add_argument("--data-dir")
    p.add_argument("--env-file", default=".env")
    p.add_argument("--warehouse", default="spark-warehouse")
    top = p.add_subparsers(dest="command", required=True)

    def add(group, name: str, func, *options, limit: int | None = None) -> argparse.ArgumentParser:
        q = group.add_parser(name)
        q.set_defaults(func=func)
        for names, kw in options:
            q.add_argument(*names, **kw)
        if limit is not None:
            q.add_argument("--limit", type=int, default=limit)
        q.add_argument("--format", choices=sink.FORMATS, default="table")
        return q

    opt = lambda *names, **kw: (names, kw)
    many = lambda *names, **kw: (names, {"action": "append", "default": [], **kw})
    flag = lambda name: ((name,), {"action": "store_true"})
    table, where, contains, select = opt("--table", required=True), many("--where"), many("--contains"), opt("--select")
    prefix, force = opt("--prefix"), flag("--force")
    add(top, "datasets", cmd_catalog)
    add(top, "files", cmd_catalog, opt("--dataset", choices=DATASETS), opt("--contains"))
    add(top, "schema", cmd_catalog, table)
    add(top, "path", cmd_catalog, table)
    add(top, "head", cmd_rows, table, select, limit=10)
    add(top, "query", cmd_rows, table, where, contains, select, limit=100)
    add(top, "aggregate", cmd_rows, table, opt("--by", required=True), opt("--sum", default=""), opt("--mean", default=""), where, contains, limit=100)
    add(top, "ln", cmd_search, opt("name"), opt("--dataset", choices=DATASETS), limit=200)
    add(top, "partners", cmd_search, opt("name"), opt("--dataset", choices=DATASETS[:2], required=True), opt("--kind", choices=("orn", "pn"), required=True), limit=100)
    add(top, "compare", cmd_search, opt("name"))
    plot = add(top, "plot", cmd_plot, opt("--kind", choices=plotdata.KINDS, required=True), *[opt(f"--{x}") for x in ("x", "y", "value", "color", "size")], where, contains, limit=0)
    source = plot.add_mutually_exclusive_group(required=True)
    source.add_argument("--table")
    source.add_argument("--csv")

    version = opt("--materialization-version", type=int)
    neurons = [many("--body-id"), opt("--type-contains"), opt("--instance-contains")]
    hops = [many("--upstream-body-id"), many("--downstream-body-id"), opt("--min-weight", type=int, default=1)]
    roots = [many("--pre-root-id"), many("--post-root-id")]
    rows = [where, many("--in", dest="within"), select]
    query = opt("--query", required=True)
    services = top.add_parser("live").add_subparsers(dest="service", required=True)
    for name, actions in (("hemibrain", (("neurons", neurons, 20), ("connections", hops, 50), ("cypher", [query, opt("--limit", type=int)], None))), ("flywire", (("tables", [], None), ("table", [table, *rows, version], 50), ("synapses", [*roots, version], 50)))):
        group = services.add_parser(name).add_subparsers(dest="action", required=True)
        for action, options, n in actions:
            add(group, action, cmd_live, *options, limit=n)
    offline = top.add_parser("offline")
    offline.add_argument("--cache-dir", default="cache/live")
    group = offline.add_subparsers(dest="offline_action", required=True)
    add(group, "list", cmd_offline)
    actions = opt("--action", choices=("neurons", "connections", "cypher", "tables", "table", "synapses"), required=True)
    add(group, "fetch", cmd_offline, opt("--dataset", choices=DATASETS[:2], required=True), actions, *neurons, *hops, *roots, opt("--query"), opt("--table"), *rows, version, flag("--refresh"), flag("--offline-only"), limit=50)

    group = top.add_parser("bulk").add_subparsers(dest="action", required=True)
    weight = opt("--min-weight", type=int, default=1)
    add(group, "sources", cmd_bulk)
    add(group, "download", cmd_bulk, opt("--dataset", required=True), opt("--kind", required=True), opt("--output", default="bulk"), force)
    add(group, "import", cmd_bulk, opt("--path", required=True), table, flag("--replace"))
    add(group, "extract", cmd_bulk, opt("--path", required=True), opt("--output", required=True), force)
    add(group, "tables", cmd_bulk)
    add(group, "schema", cmd_bulk, table)
    add(group, "query", cmd_bulk, table, where, select, limit=50)
    add(group, "connections", cmd_bulk, table, opt("--pre"), opt("--post"), weight, limit=50)
    for action in ("inputs", "outputs", "partners"):
        add(group, action, cmd_bulk, table, opt("--body-id", required=True), weight, limit=50)
    add(group, "views", cmd_bulk, table, prefix)
    add(group, "optimize", cmd_bulk, table, prefix)

    group = top.add_parser("olfaction").add_subparsers(dest="action", required=True)
    prefix, dataset, glomerulus = opt("--prefix", default="olf"), opt("--dataset", choices=DATASETS[:2]), opt("--glomerulus")
    add(group, "build", cmd_olfaction, prefix, opt("--dataset", action="append", choices=DATASETS[:2]), flag("--keep-existing"))
    add(group, "cache-annotations", cmd_olfaction, prefix, opt("--instances"), opt("--hierarchy"), opt("--tags"))
    add(group, "tables", cmd_olfaction, prefix)
    add(group, "neurons", cmd_olfaction, prefix, dataset, opt("--region"), opt("--cell-class"), glomerulus, opt("--contains"), limit=50)
    add(group, "edges", cmd_olfaction, prefix, dataset, opt("--region"), opt("--pre-id"), opt("--post-id"), opt("--min-synapses", type=int, default=1), limit=50)
    add(group, "pns", cmd_olfaction, prefix, dataset, glomerulus, limit=50)
    add(group, "orn-inputs", cmd_olfaction, prefix, dataset, glomerulus, opt("--pn-type"), flag("--by-side"), limit=50)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    load_env(args.env_file)
    spark = session(spark__sql__warehouse__dir=args.warehouse, spark__ui__enabled="false", spark__sql__catalogImplementation="hive")
    return args.func(args, spark)
