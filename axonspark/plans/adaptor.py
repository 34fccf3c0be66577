"""The driver's test tables seen as connection and annotation tables.

The expressions are SQL text that Spark and other engines read alike, so each is
written once.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from axonspark.sources import csv_split, store
from axonspark.sources.catalog import Catalog, write_manifest

DATASET = "CASE WHEN l_returnflag = 'A' THEN 'hemibrain' ELSE 'flywire' END"
NEUROPIL = (
    "concat(CASE WHEN l_linenumber IN (1, 2) THEN 'AL' WHEN l_linenumber = 3 THEN 'LH' WHEN l_linenumber = 4 THEN 'MB_CA' WHEN l_linenumber = 5 THEN 'MB(+ACA)' ELSE 'GNG' END, "
    "CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN '(R)' WHEN l_returnflag = 'N' THEN '(L)' WHEN l_linestatus = 'O' THEN '_R' ELSE '_L' END)"
)
EDGES = f"SELECT {DATASET} AS dataset, l_suppkey AS pre, l_partkey AS post, {NEUROPIL} AS neuropil, CAST(l_quantity AS BIGINT) AS weight FROM lineitem"
TYPE = (
    "CASE p_partkey % 6 WHEN 0 THEN concat('ORN_DM', CAST(p_partkey % 7 AS STRING)) WHEN 1 THEN concat('DM', CAST(p_partkey % 7 AS STRING), '_lPN') "
    "WHEN 2 THEN concat('lLN', CAST(p_partkey % 5 AS STRING)) WHEN 3 THEN 'KCg' WHEN 4 THEN concat('MBON0', CAST(p_partkey % 4 AS STRING)) ELSE p_name END"
)
INSTANCES = f"SELECT p_partkey AS bodyId, {TYPE} AS type, concat({TYPE}, CASE p_size % 3 WHEN 0 THEN '_R' WHEN 1 THEN '_L' ELSE '' END) AS instance FROM part"
LABEL = "CASE bodyId % 6 WHEN 0 THEN 'ORN' WHEN 1 THEN 'PN' WHEN 2 THEN 'LN' WHEN 3 THEN 'KC' WHEN 4 THEN 'MBON' ELSE '' END"
HIERARCHY = (
    f"SELECT bodyId AS pt_root_id, 'cell_type' AS classification_system, instance AS cell_type FROM ({INSTANCES}) a "
    f"UNION ALL SELECT bodyId AS pt_root_id, 'cell_class' AS classification_system, {LABEL} AS cell_type FROM ({INSTANCES}) b WHERE bodyId % 6 <> 5"
)
TAGS = "SELECT p_partkey AS pt_root_id, p_brand AS tag FROM part"


COLUMNS = {
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int",
}


def load(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A statement over the tables of ``sf_dir``, read as the columns that the statements above use: no file is opened before the query runs."""
    for t, columns in COLUMNS.items():
        if re.search(rf"\b{t}\b", sql):
            spark.read.schema(columns).parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)


def raw(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The two datasets' connection tables under their published column names."""
    e = load(spark, sf_dir, EDGES)
    return {
        "hemibrain": e.where("dataset = 'hemibrain'").selectExpr("pre AS bodyId_pre", "post AS bodyId_post", "neuropil AS roi", "weight"),
        "flywire": e.where("dataset = 'flywire'").selectExpr("pre AS pre_pt_root_id", "post AS post_pt_root_id", "neuropil", "weight AS syn_count"),
    }


def annotations(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"instances": load(spark, sf_dir, INSTANCES), "hierarchy": load(spark, sf_dir, HIERARCHY), "tags": load(spark, sf_dir, TAGS)}


#: Rows of the catalog's files, by the file they go to. Names hold a line break.
CATALOG = {
    "summary": "SELECT concat('flywire/full_summary_', CAST(p_partkey % 4 AS STRING), '.csv') AS file, p_partkey AS k, concat(p_name, chr(10), p_brand) AS LN_type, CASE WHEN p_size % 2 = 0 THEN 'left' ELSE 'right' END AS hemisphere FROM part WHERE p_partkey % 3 = 0",
    "aliases": "SELECT concat('flywire/flywire_ln_aliases_', CAST(p_partkey % 4 AS STRING), '.csv') AS file, p_partkey AS k, p_partkey AS bodyId, concat(p_name, chr(10), p_brand) AS comparison_name FROM part WHERE p_partkey % 3 = 1",
    "comparison": "SELECT concat('comparison/shared_type_comparison_', CAST(p_partkey % 4 AS STRING), '.csv') AS file, p_partkey AS k, concat(p_name, chr(10), p_brand) AS comparison_name FROM part WHERE p_partkey % 3 = 2",
    "inputs": "SELECT concat('hemibrain/ln_orn_by_glomerulus/lns_[x', CAST(l_suppkey % 8 AS STRING), '].csv') AS file, l_partkey AS k, concat('x', CAST(l_suppkey % 8 AS STRING)) AS LN_instance, l_suppkey % 8 AS LN_bodyid, concat('DM', CAST(l_partkey % 3 AS STRING)) AS glomerulus, "
    "CAST(l_quantity AS BIGINT) AS n_inputs, l_linenumber AS n_ipsi_inputs, CAST(l_quantity AS BIGINT) - l_linenumber AS n_contra_inputs FROM lineitem",
}


#: How files are written: quotes doubled, white space as it is.
CSV = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def shared(spark: SparkSession, name: str) -> str:
    """A new path below the session's shared folder, or its warehouse where none is set."""
    return f"{(spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def through_csv(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a statement, written as CSV files and read again as an import reads them."""
    path = shared(spark, "csv")
    load(spark, sf_dir, sql).write.options(**CSV).csv(path)
    return csv_split.read_csv(spark, path)


#: About so many rows are sorted by one task.
TASK_ROWS = 1_000_000


def _copied(folder: str, header: bytes):
    """Parts of files, in order, to one file each, under a name of its own for each attempt, in steps of 1 MiB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, parts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                made = store.joined(folder, f"{uuid.uuid4().hex}.csv")
                where, path = store.native(made)
                where.create_dir(path.rpartition("/")[0], recursive=True)
                with where.open_output_stream(path) as out:
                    out.write(header)
                    for part in parts:
                        source, name = store.native(part)
                        with source.open_input_stream(name) as f:
                            while step := f.read(1 << 20):
                                out.write(step)
                yield pa.RecordBatch.from_pydict({"file": [file], "path": [made]})

    return run


def _write_files(spark: SparkSession, rows: DataFrame, root: str, name: str) -> None:
    """Rows as one CSV file for each ``file`` below ``root``, in order of ``k`` and then of all else.

    Tasks sort and write ranges of about TASK_ROWS rows, however many a file
    has; one task a file then copies its ranges' parts one after the other.
    """
    part = f"{root}/.{name}"
    order = ["file", "k", *[c for c in rows.columns if c not in ("file", "k")]]
    dealt = rows.repartitionByRange(rows.count() // TASK_ROWS + 1, *order).sortWithinPartitions(*order).drop("k")
    dealt.write.partitionBy("file").options(**CSV | {"header": "false"}).csv(f"{part}/parts")
    found = defaultdict(list)
    for path in store.files(spark, f"{part}/parts", ".csv"):
        file, number = re.search(r"/file=([^/]*)/part-(\d+)", path).groups()
        found[unquote(file)].append((int(number), path))
    if found:
        parts = pa.table({"file": list(found), "parts": [[path for _, path in sorted(x)] for x in found.values()]})
        header = ",".join(c for c in dealt.columns if c != "file") + "\n"
        for file, path in spark.createDataFrame(parts).mapInArrow(_copied(f"{part}/whole", header.encode()), "file string, path string").collect():
            store.move(spark, path, f"{root}/{file}")
    store.delete(spark, part)


def catalog(spark: SparkSession, sf_dir: str, *names: str) -> Catalog:
    """A catalog of CSV files that Spark writes from the tables (those of CATALOG called ``names``, or all), below the session's shared folder or its warehouse."""
    root = shared(spark, "catalog")
    for name in names or CATALOG:
        _write_files(spark, load(spark, sf_dir, CATALOG[name]), root, name)
    write_manifest(spark, root)
    return Catalog(spark, root)
