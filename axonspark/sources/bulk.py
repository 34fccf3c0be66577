"""Bulk releases: their registry, archives, and imports into tables."""

from __future__ import annotations

import os
import shutil
import tarfile
import zipfile
from dataclasses import astuple, dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from axonspark.operators.edges import identifier
from axonspark.sources import csv_split
from axonspark.sources.arrow_ipc import read_arrow


@dataclass(frozen=True)
class Release:
    dataset: str
    kind: str
    format: str
    filename: str
    table_name: str
    description: str
    url: str


# The public releases.
RELEASES = (
    Release("flywire", "proofread-connections", "feather", "proofread_connections_783.feather", "flywire_proofread_connections", "FlyWire proofread neuron-neuron connections by neuropil.", "https://zenodo.org/records/10676866/files/proofread_connections_783.feather?download=1"),
    Release("flywire", "synapses", "feather", "flywire_synapses_783.feather", "flywire_synapses", "FlyWire all released synapses with NT probabilities.", "https://zenodo.org/records/10676866/files/flywire_synapses_783.feather?download=1"),
    Release("flywire", "pre-neuropil-counts", "feather", "per_neuron_neuropil_count_pre_783.feather", "flywire_pre_neuropil_counts", "FlyWire presynapse counts per neuron and neuropil.", "https://zenodo.org/records/10676866/files/per_neuron_neuropil_count_pre_783.feather?download=1"),
    Release("flywire", "post-neuropil-counts", "feather", "per_neuron_neuropil_count_post_783.feather", "flywire_post_neuropil_counts", "FlyWire postsynapse counts per neuron and neuropil.", "https://zenodo.org/records/10676866/files/per_neuron_neuropil_count_post_783.feather?download=1"),
    Release("hemibrain", "compact-adjacencies", "tar.gz", "exported-traced-adjacencies-v1.2.tar.gz", "hemibrain_traced_roi_connections", "Hemibrain v1.2 compact traced neuron adjacency CSV bundle.", "https://storage.googleapis.com/hemibrain/v1.2/exported-traced-adjacencies-v1.2.tar.gz"),
    Release("hemibrain", "neo4j-inputs", "zip", "hemibrain_v1.2_neo4j_inputs.zip", "hemibrain_neo4j_inputs", "Hemibrain v1.2 neuPrint Neo4j import CSV bundle.", "https://storage.googleapis.com/hemibrain-release/neuprint/hemibrain_v1.2_neo4j_inputs.zip"),
)


def releases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([astuple(r) for r in RELEASES], ", ".join(f"{f.name} string" for f in fields(Release))).orderBy("dataset", "kind")


def release(dataset: str, kind: str) -> Release:
    for r in RELEASES:
        if (r.dataset, r.kind) == (dataset, kind):
            return r
    raise ValueError(f"no release {dataset}/{kind}; there are: " + ", ".join(f"{r.dataset}/{r.kind}" for r in RELEASES))


def download(dataset: str, kind: str, folder: str, force: bool = False) -> str:
    """Fetches a release (by way of a .part file) with a JSON note beside it; an existing file stays unless forced."""
    import json
    import urllib.request

    r = release(dataset, kind)
    path = os.path.join(folder, r.filename)
    if os.path.exists(path) and not force:
        return path
    os.makedirs(folder, exist_ok=True)
    with urllib.request.urlopen(r.url) as src, open(path + ".part", "wb") as dst:  # noqa: S310
        shutil.copyfileobj(src, dst, 1 << 20)
    os.replace(path + ".part", path)
    with open(path + ".json", "w", encoding="utf-8") as f:
        json.dump({x.name: getattr(r, x.name) for x in fields(r)}, f, indent=2)
    return path


def archive_stem(path: str) -> str:
    name = os.path.basename(path)
    for suffix in (".tar.gz", ".tgz"):
        if name.endswith(suffix):
            return name.removesuffix(suffix)
    return os.path.splitext(name)[0]


def extract(path: str, folder: str, force: bool = False) -> list[str]:
    """The CSV members of a zip or tar.gz, flattened to their base names; an existing file stays unless forced, and is listed all the same."""
    if path.endswith(".zip"):
        box = zipfile.ZipFile(path)
        members = [(n, lambda n=n: box.open(n)) for n in box.namelist()]
    elif path.endswith((".tar.gz", ".tgz")):
        box = tarfile.open(path)
        members = [(m.name, lambda m=m: box.extractfile(m)) for m in box.getmembers() if m.isfile()]
    else:
        raise ValueError(f"not an archive that can be read: {path}")
    os.makedirs(folder, exist_ok=True)
    out = []
    with box:
        for name, opened in members:
            if not name.endswith(".csv"):
                continue
            target = os.path.join(folder, os.path.basename(name))
            if force or not os.path.exists(target):
                with opened() as src, open(target, "wb") as dst:
                    shutil.copyfileobj(src, dst, 1 << 20)
            out.append(target)
    return out


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV, Parquet or Feather file. Fields of a CSV may hold line breaks in quotes; without ``schema`` its whole numbers become long, so that ids keep all digits."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix == ".csv":
        return csv_split.read_csv(spark, path, schema)
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix in (".feather", ".arrow"):
        return read_arrow(spark, path)
    raise ValueError(f"can't import {path}")


def load(spark: SparkSession, path: str, table: str, replace: bool = False, schema: str | None = None) -> tuple[str, int]:
    """Imports a file as a managed table; without ``replace`` an existing one is an error. Returns (table, rows)."""
    table = identifier(table)
    read(spark, path, schema).write.mode("overwrite" if replace else "errorifexists").format("parquet").saveAsTable(table)
    return table, spark.table(table).count()


def tables(spark: SparkSession) -> list[tuple[str, int]]:
    """Every table and view with its row count, by name."""
    return [(t.name, spark.table(t.name).count()) for t in sorted(spark.catalog.listTables(), key=lambda t: t.name)]


# Type names as the schema listing prints them.
TYPE_NAMES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "date": "DATE"}


def columns(df: DataFrame) -> list[tuple[str, str, str]]:
    """(column, type, nullable) of a table."""
    return [(f.name, TYPE_NAMES.get(f.dataType.simpleString(), f.dataType.simpleString().upper()), "YES" if f.nullable else "NO") for f in df.schema]
