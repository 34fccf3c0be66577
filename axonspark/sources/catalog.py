"""The catalog of published tables: a manifest, name resolution and scans.

The manifest is metadata (a row a file) and lives on the driver; table contents
are only ever DataFrames.
"""

from __future__ import annotations

import csv
import hashlib
import io
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axonspark.sources import csv_split, store

MANIFEST = ("dataset", "collection", "file_id", "relative_path", "rows", "columns", "size_bytes", "sha256")
ENVIRONMENT = "AXONSPARK_DATA_DIR"
MOST_TASKS = 10_000


@dataclass(frozen=True)
class Table:
    dataset: str
    collection: str
    file_id: str
    relative_path: str
    rows: int
    columns: tuple[str, ...]
    size_bytes: int
    sha256: str

    @property
    def stem(self) -> str:
        return self.relative_path.removesuffix(".csv")


def default_dir() -> str:
    """The configured data directory, else ``data`` below the working directory."""
    return os.path.realpath(os.path.expanduser(os.environ.get(ENVIRONMENT) or "data"))


#: What comes before the path in a URI.
BEFORE_PATH = "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def rooted(root: str) -> str:
    """A folder as readers get it: URIs as they are, others as real local paths."""
    return root.rstrip("/") if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", root) else os.path.realpath(os.path.expanduser(root))


def relative(path: Column, root: str) -> Column:
    """The part of a (decoded) path below ``root``."""
    return F.substring(F.regexp_replace(path, BEFORE_PATH, ""), len(re.sub(BEFORE_PATH, "", rooted(root))) + 2, 1 << 20)


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def file_id(relative_path: str) -> str:
    """Everything but letters and digits to single underscores, lower case."""
    return re.sub(r"_+", "_", re.sub(r"[^0-9A-Za-z]", "_", relative_path.removesuffix(".csv"))).strip("_").lower()


def read_csv(spark: SparkSession, root: str, names: list[str], columns: list[str], split: bool = False) -> DataFrame:
    """All cells as text of files below ``root`` that share one header; ``_file`` is the relative path, ``_ordinal`` the order inside a file.

    The reader gets the wanted paths alone, with the signs that would match
    other names escaped, so that no other file is opened; null cells are empty.
    ``split`` reads a file by many tasks, also where quoted fields hold line
    breaks; else a file is a task.
    """
    root = rooted(root)
    paths = [re.sub(r"([\[\]{}*?\\])", r"\\\1", store.joined(root, n)) for n in names]
    if split:
        got = csv_split.read_text(spark, paths, columns).withColumnsRenamed({"file": "_path", "number": "_ordinal"})
    else:
        df = spark.read.schema(text_schema(columns)).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", True)
        got = df.csv(paths).select(F.col("_metadata.file_path").alias("_path"), F.monotonically_increasing_id().alias("_ordinal"), "*")
    decoded = F.try_url_decode(F.regexp_replace("_path", r"\+", "%2B"))
    below = relative(decoded, root)
    file = F.lit(names[0]) if len(names) == 1 else below
    return got.select(file.alias("_file"), "_ordinal", *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns])


def range_bytes(spark: SparkSession) -> int:
    """Files of more bytes are split."""
    text = spark.conf.get("spark.sql.files.maxPartitionBytes")
    return int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text))


class Catalog:
    """The tables of a data directory."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, rooted(root or default_dir())
        path = store.joined(self.root, "manifest.csv")
        text = store.read_text(spark, path)
        if text is None:
            raise FileNotFoundError(path)
        self.entries = [Table(**{**r, "rows": int(r["rows"]), "size_bytes": int(r["size_bytes"]), "columns": tuple(c for c in r["columns"].split("|") if c)}) for r in csv.DictReader(io.StringIO(text, newline=""))]

    def frame(self) -> DataFrame:
        """The manifest as a DataFrame."""
        schema = "dataset string, collection string, file_id string, relative_path string, rows long, columns array<string>, size_bytes long, sha256 string"
        return self.spark.createDataFrame([(t.dataset, t.collection, t.file_id, t.relative_path, t.rows, list(t.columns), t.size_bytes, t.sha256) for t in self.entries], schema)

    def datasets(self) -> DataFrame:
        return self.frame().groupBy("dataset").agg(F.count("*").alias("tables")).orderBy("dataset")

    def tables(self, dataset: str | None = None, contains: str | None = None) -> list[Table]:
        needle = (contains or "").lower()
        return [t for t in self.entries if (dataset is None or t.dataset == dataset) and needle in f"{t.file_id} {t.relative_path} {t.collection}".lower()]

    def resolve(self, ref: str) -> Table:
        """The one table called ``ref``: its id, path, dataset:path or dataset:collection/stem, or, with a dataset before the first colon, the end of its path."""
        want = ref.removesuffix(".csv")
        dataset, colon, tail = want.partition(":")

        def names(t: Table) -> tuple[str, ...]:
            return t.file_id, t.stem, f"{t.dataset}:{t.stem}", f"{t.dataset}:{t.collection}/{os.path.basename(t.stem)}"

        found = [t for t in self.entries if want in names(t) or (colon and dataset and dataset == t.dataset and t.stem.endswith(tail))]
        if not found:
            raise KeyError(f"no table matches {ref}")
        if len(found) > 1:
            raise ValueError(f"{ref} matches {len(found)} tables: " + ", ".join(t.file_id for t in found[:10]))
        return found[0]

    def path(self, ref: str) -> str:
        return store.joined(self.root, self.resolve(ref).relative_path)

    def schema(self, ref: str) -> list[tuple[int, str, str]]:
        t = self.resolve(ref)
        return [(k, c, t.file_id) for k, c in enumerate(t.columns, 1)]

    def open(self, *tables: Table) -> DataFrame:
        """The rows of tables, by header family, with ``table``, ``relative_path`` and the order inside the file."""
        most = range_bytes(self.spark)
        families: dict[tuple[tuple[str, ...], bool], list[Table]] = {}
        for t in tables:
            families.setdefault((t.columns, t.size_bytes > most), []).append(t)
        out = []
        for (columns, large), group in families.items():
            ids = self.spark.createDataFrame([(t.relative_path, t.file_id, t.dataset) for t in group], "_file string, _table string, _dataset string")
            df = read_csv(self.spark, self.root, [t.relative_path for t in group], list(columns), large)
            out.append(df.join(F.broadcast(ids), "_file"))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def open_csv(spark: SparkSession, path: str) -> DataFrame:
    """Any one CSV file, all cells as text, in file order."""
    path = rooted(path)
    root, _, name = path.rpartition("/")
    columns = csv_split.header(spark, re.sub(r"([\[\]{}*?\\])", r"\\\1", path))
    return read_csv(spark, root, [name], columns, store.size(spark, path) > range_bytes(spark))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each file by its path: checksum, first record and number of further ones, from steps of 1 MiB."""
    for b in batches:
        for uri in b.column(0).to_pylist():
            where, path = store.native(uri)
            sha, first, held, records, inside, blank = hashlib.sha256(), [], b"", 0, False, True
            with where.open_input_stream(path) as f:
                while True:
                    step = f.read(1 << 20)
                    sha.update(step)
                    if not step and not held:
                        break
                    *whole, held = (held + step).split(b"\n") if step else [held, b""]
                    for line in whole:
                        if b'"' in line or inside:
                            inside = csv_split.ends_inside(line.decode("utf-8", "replace"), inside)
                        blank = blank and not line.strip(b"\r")
                        if not records:
                            first.append(line.decode("utf-8", "replace"))
                        if not inside:
                            records, blank = records + (not blank), True
                    if not step:
                        break
            names = next(csv.reader(io.StringIO("\n".join(first).removeprefix("\ufeff"), newline="")), [])
            yield pa.RecordBatch.from_pylist([{"path": uri, "rows": max(records + inside - 1, 0), "columns": "|".join(names), "sha256": sha.hexdigest()}], schema=pa.schema([("path", pa.string()), ("rows", pa.int64()), ("columns", pa.string()), ("sha256", pa.string())]))


def build_manifest(spark: SparkSession, root: str) -> DataFrame:
    """One row per CSV file below ``root``: identity, header, data rows, size and checksum.

    Spark lists the files without opening them; each is then read once, as a
    stream, by the task that gets it, so that a file of any size takes a few MiB.
    There are as many tasks as files, up to MOST_TASKS.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(rooted(root)).select("path", F.col("length").alias("size_bytes"))
    files = files.withColumn("relative_path", relative(F.col("path"), root)).where("relative_path <> 'manifest.csv'")
    found = files.select("path").repartitionByRange(min(max(files.count(), 1), MOST_TASKS), "path").mapInArrow(_described, "path string, rows long, columns string, sha256 string")
    parts = F.split("relative_path", "/")
    stem = F.regexp_replace("relative_path", r"\.csv$", "")
    ident = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(stem, "[^0-9A-Za-z]", "_"), "_+", "_"), "^_|_$", ""))
    joined = files.join(found, "path")
    return joined.select(F.element_at(parts, 1).alias("dataset"), F.when(F.size(parts) > 2, F.element_at(parts, 2)).otherwise("root").alias("collection"), ident.alias("file_id"), "relative_path", "rows", "columns", "size_bytes", "sha256").orderBy("relative_path")


def write_manifest(spark: SparkSession, root: str) -> int:
    rows = build_manifest(spark, root).collect()
    out = io.StringIO(newline="")
    w = csv.writer(out)
    w.writerow(MANIFEST)
    w.writerows([[r[c] for c in MANIFEST] for r in rows])
    store.write_text(spark, store.joined(rooted(root), "manifest.csv"), out.getvalue())
    return len(rows)
