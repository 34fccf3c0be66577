"""Files outside of tables: small ones by Spark's own file systems, large ones, in tasks, by those that Arrow knows."""

from __future__ import annotations

import re
import uuid
from urllib.parse import quote

from pyarrow import fs as pafs
from pyspark.sql import SparkSession


def native(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a path as Spark writes it (nothing in it is escaped), and the path there; an error if Arrow doesn't know the store."""
    scheme, _, rest = path.partition(":") if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path) else ("file", "", path)
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/") if rest.startswith("/") else rest
    return pafs.FileSystem.from_uri(f"{scheme}:{quote(rest)}")


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a file; None if there is none."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside the file and then takes its place in one step, so that readers see the old text or the new."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    part = f"{path}.{uuid.uuid4().hex[:8]}.part"
    fs, p = _at(spark, part)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(p), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(path)), options)


def size(spark: SparkSession, path: str) -> int:
    fs, p = _at(spark, path)
    return int(fs.getFileStatus(p).getLen())


def move(spark: SparkSession, path: str, to: str) -> None:
    """Moves a file, making the folders above its new place."""
    fs, p = _at(spark, path)
    target = spark._jvm.org.apache.hadoop.fs.Path(to)
    fs.mkdirs(target.getParent())
    if not fs.rename(p, target):
        raise OSError(f"{path} can't be moved to {to}")


def joined(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def files(spark: SparkSession, root: str, suffix: str) -> list[str]:
    """All files below ``root`` whose names end so, by path; those inside written tables aside."""
    fs, p = _at(spark, root)
    if not fs.exists(p):
        return []
    found, out = fs.listFiles(p, True), []
    while found.hasNext():
        path = found.next().getPath().toString()
        if path.endswith(suffix) and ".parquet/" not in path:
            out.append(path)
    return sorted(out)
