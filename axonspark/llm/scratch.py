"""Tables written to the folder that the whole cluster shares.

Operators that need a result more than once, or that iterate, write it here and
read it back: the written table cuts the lineage and survives the loss of any
executor. The folder is the one named in ``spark.checkpoint.dir``; only where
that is unset (a test session) is a local one chosen.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="axonspark-"))
        found = _local[0]
    return found.rstrip("/")


def whole_texts(spark: SparkSession) -> None:
    """Sizes Arrow batches for rows that hold whole texts: 1,000 rows, unless the session has chosen otherwise."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


class Scratch:
    """A set of written tables that belong to one run of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        whole_texts(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        self.kept: list[DataFrame] = []

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` once and return the table as read back."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.kept.append(out)
        return out

    def mark(self) -> int:
        """The number of tables written so far, for ``sweep``."""
        return len(self.kept)

    def sweep(self, mark: int, *but: DataFrame) -> None:
        """Delete the tables written since ``mark``, except ``but``."""
        self.drop(*[t for t in self.kept[mark:] if not any(t is b for b in but)])
        self.kept[mark:] = but

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
            fs.delete(path, True)
