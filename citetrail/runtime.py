"""Session-level services: shared scratch tables, size-checked joins, table loading."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which the smaller side of a join is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000

_written: dict[str, SparkSession] = {}
_shipped: set[str] = set()


#: Rows per Arrow batch sent to Python: pages, documents and long vectors keep a batch at some MB.
ARROW_ROWS = 1_000


def ship(spark: SparkSession) -> None:
    """Give the package to Python workers, once per application, unless they find it by PYTHONPATH or the working directory."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    found = {os.path.abspath(p) for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)) if p}
    app = spark.sparkContext.applicationId
    if root in found or app in _shipped:
        return
    _shipped.add(app)
    base = os.path.join(tempfile.mkdtemp(prefix="citetrail-"), "citetrail")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, os.path.basename(os.path.dirname(os.path.abspath(__file__)))))


def load(spark: SparkSession, directory: str, table: str) -> DataFrame:
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # the default
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{directory}/{table}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary folder only where it is unset (tests, one machine)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="citetrail-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, removed when the process ends."""
    path = f"{scratch_root(spark).rstrip('/')}/citetrail-{os.getpid()}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def materialise(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors, keeps columns prunable.

    A filter on the column `by`, of few values, then reads only its folders.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


class Growing:
    """A table that grows by parts, each written once, and is read in one scan however many there are; filters on `by` read only its folders."""

    def __init__(self, first: DataFrame, by: str | None = None) -> None:
        self.spark, self.schema, self.parts, self.by = first.sparkSession, first.schema, 0, by
        self.base = scratch_path(self.spark)
        self.add(first)

    def add(self, df: DataFrame) -> DataFrame:
        """Write a part; returns it as read back."""
        path = f"{self.base}/part_no={self.parts}"
        self.parts += 1
        (df.write.partitionBy(self.by) if self.by else df.write).parquet(path)
        return self._scan(path)

    def read(self) -> DataFrame:
        return self._scan(*(f"{self.base}/part_no={i}" for i in range(self.parts)))

    def _scan(self, *paths: str) -> DataFrame:
        return self.spark.read.schema(self.schema).option("basePath", self.base).parquet(*paths).select(*self.schema.fieldNames())


def drop(df: DataFrame | None) -> None:
    """Remove what `materialise` wrote for this frame, once nothing reads it any more."""
    path = getattr(df, "_scratch_path", None)
    if path and path in _written:
        _delete(_written.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit
        pass


@atexit.register
def drop_all() -> None:
    """Remove all scratch tables of this process: at its end, and in a long session when no result made so far is read any more."""
    for path, spark in list(_written.items()):
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)
    _written.clear()


def join_sized(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with `right`, a materialised frame: broadcast when its counted rows are at most `limit`, else shuffle (AQE splits skewed keys)."""
    n = right.count() if rows is None else rows
    return left.join(F.broadcast(right) if n <= limit else right.hint("merge"), on, how)


def node_key(col: str):
    """A reference id as compared: without surrounding white space (Unicode spaces included), in lower case."""
    return F.lower(F.regexp_replace(F.col(col), r"(?U)^[\s\u200b\ufeff]+|[\s\u200b\ufeff]+$", ""))
