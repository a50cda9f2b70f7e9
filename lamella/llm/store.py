"""Durable intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: (setting, Spark's default, ours): whole texts go to Python, several copies of a batch at a time, so batches are bounded by bytes.
_BATCHES = (("spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "64MB"), "4MB"), ("spark.sql.execution.arrow.maxRecordsPerBatch", ("10000",), "4000"))
#: Shuffle files go as soon as the query that made them has ended, not when the driver next collects its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bounded(spark: SparkSession) -> SparkSession:
    """The session with Arrow batches of a few megabytes, unless the user has set another size. Every operator asks for it first."""
    for name, default, ours in _BATCHES:
        if spark.conf.get(name, default[0]) in default:
            spark.conf.set(name, ours)
    return spark


@contextmanager
def _cleaning(spark: SparkSession):
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, local mode gets a temporary one; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lamella-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Store:
    """Tables of one operator run. Each is written once as Parquet and read again, so a lost executor costs no lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = bounded(spark)
        self.root = f"{shared_dir(spark)}/lamella-{name}-{uuid.uuid4().hex}"
        self._n = 0

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}-{name}"
        with _cleaning(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lamella_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in tables:
            path = getattr(df, "_lamella_path", None)
            if path:
                jvm = self.spark.sparkContext._jvm
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def parts(spark: SparkSession, floor: int = 1) -> int:
    return max(floor, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(table: DataFrame, *names: str) -> list[str]:
    """The names, each with so many underscores in front that the table has no such column, whatever the case of its letters."""
    taken, out = {c.lower() for c in table.columns}, []
    for name in names:
        name = f"_{name}"
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out
