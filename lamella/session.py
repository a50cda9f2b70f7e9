"""Making this package importable on executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once for each application, unless their Python path has it already."""
    package = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    if app in _shipped or str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = Path(tempfile.mkdtemp(prefix="lamella-")) / "lamella_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


#: Rows that a task sorts or gathers by key at once, as far as keys can be parted.
TASK_ROWS = 500_000


def dealt(df: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """df by its keys in as many tasks as the number of `rows` (what df is made of, cheap to count) asks for: a sort's memory does not grow with the table."""
    n, usual = rows.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(min(usual, 1 + 50 * n // TASK_ROWS), 1 + n // TASK_ROWS), *keys)


def kept(df: DataFrame) -> DataFrame:
    """df written once in the folder that the cluster shares, and read again: the plan ends there.

    The folder is that of ``spark.checkpoint.dir``; where it is unset, local mode gets a temporary one and a cluster must name one.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lamella-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/lamella-rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
