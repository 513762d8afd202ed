"""Sessions, and sending this package to executors that don't have it installed."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SENT = "_surveymend_sent"


def local_session(name: str = "surveymend", cpus: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", os.environ.get("SURVEYMEND_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.warehouse.dir", os.path.join(tempfile.gettempdir(), "surveymend-warehouse"))
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Serve this package to Python workers through Spark's own file server, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, _SENT, False):
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp()).resolve() / "surveymend_code.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path(root.name) / f.relative_to(root))
    sc.addPyFile(str(to))
    setattr(sc, _SENT, True)


def tasks(spark: SparkSession) -> int:
    """Partitions for work in Python that takes long for few bytes, which Spark would else put together by their bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder of a new name that driver and executors share: under ``spark.checkpoint.dir``, or the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a folder in whatever file system it is in."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a checkpoint in the shared folder, which outlives a lost executor.

    The folder is that of ``spark.checkpoint.dir``; only where that is unset (tests) one beside the warehouse is used.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint(eager=True)
