"""Scratch tables that cut lineage in shared storage, so a lost executor never moves a row or a boundary."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folder: str | None = None
_written: list[str] = []


def scratch_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only for a local master that names none."""
    global _local_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="sondeo-")
        atexit.register(shutil.rmtree, _local_folder, ignore_errors=True)
    return _local_folder


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the scratch folder and return a frame over the written files.

    Readers keep column pruning and filter pushdown, which a row checkpoint would lose.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in time for ``release``."""
    return len(_written)


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the scratch tables this process wrote after ``since``, a ``mark()``, or all of them.

    Frames over them can no longer be read. Take a mark before a run and release it after, and the tables of other runs
    in the same process stay.
    """
    jvm = spark.sparkContext._jvm
    while len(_written) > since:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
