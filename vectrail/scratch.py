"""Folders for tables that a job writes and reads back."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; on a local master a temporary one if unset."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="vectrail-")
    return folder.rstrip("/")


# What this process has named below the shared folder and not removed yet.
_named: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing exists there yet."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _named.append(path)
    return path


def scratch_mark() -> int:
    """A point in the order of folders, for :func:`remove_scratch`."""
    return len(_named)


def _on_its_file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def remove_folder(spark: SparkSession, path: str) -> bool:
    """Delete a folder on whatever file system it lies; whether it was there."""
    files, target = _on_its_file_system(spark, path)
    return files.delete(target, True)


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder, on whatever file system it lies."""
    files, target = _on_its_file_system(spark, path)
    return files.getContentSummary(target).getLength()


def remove_scratch(spark: SparkSession, since: int = 0) -> int:
    """Delete all folders that this process wrote for intermediate results; returns their number.

    For the end of a job, or of a part of it that began at the mark ``since``: results that were
    returned but not stored yet still need them.
    """
    removed = 0
    while len(_named) > since:
        removed += remove_folder(spark, _named.pop())
    return removed


def written(df: DataFrame, name: str) -> DataFrame:
    """Run ``df`` once and read it back from the shared folder, for results used several times."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
