"""Session settings for local runs and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cores: str = "8", name: str = "accesslens") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cores.replace("*", "8"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir``, or else the checkpoint folder set on the
    context, names storage every executor can reach.  Where neither is set, a
    local folder takes its place if the session runs in one process; on a
    cluster it would not be shared, and that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to storage that all executors reach")
        base = tempfile.mkdtemp(prefix="accesslens-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def staging(spark: SparkSession, purpose: str) -> Iterator[str]:
    """A shared folder for a staged table, removed once the work succeeded.

    After a failure the folder stays: nothing reads it again, and what was
    staged can be looked at.
    """
    folder = shared_folder(spark, purpose)
    yield folder
    remove_folder(spark, folder)


def _file_system(spark: SparkSession, path: str) -> tuple:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def remove_folder(spark: SparkSession, folder: str) -> None:
    files, target = _file_system(spark, folder)
    files.delete(target, True)


def replace_folder(spark: SparkSession, source: str, target: str) -> None:
    """Move a folder to ``target`` in place of what is there.

    One that dies in between leaves the source, and is completed by calling it
    again; a source that is gone has been moved."""
    files, moved = _file_system(spark, source)
    _, place = _file_system(spark, target)
    if files.exists(moved):
        files.delete(place, True)
        files.mkdirs(place.getParent())
        if not files.rename(moved, place):
            raise RuntimeError(f"could not move {source} to {target}")


def set_modified(spark: SparkSession, folder: str, seconds: int) -> None:
    """Date the files in ``folder``; storage that keeps its own times is an error."""
    files, target = _file_system(spark, folder)
    for item in files.listStatus(target):
        files.setTimes(item.getPath(), seconds * 1000, -1)
        if files.getFileStatus(item.getPath()).getModificationTime() != seconds * 1000:
            raise RuntimeError(f"the storage of {folder} does not take times of files")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for what is run inside."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


#: Our own marker: Spark's depends on a committer setting.
COMPLETE = "_complete"


def mark_complete(spark: SparkSession, folder: str) -> None:
    """Note that the write into ``folder`` has returned without an error."""
    files, marker = _file_system(spark, f"{folder}/{COMPLETE}")
    files.create(marker, True).close()


def is_complete(spark: SparkSession, folder: str) -> bool:
    """True when a write into ``folder`` was marked complete."""
    files, marker = _file_system(spark, f"{folder}/{COMPLETE}")
    return files.exists(marker)


def child_folders(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folders in ``folder``; none where it does not exist."""
    files, target = _file_system(spark, folder)
    if not files.exists(target):
        return []
    return sorted(item.getPath().getName() for item in files.listStatus(target) if item.isDirectory())
