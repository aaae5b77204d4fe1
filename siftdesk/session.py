"""Session settings and the shared folder for written intermediate results."""

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_local_dirs: dict[str, str] = {}


def get_session(app_name: str = "siftdesk", **conf: str) -> SparkSession:
    """A session with the settings the library is written for."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it gets a fresh folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="siftdesk-")
    return _local_dirs[app]


def work_dir(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def pinned(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` computed once and read back from the shared folder.

    For frames that must not be computed a second time with another outcome:
    slice numbers taken from sampled range bounds, and replies of a scorer.
    With ``folder`` it lies below that one, for the caller to remove.
    """
    spark = df.sparkSession
    path = work_dir(spark, "pinned") if folder is None else os.path.join(folder, uuid.uuid4().hex)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _hadoop_path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    store, found = _hadoop_path(spark, path)
    return store.exists(found)


def is_folder(spark: SparkSession, path: str) -> bool:
    store, found = _hadoop_path(spark, path)
    return store.exists(found) and store.getFileStatus(found).isDirectory()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that a job made for itself, in whatever store it lies."""
    store, found = _hadoop_path(spark, path)
    store.delete(found, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Give a folder its final name, in one step where the store renames in one."""
    store, found = _hadoop_path(spark, path)
    if not store.rename(found, _hadoop_path(spark, to)[1]):
        raise OSError(f"{path} could not be moved to {to}")


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    store, found = _hadoop_path(spark, path)
    if not store.exists(found):
        return []
    return [entry.getPath().getName() for entry in store.listStatus(found)]


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether the job that wrote the folder has been committed."""
    return exists(spark, f"{path}/_SUCCESS")


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for as long as the block runs."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
