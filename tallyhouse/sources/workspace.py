"""Scratch locations for jobs that write tables or checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: dict[str, str] = {}
_made: list[str] = []
_tables: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``.

    A machine-local folder is used only in local mode and only when the
    setting is absent; on a cluster its absence is an error, because a task
    that moves to another executor could not see the files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    if "root" not in _local_root:
        _local_root["root"] = tempfile.mkdtemp(prefix="tallyhouse-")
    return _local_root["root"]


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared root; never reused, so never cleared."""
    _made.append(f"{shared_root(spark)}/tallyhouse/{label}-{uuid.uuid4().hex}")
    return _made[-1]


def made() -> list[str]:
    """Folders given out by this process and not released."""
    return list(_made)


def release(spark: SparkSession, folders: list[str]) -> None:
    """Delete scratch folders that no DataFrame in use reads any more."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if folder in _tables:
            spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(folder)}")
    gone = set(folders)
    _made[:] = [f for f in _made if f not in gone]


def save_bucketed(df: DataFrame, label: str, n: int, column: str) -> DataFrame:
    """Write ``df`` to the shared folder as a table in ``n`` buckets of ``column``, so that joins and groupings on it
    move no rows. ``release`` takes its name out of the catalogue, too."""
    folder, name = new_folder(df.sparkSession, label), f"{label}_{uuid.uuid4().hex}"
    _tables[folder] = name
    df.write.bucketBy(n, column).option("path", folder).saveAsTable(name)
    return df.sparkSession.table(name)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    For results that several branches of a job use: they survive the loss of
    executors and give the optimizer real sizes.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
