"""Readers for raw listing files, run-partitioned tables and the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from tallyhouse.schemas import RAW

CSV = {"header": True, "multiLine": True, "escape": '"'}


def scan_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw listings, all text; the schema is fixed, so nothing is inferred."""
    return spark.read.schema(RAW).options(**CSV).csv(path)


def scan_latest_run(spark: SparkSession, path: str, schema: str, column: str = "run_id") -> DataFrame:
    """Rows of the newest run of a table partitioned by run.

    Run ids sort by time. Only the folder names are listed; the files of older
    runs are neither opened nor read.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    entries = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    names = [e.getPath().getName() for e in entries]
    newest = max((n for n in names if n.startswith(f"{column}=")), default=None)
    if newest is None:
        raise FileNotFoundError(f"no folder {column}=... in {path}")
    return spark.read.schema(schema).option("basePath", path).parquet(f"{path}/{newest}")


def scan_catalog(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The serving table; only the named columns are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df
