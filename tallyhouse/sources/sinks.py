"""Writers."""

from __future__ import annotations

import datetime
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.vocab import ARCHIVE_AFTER_DAYS, RAW_COLUMNS
from tallyhouse.operators import stats
from tallyhouse.operators.enrichment import split_predicates
from tallyhouse.schemas import RUN_METRICS

SPLITS = ("low_stock", "high_performers", "restock_queue")


def write_csv_projected(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Fixed columns in fixed order; all others are left out."""
    df.select(*(columns or RAW_COLUMNS)).write.mode("overwrite").options(header=True, escape='"').csv(path)


def write_nested_json(df: DataFrame, path: str, group: str = "category", order: str = "row_id", block: int = 1000) -> None:
    """JSON lines ``{group, block, products: [...]}``.

    A group is written as arrays of bounded length (``order`` is unique and
    its block number is part of the key), so that no task ever holds a whole
    group.
    """
    record = F.struct(*[c for c in df.columns if c not in (group, order)])
    blocks = df.groupBy(group, F.floor(F.col(order) / block).alias("block")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), record.alias("r")))), lambda x: x["r"]).alias("products"))
    blocks.write.mode("overwrite").json(path)


def write_outputs(final: DataFrame, base: str, description: str = "product_description", fmt: str = "parquet") -> dict[str, str]:
    """The six outputs of a run.

    The full table is written first and the others read it back, so the
    enrichment and the alternatives are computed once.
    """
    spark = final.sparkSession
    paths = {n: f"{base}/{n}" for n in ("final", "ai", "alternatives", *SPLITS)}

    def save(df: DataFrame, name: str) -> None:
        options = {"header": True, "escape": '"'} if fmt == "csv" else {}
        df.write.mode("overwrite").format(fmt).options(**options).save(paths[name])

    final.write.mode("overwrite").parquet(f"{base}/_run")
    table = spark.read.parquet(f"{base}/_run")
    plain = table.drop(description)
    save(plain, "final")
    save(table, "ai")
    save(plain, "alternatives")
    tests = split_predicates()
    for name in SPLITS:
        save(plain.where(tests[name]), name)
    return paths


def write_dashboard(df: DataFrame, base: str) -> dict[str, str]:
    """Category and warehouse summaries; one row per group, so one file each."""
    paths = {"dashboard_summary": f"{base}/dashboard_summary", "warehouse_summary": f"{base}/warehouse_summary"}
    stats.category_summary(df).coalesce(1).write.mode("overwrite").option("header", True).csv(paths["dashboard_summary"])
    stats.warehouse_summary(df).coalesce(1).write.mode("overwrite").option("header", True).csv(paths["warehouse_summary"])
    return paths


def rebuild_index(chunks: DataFrame, path: str) -> int:
    """Replace the index table; the count is taken while writing."""
    seen = Observation("index")
    chunks.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    return seen.get["n"]


def index_count(spark: SparkSession, path: str) -> DataFrame:
    """Answered from file footers; no column is read."""
    return spark.read.parquet(path).agg(F.count("*").alias("n_vectors"))


# --- retention -------------------------------------------------------------

def archive_runs(spark: SparkSession, active: str, archive: str, today: datetime.date,
                 archive_days: int = ARCHIVE_AFTER_DAYS, delete_days: int | None = None) -> None:
    """Move run partitions older than ``archive_days``; drop archived ones past ``delete_days`` if that is given
    (``DELETE_AFTER_DAYS`` is the usual number). A run that is in the archive already is not moved: an error.

    Whole partition folders are renamed; no row is read. The loop runs over
    runs, of which there is one a day.
    """
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    root, target = jvm.org.apache.hadoop.fs.Path(active), jvm.org.apache.hadoop.fs.Path(archive)
    fs = root.getFileSystem(conf)
    fs.mkdirs(target)

    def runs(folder):
        for entry in fs.listStatus(folder):
            name = entry.getPath().getName()
            if name.startswith("run_id="):
                day = datetime.datetime.strptime(name[7:15], "%Y%m%d").date()
                yield entry.getPath(), name, (today - day).days

    for path, name, age in list(runs(root)):
        if age > archive_days:
            place = jvm.org.apache.hadoop.fs.Path(target, name)
            if fs.exists(place):
                raise FileExistsError(f"{place} is archived already")
            if not fs.rename(path, place):
                raise OSError(f"{path} could not be moved to {place}")
    for path, _, age in list(runs(target)):
        if delete_days is not None and age > delete_days and not fs.delete(path, True):
            raise OSError(f"{path} could not be deleted")


# --- run metrics -----------------------------------------------------------

class RunLog:
    """One metrics row per stage of a run, appended to a table."""

    def __init__(self, spark: SparkSession, path: str, run_id: str):
        self.spark, self.path, self.run_id = spark, path, run_id
        self.rows: list[tuple] = []

    def record(self, stage: str, df: DataFrame, write, min_quality: float | None = None) -> None:
        """Run ``write(df)`` and note how many rows passed, and how long it took.

        With ``min_quality`` the share of rows marked ``_valid`` is noted too,
        and a share below it fails the run.
        """
        quality = min_quality is not None
        start = time.monotonic()
        seen = Observation(stage)
        score = F.round(100 * F.avg(F.col("_valid").cast("int")), 2) if quality else F.lit(None).cast("double")
        watched = df.observe(seen, F.count(F.lit(1)).alias("n"), F.max(score).alias("q") if not quality else score.alias("q"))
        try:
            write(watched.drop("_valid") if quality else watched)
            got = seen.get
            if quality and (got["q"] or 0.0) < min_quality:
                raise ValueError(f"quality {got['q']} % is below {min_quality} %")
            self.rows.append((self.run_id, stage, got["n"], got["q"], "success", time.monotonic() - start, None))
        except Exception as error:
            self.rows.append((self.run_id, stage, None, None, "failed", time.monotonic() - start, str(error)))
            raise
        finally:
            self.flush()

    def flush(self) -> None:
        """Append the rows noted since the last call (one per stage)."""
        if self.rows:
            self.spark.createDataFrame(self.rows, RUN_METRICS).coalesce(1).write.mode("append").parquet(self.path)
            self.rows = []


def run_history(metrics: DataFrame) -> DataFrame:
    """Per stage: runs, success rate, rows and mean quality."""
    return metrics.groupBy("stage").agg(
        F.countDistinct("run_id").alias("n_runs"),
        F.round(100 * F.avg((F.col("status") == "success").cast("int")), 2).alias("success_rate"),
        F.sum("n_rows").alias("n_rows"),
        F.round(F.avg("quality_score"), 2).alias("quality_score"))
