"""Raw listing files picked up as they arrive."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators.cleaning import clean_listings, dedupe
from tallyhouse.operators.enrichment import satisfaction_columns
from tallyhouse.schemas import RAW
from tallyhouse.sources.workspace import made, materialize, release


def read_new_files(spark: SparkSession, landing: str, archive: str | None = None,
                   max_files: int | None = None) -> DataFrame:
    """Stream of raw rows; consumed files move to ``archive``."""
    reader = spark.readStream.schema(RAW).option("header", True).option("multiLine", True).option("escape", '"')
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.csv(landing)


def drop_repeats(stream: DataFrame, window: str = "7 days") -> DataFrame:
    """A product that comes again within ``window`` of its scrape time is dropped.

    Ids are forgotten once the watermark has passed them, so the state does
    not grow with the history.
    """
    timed = stream.withColumn("event_time", F.try_to_timestamp("scraped_at"))
    return timed.withWatermark("event_time", window).dropDuplicatesWithinWatermark(["product_id"])


BUCKETS = 64


class Seen:
    """Ids that batches have added to a target, as a table in buckets of the id.

    A batch meets the ids of earlier batches only, so a batch that is repeated
    after a failure finds what it found before; ids it has written already are
    written again and change nothing. The table side of the join is not
    shuffled, however long the history.
    """

    def __init__(self, spark: SparkSession, target: str, key: str, buckets: int = BUCKETS) -> None:
        self.spark, self.key, self.buckets = spark, key, buckets
        self.name = f"seen_{hashlib.md5(target.encode()).hexdigest()}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (`{key}` string, batch_id bigint) USING parquet "
                  f"CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{target}_seen'")

    def unseen(self, rows: DataFrame, batch_id: int) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        earlier = self.spark.table(self.name).where(F.col("batch_id") < batch_id).select(self.key)
        return rows.join(earlier, self.key, "left_anti")

    def add(self, rows: DataFrame, batch_id: int) -> None:
        ids = rows.select(F.col(self.key).cast("string").alias(self.key), F.lit(batch_id).cast("long").alias("batch_id"))
        ids.repartition(self.buckets, self.key).write.insertInto(self.name)


def ingest(stream: DataFrame, target: str, checkpoint: str):
    """Clean and enrich each micro-batch and add it to the ``target`` table.

    A micro-batch is one run: its median fills its own gaps. A product that an
    earlier batch has brought is left out. A batch is parsed once, into a
    scratch table; it writes its own folder, so a batch repeated after a
    failure replaces itself. What was seen lies beside the target, in
    ``<target>_seen``.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen, before = Seen(spark, target, "asin"), set(made())
        rows = dedupe(clean_listings(materialize(batch, "batch")), "asin", "scraped_at", "first")
        folder = f"{target}/batch={batch_id}"
        satisfaction_columns(seen.unseen(rows, batch_id)).write.mode("overwrite").parquet(folder)
        seen.add(spark.read.parquet(folder), batch_id)
        release(spark, [f for f in made() if f not in before])

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def drain_to_parquet(stream: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """Process everything available, then read what was written."""
    query = (
        stream.writeStream.format("parquet").option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(target)
