"""One catalogue run: read, check, clean, enrich, write, index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions import inventory as inv
from tallyhouse.functions import render
from tallyhouse.functions.vocab import MIN_QUALITY
from tallyhouse.operators import alternatives as alt
from tallyhouse.operators import cleaning as clean
from tallyhouse.operators import enrichment as enrich
from tallyhouse.operators.retrieval import build_documents, chunk_documents
from tallyhouse.sources import sinks
from tallyhouse.sources.workspace import materialize

FIELDS = ["asin", "product_name", "category", "price", "rating"]


def final_table(listings: DataFrame, stock: DataFrame, run_ts: str) -> DataFrame:
    """Cleaned, de-duplicated and enriched listings with their alternatives.

    ``stock`` holds the inventory columns per ``asin``.
    """
    cleaned = clean.clean_listings(listings)
    unique = clean.dedupe(cleaned, "asin", "row_id", "first")
    joined = unique.join(stock, "asin", "left")
    priced = joined.withColumn("price_cents", F.round(F.col("price") * 100).cast("long"))
    enriched = enrich.satisfaction_columns(priced).withColumn(
        "days_until_restock", inv.days_until(F.col("restock_date"), F.lit(run_ts).cast("timestamp")))
    # Both alternatives read these rows, so they are computed once.
    enriched = materialize(enriched, "enriched")
    return alt.add_alternatives(enriched).withColumn("product_description", render.product_description())


def run_once(spark: SparkSession, listings: DataFrame, stock: DataFrame, base: str, run_id: str, run_ts: str,
             min_quality: float = MIN_QUALITY) -> str:
    """Run every stage below ``base``; returns the path of the metrics table.

    A quality score below ``min_quality`` stops the run before anything but
    the raw copy is written.
    """
    log = sinks.RunLog(spark, f"{base}/metrics", run_id)
    raw_path, run_path = f"{base}/raw/run_id={run_id}", f"{base}/runs/{run_id}"
    log.record("extract", listings, lambda df: df.write.mode("overwrite").parquet(raw_path))
    raw = spark.read.parquet(raw_path)

    typed = clean.type_listings(raw)
    flags = clean.range_flags()
    valid = (F.size(clean.missing_fields(FIELDS)) == 0) & flags["price_ok"] & flags["rating_ok"]
    log.record("quality", typed.withColumn("_valid", valid),
               lambda df: df.write.mode("overwrite").format("noop").save(), min_quality=min_quality)
    log.record("transform", final_table(raw, stock, run_ts), lambda df: sinks.write_outputs(df, run_path))

    products = spark.read.parquet(f"{run_path}/ai")
    sinks.write_dashboard(products, run_path)
    chunks = chunk_documents(build_documents(products), "doc_id", "content")
    log.record("load", chunks, lambda df: sinks.rebuild_index(df, f"{base}/index"))
    return f"{base}/metrics"
