"""Registered queries: readers, writers, retention and run metrics."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.functions.vocab import DELETE_AFTER_DAYS, MIN_QUALITY, RAW_COLUMNS
from tallyhouse.operators import enrichment as enrich
from tallyhouse.operators.retrieval import chunk_documents
from tallyhouse.plans.cleaning_queries import DAYS_SQL, TYPED_SQL, with_days
from tallyhouse.plans.registry import query
from tallyhouse.plans.retrieval_queries import full_catalog
from tallyhouse.plans.run import run_once
from tallyhouse.plans.stats_queries import SUMMARY_SQL, WAREHOUSE_SQL
from tallyhouse.plans.views import RUN_TS, catalog, view
from tallyhouse.functions.render import product_description
from tallyhouse.sources import listings as src
from tallyhouse.sources import sinks
from tallyhouse.sources.tables import table
from tallyhouse.sources.workspace import new_folder

_NULLED = ", ".join(f"nullif({c}, '') AS {c}" for c in RAW_COLUMNS)


def _raw_csv(spark: SparkSession, root: str) -> str:
    path = new_folder(spark, "raw-csv")
    sinks.write_csv_projected(view(spark, root, "raw_listings"), path)
    return path


@query("scan_raw", f"SELECT {_NULLED} FROM raw_listings")
def _(spark, root):
    return src.scan_raw(spark, _raw_csv(spark, root))


@query("write_csv_projected", f"SELECT {_NULLED} FROM raw_listings")
def _(spark, root):
    return src.scan_raw(spark, _raw_csv(spark, root))


def _runs(spark: SparkSession, root: str) -> str:
    """Run-partitioned table."""
    path = new_folder(spark, "runs")
    view(spark, root, "listing_runs").write.partitionBy("run_id").parquet(path)
    return path


@query("scan_latest_run", "SELECT * FROM listing_runs WHERE run_id = (SELECT max(run_id) FROM listing_runs)")
def _(spark, root):
    return src.scan_latest_run(spark, _runs(spark, root), "listing_id long, price_cents long, run_id string")


@query("scan_catalog", "SELECT row_id, asin, product_name, category, price, stock_quantity FROM catalog")
def _(spark, root):
    path = new_folder(spark, "catalog")
    catalog(spark, root).write.parquet(path)
    return src.scan_catalog(spark, path, ["row_id", "asin", "product_name", "category", "price", "stock_quantity"])


@query("write_nested_json", """
SELECT category, cast(floor(row_id / 1000) AS bigint) AS block, count(*) AS n_products,
  string_agg(asin, ',' ORDER BY row_id) AS asins FROM products GROUP BY 1, 2""")
def _(spark, root):
    path = new_folder(spark, "nested")
    sinks.write_nested_json(view(spark, root, "products").select("row_id", "category", "asin", "product_name", "price"), path)
    entry = T.ArrayType(T.StructType([T.StructField("asin", T.StringType())]))
    schema = T.StructType([T.StructField("category", T.StringType()), T.StructField("block", T.LongType()),
                           T.StructField("products", entry)])
    rows = spark.read.schema(schema).json(path)
    asins = F.transform("products", lambda p: p["asin"])
    return rows.select("category", "block", F.size("products").cast("long").alias("n_products"), F.concat_ws(",", asins).alias("asins"))


def _final(spark: SparkSession, root: str) -> DataFrame:
    return with_days(full_catalog(spark, root)).withColumn("product_description", product_description())


@query("write_outputs", f"""
WITH f AS (SELECT row_id, stock_quantity < minimum_stock_threshold AS low,
    coalesce(rating >= 4.6 AND daily_sales_avg > 30, false) AS high, {DAYS_SQL} <= 7 AS soon FROM catalog)
SELECT 'final' AS output, row_id FROM f UNION ALL SELECT 'ai', row_id FROM f UNION ALL SELECT 'alternatives', row_id FROM f
UNION ALL SELECT 'low_stock', row_id FROM f WHERE low UNION ALL SELECT 'high_performers', row_id FROM f WHERE high
UNION ALL SELECT 'restock_queue', row_id FROM f WHERE soon""")
def _(spark, root):
    paths = sinks.write_outputs(_final(spark, root), new_folder(spark, "outputs"))
    read = [spark.read.parquet(p).select(F.lit(n).alias("output"), "row_id") for n, p in paths.items()]
    out = read[0]
    for other in read[1:]:
        out = out.unionByName(other)
    return out


@query("write_dashboard", f"""
SELECT 'category' AS part, category AS key, total_products AS n, total_stock AS stock FROM ({SUMMARY_SQL}) c
UNION ALL SELECT 'warehouse', warehouse_location, asin, stock_quantity FROM ({WAREHOUSE_SQL}) w""")
def _(spark, root):
    paths = sinks.write_dashboard(catalog(spark, root), new_folder(spark, "dashboard"))
    categories = spark.read.schema(
        "category string, total_products long, avg_price double, avg_rating double, total_stock long, daily_sales double"
    ).option("header", True).csv(paths["dashboard_summary"])
    sites = spark.read.schema("warehouse_location string, asin long, stock_quantity long").option("header", True).csv(
        paths["warehouse_summary"])
    return categories.select(
        F.lit("category").alias("part"), F.col("category").alias("key"), F.col("total_products").alias("n"),
        F.col("total_stock").alias("stock")).unionByName(sites.select(
            F.lit("warehouse").alias("part"), F.col("warehouse_location").alias("key"), F.col("asin").alias("n"),
            F.col("stock_quantity").alias("stock")))


_CHUNKS = "SELECT sum(greatest(cast(ceil((length(text) - 100) / 900.0) AS bigint), 1)) AS n FROM documents WHERE length(text) > 0"


def _index(spark: SparkSession, root: str) -> tuple[str, int]:
    path = new_folder(spark, "index")
    docs = table(spark, root, "documents").select("doc_id", "text", "source")
    sinks.rebuild_index(docs.select("doc_id", F.lit(0).alias("chunk_no"), F.col("text").alias("chunk")), path)
    return path, sinks.rebuild_index(chunk_documents(docs, "doc_id", "text"), path)


@query("rebuild_index", f"""
SELECT doc_id, greatest(cast(ceil((length(text) - 100) / 900.0) AS bigint), 1) AS n_chunks, cast((SELECT n FROM ({_CHUNKS}) c) AS bigint) AS n_written
FROM documents WHERE length(text) > 0""")
def _(spark, root):
    path, written = _index(spark, root)
    return spark.read.parquet(path).groupBy("doc_id").agg(
        F.count("*").alias("n_chunks"), F.lit(written).cast("long").alias("n_written"))


@query("index_count", "SELECT count(*) AS n_vectors FROM embeddings")
def _(spark, root):
    path = new_folder(spark, "index")
    sinks.rebuild_index(table(spark, root, "embeddings"), path)
    return sinks.index_count(spark, path)


@query("retention_archive", """
SELECT CASE WHEN run_id < '20011124' THEN 'archive' ELSE 'active' END AS place, run_id, count(*) AS n_rows,
  cast(sum(price_cents) AS bigint) AS cents FROM listing_runs GROUP BY 1, 2""")
def _(spark, root):
    active, archive = _runs(spark, root), new_folder(spark, "runs-archive")
    today = datetime.datetime.fromisoformat(RUN_TS).date()
    sinks.archive_runs(spark, active, archive, today, delete_days=DELETE_AFTER_DAYS)
    schema = "listing_id long, price_cents long, run_id string"
    parts = [spark.read.schema(schema).parquet(p).withColumn("place", F.lit(n))
             for n, p in (("active", active), ("archive", archive))]
    return parts[0].unionByName(parts[1]).groupBy("place", "run_id").agg(
        F.count("*").alias("n_rows"), F.sum("price_cents").cast("long").alias("cents"))


def _stock(spark: SparkSession, root: str) -> DataFrame:
    return catalog(spark, root).select(
        "asin", "warehouse_location", "stock_quantity", "minimum_stock_threshold", "daily_sales_avg",
        F.col("last_sold_date").cast("string").alias("last_sold_date"), "restock_date")


@query("run_metrics", f"""
WITH {TYPED_SQL}, score AS (SELECT round(100 * avg(CASE WHEN trim(asin) <> '' AND trim(product_name) <> '' AND trim(category) <> ''
    AND price BETWEEN 0.01 AND 10000 AND rating BETWEEN 0 AND 5 THEN 1 ELSE 0 END), 2) AS q, count(*) AS n FROM typed)
SELECT '20011201_130000' AS run_id, 'extract' AS stage, n AS n_rows, 'success' AS status, NULL AS quality_score FROM score
UNION ALL SELECT '20011201_130000', 'quality', n, 'success', q FROM score
UNION ALL SELECT '20011201_130000', 'transform', (SELECT count(DISTINCT product_id) FROM raw_listings), 'success', NULL
UNION ALL SELECT '20011201_130000', 'load', (SELECT count(DISTINCT product_id) FROM raw_listings), 'success', NULL""")
def _(spark, root):
    base = new_folder(spark, "run")
    path = run_once(spark, view(spark, root, "raw_listings"), _stock(spark, root), base, "20011201_130000", RUN_TS)
    return spark.read.parquet(path).select("run_id", "stage", "n_rows", "status", "quality_score")


# Three runs over thirds of the listings, at the usual gate. The second scrape lost two names of three.
HISTORY = ["20011201_130000", "20011202_130000", "20011203_130000"]
_LOST = "row_id % 3 = 1 AND row_id % 9 <> 1"


@query("run_history", f"""
WITH {TYPED_SQL}, t AS (SELECT *, row_id % 3 AS run, CASE WHEN {_LOST} THEN '' ELSE product_name END AS name FROM typed),
score AS (SELECT run, round(100 * avg(CASE WHEN trim(asin) <> '' AND trim(name) <> '' AND trim(category) <> ''
    AND price BETWEEN 0.01 AND 10000 AND rating BETWEEN 0 AND 5 THEN 1 ELSE 0 END), 2) AS q, count(*) AS n, count(DISTINCT asin) AS ids
  FROM t GROUP BY run),
passed AS (SELECT * FROM score WHERE q >= {MIN_QUALITY})
SELECT 'extract' AS stage, count(*) AS n_runs, 100.0e0 AS success_rate, cast(sum(n) AS bigint) AS n_rows, cast(NULL AS double) AS quality_score FROM score
UNION ALL SELECT 'quality', count(*), round(100.0e0 * avg(CASE WHEN q >= {MIN_QUALITY} THEN 1 ELSE 0 END), 2),
  cast(sum(n) FILTER (WHERE q >= {MIN_QUALITY}) AS bigint), round(avg(q) FILTER (WHERE q >= {MIN_QUALITY}), 2) FROM score
UNION ALL SELECT 'transform', count(*), 100.0e0, cast(sum(ids) AS bigint), NULL FROM passed
UNION ALL SELECT 'load', count(*), 100.0e0, cast(sum(ids) AS bigint), NULL FROM passed""")
def _(spark, root):
    base, stock = new_folder(spark, "history"), _stock(spark, root)
    name = F.when(F.expr(_LOST), "").otherwise(F.col("product_name"))
    rows = view(spark, root, "raw_listings").withColumn("product_name", name)
    for part, run_id in enumerate(HISTORY):
        try:
            run_once(spark, rows.where(F.col("row_id") % 3 == part), stock, base, run_id, RUN_TS)
        except ValueError:  # the gate; the run is in the metrics as failed
            pass
    return sinks.run_history(spark.read.parquet(f"{base}/metrics"))
