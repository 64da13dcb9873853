from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions.vocab import BREAKDOWN_ORDER, RAW_COLUMNS
from tallyhouse.operators import stats
from tallyhouse.plans import source_queries  # noqa: F401
from tallyhouse.plans.registry import QUERIES
from tallyhouse.sources import listings as src
from tallyhouse.sources import pages as pg
from tallyhouse.sources import sinks
from tallyhouse.sources.listings import scan_latest_run
from tallyhouse.sources.workspace import new_folder
from tallyhouse.streaming.ingest import ingest, read_new_files


def test_pages_stop_at_the_first_gap(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 3), ("a", 3, 0), ("a", 4, 2), ("b", 2, 1), ("c", 1, 1), ("c", 3, 9)],
                               "category string, page_num int, n_rows int")
    got = pg.until_first_gap(df).select("category", "page_num").collect()
    assert sorted(map(tuple, got)) == [("a", 1), ("a", 2), ("c", 1)]


def test_quota_counts_what_came_before(spark):
    df = spark.createDataFrame([(i, "abcd"[i // 10]) for i in range(40)], "row_id int, category string")
    assert {r["category"]: r["before"] for r in pg.quota_groups(df, "row_id", 21).collect()} == {"a": 0, "b": 10, "c": 20}
    assert pg.apply_quota(df, "row_id", 20).count() == 20


def test_listing_fallbacks(spark):
    html = ('<div data-asin="A1"><a class="a-link-normal" href="/dp/A1" aria-label="Label"></a>'
            '<span class="a-offscreen">$5</span></div><div data-asin=""><span>x</span></div>'
            '<div data-asin="A1"><span class="p13n-sc-price">$9</span></div>'
            '<div data-asin="A2"><span><div class="c">Name</div></span><i class="a-icon a-icon-prime"></i></div>')
    df = spark.createDataFrame([(1, "c", "t", html)], "page_no int, category string, scraped_at string, html string")
    got = {r["product_id"]: r for r in pg.extract_listings(df).collect()}
    assert set(got) == {"A1", "A2"}
    assert (got["A1"]["product_name"], got["A1"]["discounted_price"], got["A1"]["is_prime"]) == ("Label", "$5", "No")
    assert got["A1"]["product_link"].endswith(".com/dp/A1") and got["A2"]["product_link"].endswith("/dp/A2")
    assert (got["A2"]["product_name"], got["A2"]["rating"], got["A2"]["is_prime"]) == ("Name", "", "Yes")


def test_csv_round_trip_with_quotes_and_newlines(spark):
    row = {c: c for c in RAW_COLUMNS} | {"product_name": 'a "b", c\nd', "category": "Clothing, Shoes & Jewelry"}
    df = spark.createDataFrame([row]).withColumn("extra", F.lit(1))
    path = new_folder(spark, "test-csv")
    sinks.write_csv_projected(df, path)
    back = src.scan_raw(spark, path)
    assert back.columns == RAW_COLUMNS and back.first().asDict() == row


def test_nested_json_is_cut_into_blocks(spark):
    df = spark.range(25).select(F.col("id").alias("row_id"), F.lit("hot").alias("category"), F.col("id").cast("string").alias("asin"))
    path = new_folder(spark, "test-nested")
    sinks.write_nested_json(df, path, block=10)
    got = spark.read.json(path).orderBy("block").collect()
    assert [len(r["products"]) for r in got] == [10, 10, 5]
    assert [p["asin"] for r in got for p in r["products"]] == [str(i) for i in range(25)]


def test_archive_and_delete(spark):
    df = spark.createDataFrame([("20260101_000000", 1), ("20260120_000000", 2), ("20260130_000000", 3)], "run_id string, x int")
    active, archive = new_folder(spark, "test-active"), new_folder(spark, "test-archive")
    df.write.partitionBy("run_id").parquet(active)
    sinks.archive_runs(spark, active, archive, datetime.date(2026, 1, 28), delete_days=30)
    read = spark.read.schema("x int, run_id string")
    assert [r["x"] for r in read.parquet(active).collect()] == [3]
    assert sorted(r["x"] for r in read.parquet(archive).collect()) == [1, 2]
    sinks.archive_runs(spark, active, archive, datetime.date(2026, 2, 5), delete_days=30)
    assert sorted(r["x"] for r in read.parquet(archive).collect()) == [2]
    df.where("x = 2").write.partitionBy("run_id").mode("append").parquet(active)
    with pytest.raises(FileExistsError):
        sinks.archive_runs(spark, active, archive, datetime.date(2026, 2, 5))
    with pytest.raises(FileNotFoundError):
        scan_latest_run(spark, new_folder(spark, "none").rsplit("/", 1)[0], "x int", "no_such_column")


def test_failed_stage_is_recorded(spark):
    path = new_folder(spark, "test-metrics")
    log = sinks.RunLog(spark, path, "r1")
    rows = spark.range(5)
    log.record("extract", rows, lambda df: df.write.format("noop").mode("overwrite").save())

    def fail(df):
        raise RuntimeError("disk full")

    with pytest.raises(RuntimeError):
        log.record("load", rows, fail)
    got = {r["stage"]: (r["status"], r["n_rows"], r["error"]) for r in spark.read.parquet(path).collect()}
    assert got == {"extract": ("success", 5, None), "load": ("failed", None, "disk full")}
    rates = {r["stage"]: r["success_rate"] for r in sinks.run_history(spark.read.parquet(path)).collect()}
    assert rates == {"extract": 100.0, "load": 0.0}


def test_poor_quality_stops_the_run(spark):
    from tallyhouse.plans.run import run_once

    rows = [{c: "" for c in RAW_COLUMNS} | {"product_id": f"p{i}", "product_name": "n" if i else "", "category": "c",
            "discounted_price": "$5", "rating": "4.5"} for i in range(4)]
    raw = spark.createDataFrame(rows).withColumn("row_id", F.substring("product_id", 2, 9).cast("long"))
    stock = spark.createDataFrame(
        [(f"p{i}", "Perth", 5, 9, 40.0, "2026-01-05") for i in range(4)],
        "asin string, warehouse_location string, stock_quantity int, minimum_stock_threshold int, daily_sales_avg double, restock_date string"
    ).withColumn("restock_date", F.to_date("restock_date"))
    base = new_folder(spark, "test-run")
    with pytest.raises(ValueError, match="75.0 % is below 90"):
        run_once(spark, raw, stock, base, "20260101_000000", "2026-01-01 00:00:00", min_quality=90)
    run_once(spark, raw, stock, base, "20260102_000000", "2026-01-02 00:00:00", min_quality=70)
    got = [(r["run_id"][:8], r["stage"], r["status"]) for r in spark.read.parquet(f"{base}/metrics").collect()]
    assert sorted(got) == [("20260101", "extract", "success"), ("20260101", "quality", "failed"),
                           ("20260102", "extract", "success"), ("20260102", "load", "success"),
                           ("20260102", "quality", "success"), ("20260102", "transform", "success")]
    final = spark.read.parquet(f"{base}/runs/20260102_000000/ai").orderBy("asin").first()
    assert final["similar_price_alternatives"] == "p1|p2|p3" and "LOW STOCK" in final["product_description"]


def test_csv_outputs(spark):
    df = spark.createDataFrame(
        [(1, "a", 5, 9, 4.7, 40.0, 3, 'x "y"')],
        "row_id int, asin string, stock_quantity int, minimum_stock_threshold int, rating double, daily_sales_avg double, "
        "days_until_restock int, product_description string")
    paths = sinks.write_outputs(df, new_folder(spark, "test-outputs"), fmt="csv")
    for name, path in paths.items():
        back = spark.read.options(header=True, escape='"').csv(path)
        assert back.count() == 1 and ("product_description" in back.columns) == (name == "ai")


def test_missing_sites_count_zero_and_null_groups_drop(spark):
    df = spark.createDataFrame([("a", "Perth", None, None), (None, "Perth", 1, 2)],
                               "category string, warehouse_location string, stock_quantity int, asin int")
    got = {r["warehouse_location"]: r["item_count"] for r in stats.location_breakdown(df, BREAKDOWN_ORDER).collect()}
    assert got == {"Sydney": 0, "Melbourne": 0, "Brisbane": 0, "Perth": 2, "Total": 2}
    summed = stats.keyed(df, "category").groupBy("category").agg(stats.total("stock_quantity").alias("s")).collect()
    assert [tuple(r) for r in summed] == [("a", 0)]


def test_ingest_picks_up_only_new_files(spark):
    landing, target, state = (new_folder(spark, n) for n in ("test-landing", "test-target", "test-state"))
    archive = new_folder(spark, "test-consumed")

    def land(price):
        row = {c: c for c in RAW_COLUMNS} | {"product_id": price, "discounted_price": price, "rating": "4.5 of 5", "review_count": ""}
        sinks_df = spark.createDataFrame([row, row | {"product_id": price + "x", "discounted_price": ""}]).select(*RAW_COLUMNS)
        sinks_df.coalesce(1).write.mode("append").option("header", True).csv(landing)

    for price in ("$10", "$30"):
        land(price)
        ingest(read_new_files(spark, landing, archive), target, state).awaitTermination()
    got = sorted((r["batch"], r["asin"], r["price"]) for r in spark.read.parquet(target).collect())
    assert got == [(0, "$10", 10.0), (0, "$10x", 10.0), (1, "$30", 30.0), (1, "$30x", 30.0)]


def test_index_count_reads_what_was_built(spark, monkeypatch):
    built, counted = [], []
    rebuild, count = sinks.rebuild_index, sinks.index_count
    monkeypatch.setattr(sinks, "rebuild_index", lambda df, path: built.append((path, rebuild(df, path))) or built[-1][1])
    monkeypatch.setattr(sinks, "index_count", lambda s, path: counted.append(path) or count(s, path))
    got = QUERIES["index_count"](spark, "/root/testdata/sf0.001").first()["n_vectors"]
    assert [(path, got) for path in counted] == built
