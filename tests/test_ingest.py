"""De-duplication across micro-batches."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from tallyhouse.functions.vocab import RAW_COLUMNS
from tallyhouse.plans import load_all
from tallyhouse.plans.registry import QUERIES
from tallyhouse.sources.workspace import new_folder
from tallyhouse.streaming.ingest import Seen, ingest, read_new_files


def listing(spark, rows):
    """Raw rows of (id, price, scraped_at)."""
    df = spark.createDataFrame(rows, "product_id string, discounted_price string, scraped_at string")
    given = {c: F.col(c) if c in df.columns else F.lit({"product_name": "n", "category": "c", "rating": "4.5"}.get(c, "")) for c in RAW_COLUMNS}
    return df.select(*(x.alias(c) for c, x in given.items()))


def run(spark, landing, target, state):
    ingest(read_new_files(spark, landing, max_files=1), target, state).awaitTermination()
    return sorted((r.asin, r.price, r.scraped_at) for r in spark.read.parquet(target).collect())


def put(spark, landing, rows):
    listing(spark, rows).coalesce(1).write.mode("append").option("header", True).csv(landing)


def test_a_product_that_comes_again_is_kept_once(spark):
    landing, target, state = (new_folder(spark, x) for x in ("again", "again-out", "again-state"))
    put(spark, landing, [("a", "$1", "2026-01-02"), ("b", "$2", "2026-01-01"), ("a", "$3", "2026-01-01")])
    put(spark, landing, [("a", "$9", "2025-01-01"), ("c", "$4", "2026-01-03")])
    want = [("a", 3.0, "2026-01-01"), ("b", 2.0, "2026-01-01"), ("c", 4.0, "2026-01-03")]
    assert run(spark, landing, target, state) == want
    put(spark, landing, [("c", "$8", "2026-01-04"), ("d", "", "2026-01-04"), ("b", "$6", "2026-01-04")])
    assert run(spark, landing, target, state) == [*want, ("d", 7.0, "2026-01-04")]  # the median of its own batch


def test_a_repeated_batch_finds_what_it_found(spark):
    seen = Seen(spark, new_folder(spark, "replay"), "asin", 4)
    rows = [spark.createDataFrame([(x,) for x in ids], "asin string") for ids in ("ab", "bcd")]

    def left(batch):
        return sorted(r.asin for r in seen.unseen(rows[batch], batch).collect())

    assert left(0) == ["a", "b"]
    seen.add(rows[0], 0)
    assert left(0) == ["a", "b"] and left(1) == ["c", "d"]
    seen.add(rows[0], 0)  # written again after a failure
    seen.add(rows[1], 1)
    assert left(0) == ["a", "b"] and left(1) == ["c", "d"]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a long history
    try:
        assert "Bucketed: true" in seen.unseen(rows[1], 1)._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


@pytest.fixture
def tables(spark):
    """Few products, sales, events and turns."""
    root = new_folder(spark, "stream-tables")
    parts = [(k, f"name {k}", "SMALL TIN", 1 + k % 50, Decimal(100 + k)) for k in range(1, 201)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_size int, p_retailprice decimal(15,2)").write.parquet(f"{root}/part.parquet")
    sold = spark.range(600).select((F.col("id") % 200 + 1).alias("l_partkey"), F.lit(2.0).alias("l_quantity"), F.lit("2001-01-02").cast("date").alias("l_shipdate"))
    sold.write.parquet(f"{root}/lineitem.parquet")
    turns = spark.range(60).select((F.col("id") % 10).alias("conv_id"), F.floor(F.col("id") / 10).cast("int").alias("turn"), F.lit("user").alias("role"), F.lit("show me rings").alias("text"))
    turns.write.parquet(f"{root}/conversations.parquet")
    seconds = F.lit("2001-01-02 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") * 600)
    events = spark.range(300).select(F.col("id").alias("event_id"), seconds.alias("ts"), (F.col("id") % 3).alias("user_id"), (F.col("id") % 90).cast("double").alias("value"))
    events.write.parquet(f"{root}/events.parquet")
    return root


@pytest.mark.parametrize(("name", "rows"), [("stream_raw_ingest", 200), ("stream_context", 120), ("stream_activity_segments", None)])
def test_what_a_stream_reads_is_not_written_by_one_task(spark, tables, monkeypatch, name, rows):
    load_all()

    def alone(self, n):
        raise AssertionError(f"everything in {n} task")

    monkeypatch.setattr(DataFrame, "coalesce", alone)
    found = QUERIES[name](spark, tables)
    n = found.count()
    assert rows is None or n == rows
