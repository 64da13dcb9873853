from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions import cleaning as cl
from tallyhouse.functions import inventory as inv
from tallyhouse.operators import cleaning as ops
from tallyhouse.operators.enrichment import split_predicates


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_price(spark):
    given = ["$1,299.50", "$10.00 - $20.00", "", None, "7"]
    assert column(spark, given, cl.clean_price) == [1299.5, None, None, None, 7.0]


def test_rating(spark):
    given = ["4.5 out of 5 stars", "4.5.1", "...", "x", None]
    assert column(spark, given, cl.clean_rating) == [4.5, None, None, None, None]


def test_reviews(spark):
    assert column(spark, ["12,345", "", "n/a"], cl.clean_reviews) == [12345.0, None, None]


def test_levels(spark):
    ratings = [0.0, 0.1, 4.0, 4.3, 4.6, 5.0, 5.2, None]
    want = [None, "Poor", "Poor", "Average", "Good", "Excellent", None, None]
    assert column(spark, ratings, inv.satisfaction_level, "double") == want
    assert column(spark, [3.9, 4.0, None], inv.complaint_risk, "double") == ["High", "Low", "Low"]


def test_days_until(spark):
    row = spark.sql("SELECT date '2026-12-09' AS d, timestamp '2026-12-01 13:00:00' AS now")
    assert row.select(inv.days_until(F.col("d"), F.col("now"))).first()[0] == 7


def test_median_counts_repeats(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (9.0,), (None,)], "price double")
    assert ops.exact_median(df, "price").first()[0] == 1.0
    even = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "price double")
    assert ops.exact_median(even, "price").first()[0] == 3.0
    assert sorted(r[0] for r in ops.fill_median(df).collect()) == [1.0, 1.0, 1.0, 1.0, 9.0]


def test_dedupe_one_hot_key(spark):
    df = spark.range(5000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(
        F.col("id").cast("string")).alias("asin"))
    first = {r["asin"]: r["row_id"] for r in ops.dedupe(df).collect()}
    last = {r["asin"]: r["row_id"] for r in ops.dedupe(df, keep="last").collect()}
    assert first["hot"] == 1 and last["hot"] == 4999 and len(first) == len(last) == 1 + 1667


def test_required_gate(spark):
    df = spark.createDataFrame([("a", 1.0)], "asin string, price double")
    assert ops.require_fields(df, ["asin", "price"]).count() == 1
    with pytest.raises(Exception, match="required fields missing: price"):
        ops.require_fields(df.withColumn("price", F.lit(None).cast("double")), ["asin", "price"]).collect()


def test_quality_bands(spark):
    assert column(spark, [100.0, 90.0, 89.9, 79.9, 69.9], ops.quality_band, "double") == [
        "Excellent", "Excellent", "Good", "Fair", "Poor"]


def test_splits_with_unknown_values(spark):
    df = spark.createDataFrame(
        [(5, 10, 4.0, 1.0, 20), (50, 10, 4.6, 31.0, 7), (50, 10, None, None, None)],
        "stock_quantity int, minimum_stock_threshold int, rating double, daily_sales_avg double, days_until_restock int")
    flags = df.select(*[p.alias(n) for n, p in split_predicates().items()]).collect()
    assert [tuple(r) for r in flags] == [
        (True, False, False, False), (False, True, True, False), (False, False, False, True)]
