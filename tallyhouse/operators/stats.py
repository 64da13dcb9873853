"""Aggregates: dashboards, summaries, breakdowns.

All of them combine per task before the shuffle, so a category holding most of
the rows costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(c: str | Column) -> Column:
    """Sum as an integer; a group of NULLs sums to 0."""
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def mean(column: str, digits: int = 2) -> Column:
    return F.round(F.avg(column), digits)


def mean_price() -> Column:
    """Average over integer cents, so that the sum is exact in any order."""
    return F.round(F.sum("price_cents") / (100 * F.count("price_cents")), 2)


def exact_rating() -> Column:
    """Ratings as decimals, so that their sum is the same in any order."""
    return F.col("rating").cast("decimal(18,6)")


def exact_mean(total: Column, n: Column) -> Column:
    """Mean of decimals as a ratio of two whole numbers, so that a half is not lost before rounding."""
    return (total * 1_000_000).cast("double") / (n * 1_000_000)


def mean_rating(digits: int = 2) -> Column:
    return F.round(exact_mean(F.sum(exact_rating()), F.count("rating")), digits)


def low_stock_rows() -> Column:
    return F.count_if(F.col("stock_quantity") < F.col("minimum_stock_threshold"))


def keyed(df: DataFrame, key: str) -> DataFrame:
    """Group only rows whose key is known."""
    return df.where(F.col(key).isNotNull())


def category_summary(df: DataFrame) -> DataFrame:
    return keyed(df, "category").groupBy("category").agg(
        F.count("asin").alias("total_products"),
        mean_price().alias("avg_price"),
        mean_rating().alias("avg_rating"),
        total("stock_quantity").alias("total_stock"),
        F.round(F.coalesce(F.sum("daily_sales_avg"), F.lit(0.0)), 2).alias("daily_sales"),
    )


def warehouse_summary(df: DataFrame) -> DataFrame:
    return keyed(df, "warehouse_location").groupBy("warehouse_location").agg(
        F.count("asin").alias("asin"), total("stock_quantity").alias("stock_quantity"),
    )


def category_stats(df: DataFrame) -> DataFrame:
    return keyed(df, "category").groupBy("category").agg(
        F.count("asin").alias("asin"), mean_rating().alias("rating"),
        mean_price().alias("price"), total("stock_quantity").alias("stock_quantity"),
    )


def global_stats(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("total_products"), total("stock_quantity").alias("total_stock"),
        low_stock_rows().alias("low_stock_count"),
        mean_rating().alias("avg_rating"), mean_price().alias("avg_price"),
    )


def dashboard_stats(df: DataFrame) -> DataFrame:
    """Category, warehouse and overall figures in one scan.

    Rows are first combined per (category, warehouse); the three groupings
    then work on that small table, so the scan is not expanded threefold.
    """
    cells = df.groupBy("category", "warehouse_location").agg(
        F.count("*").alias("n"), F.count("asin").alias("n_asin"),
        F.sum("stock_quantity").alias("stock"), low_stock_rows().alias("low"),
        F.sum(exact_rating()).alias("ratings"), F.count("rating").alias("n_rating"),
        F.sum("price_cents").alias("cents"), F.count("price_cents").alias("n_price"),
    )
    sets = [[F.col("category")], [F.col("warehouse_location")], []]
    grouped = cells.groupingSets(sets, "category", "warehouse_location").agg(
        F.grouping_id().alias("gid"),
        F.sum("n").alias("n_rows"), F.sum("n_asin").alias("n_asin"),
        F.coalesce(F.sum("stock"), F.lit(0)).alias("total_stock"),
        F.sum("low").alias("low_stock_count"),
        F.round(exact_mean(F.sum("ratings"), F.sum("n_rating")), 2).alias("avg_rating"),
        F.round(F.sum("cents") / (100 * F.sum("n_price")), 2).alias("avg_price"),
    )
    scope = F.when(F.col("gid") == 1, "category").when(F.col("gid") == 2, "warehouse").otherwise("all")
    key = F.coalesce(F.col("category"), F.col("warehouse_location"))
    known = (F.col("gid") == 3) | key.isNotNull()
    return grouped.where(known).select(
        scope.alias("scope"), key.alias("key"), "n_rows", "total_stock", "low_stock_count",
        "avg_rating", "avg_price",
    )


def sales_summary(df: DataFrame, *by: str) -> DataFrame:
    """Sales figures of a filtered catalogue (optionally per group)."""
    price, sales = F.coalesce("price", F.lit(0.0)), F.coalesce("daily_sales_avg", F.lit(0.0))
    return df.groupBy(*by).agg(
        F.count("*").alias("total_products"),
        total("stock_quantity").alias("total_stock"),
        F.round(F.sum(sales), 2).alias("total_daily_sales"),
        F.round(F.sum(price * sales), 2).alias("total_daily_revenue"),
        mean_price().alias("avg_price"), mean_rating().alias("avg_rating"),
        mean("stock_quantity").alias("avg_stock"),
        low_stock_rows().alias("low_stock_count"),
    )


def average_stats(df: DataFrame) -> DataFrame:
    """Averages per category and, with a NULL category, over everything."""
    return keyed(df, "category").rollup("category").agg(
        mean_rating().alias("avg_rating"), mean_price().alias("avg_price"),
        mean("stock_quantity").alias("avg_stock"),
        F.count("*").alias("total_products"), total("stock_quantity").alias("total_stock"),
    )


def distinct_categories(df: DataFrame) -> DataFrame:
    """Categories with the first row each appears in."""
    return keyed(df, "category").groupBy("category").agg(F.min("row_id").alias("first_row"))


def location_breakdown(df: DataFrame, locations: list[str]) -> DataFrame:
    """Count per named site, zero where a site has no rows, plus a total."""
    listed = df.where(F.col("warehouse_location").isin(locations))
    return zero_filled(listed.groupBy("warehouse_location").agg(F.count("*").alias("item_count")), locations)


def zero_filled(counts: DataFrame, locations: list[str]) -> DataFrame:
    spark = counts.sparkSession
    sites = spark.createDataFrame([(s,) for s in locations], "warehouse_location string")
    filled = sites.join(counts, "warehouse_location", "left").select(
        "warehouse_location", F.coalesce("item_count", F.lit(0)).alias("item_count"))
    return filled.rollup("warehouse_location").agg(F.sum("item_count").alias("item_count")).select(
        F.coalesce("warehouse_location", F.lit("Total")).alias("warehouse_location"), "item_count")
