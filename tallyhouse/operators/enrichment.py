"""Operational columns added to cleaned listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import inventory as inv
from tallyhouse.functions.vocab import (
    HIGH_PERFORMER_RATING, HIGH_PERFORMER_SALES, RESTOCK_DAYS,
)


def satisfaction_columns(df: DataFrame) -> DataFrame:
    rating = F.col("rating")
    return df.withColumns({
        "sentiment_score": inv.sentiment_score(rating),
        "satisfaction_level": inv.satisfaction_level(rating),
        "recommendation_score": inv.recommendation_score(rating),
        "complaint_risk": inv.complaint_risk(rating),
    })


def sales_facts(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Per product: units, selling days, last sale, mean lead time.

    Lead time counts only lines shipped on or after their order. The fact join
    and the grouping both pre-aggregate per task before their shuffles.
    """
    ship, placed = F.to_date("l_shipdate"), F.to_date("o_orderdate")
    joined = lines.join(orders.select("o_orderkey", "o_orderdate"),
                        lines.l_orderkey == orders.o_orderkey, "left")
    lead = F.datediff(ship, placed)
    per_day = joined.groupBy("l_partkey", ship.alias("day")).agg(
        F.sum("l_quantity").cast("long").alias("units"),
        F.count("*").alias("n"),
        F.sum(F.when(lead >= 0, lead)).alias("lead_sum"),
        F.count(F.when(lead >= 0, lead)).alias("lead_n"),
    )
    return per_day.groupBy("l_partkey").agg(
        F.sum("units").alias("units"),
        F.sum("n").alias("n_sales"),
        F.count("*").alias("n_days"),
        F.max("day").alias("last_sold"),
        F.round(F.sum("lead_sum") / F.sum("lead_n"), 2).alias("lead_days"),
    )


def inventory_facts(products: DataFrame, facts: DataFrame) -> DataFrame:
    """Products with units sold, sales and lead-time columns; no sale gives zeros."""
    f = facts.withColumnRenamed("l_partkey", "row_id")
    units = F.coalesce(F.col("units"), F.lit(0))
    return products.join(f, "row_id", "left").select(
        *[F.col(c) for c in products.columns],
        units.alias("units"),
        F.coalesce(F.col("n_sales"), F.lit(0)).alias("n_sales"),
        F.round(F.coalesce(units / F.col("n_days"), F.lit(0.0)), 2).alias("daily_sales_avg"),
        F.col("last_sold").cast("string").alias("last_sold_date"),
        F.col("lead_days").alias("supplier_lead_time_days"),
    )


def split_predicates(low_stock_multiplier: float = 1.0) -> dict[str, Column]:
    """Operational splits; a row may be in several."""
    tests = {
        "low_stock": inv.is_low_stock(
            F.col("stock_quantity"), F.col("minimum_stock_threshold"), low_stock_multiplier),
        "high_performers": (F.col("rating") >= HIGH_PERFORMER_RATING)
        & (F.col("daily_sales_avg") > HIGH_PERFORMER_SALES),
        "restock_queue": F.col("days_until_restock") <= RESTOCK_DAYS,
    }
    tests = {name: F.coalesce(test, F.lit(False)) for name, test in tests.items()}
    in_none = ~(tests["low_stock"] | tests["high_performers"] | tests["restock_queue"])
    return {**tests, "active_inventory": in_none}


def tag_splits(df: DataFrame) -> DataFrame:
    """One scan: each row repeated once per split it belongs to."""
    tags = F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in split_predicates().items()]))
    return df.withColumn("split", F.explode(tags))
