"""Per-row inventory and satisfaction expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyhouse.functions.vocab import WAREHOUSES


def warehouse_for(row_id: Column) -> Column:
    """Round-robin site by stored row number; needs no global numbering."""
    sites = F.array(*[F.lit(w) for w in WAREHOUSES])
    return F.element_at(sites, (F.pmod(row_id, F.lit(len(WAREHOUSES))) + 1).cast("int"))


def sentiment_score(rating: Column) -> Column:
    return F.round(rating * 20, 1)


def recommendation_score(rating: Column) -> Column:
    return F.round(rating / 5 * 100, 1)


def satisfaction_level(rating: Column) -> Column:
    """Right-closed bins; 0 and anything above 5.1 have no level."""
    return (
        F.when((rating > 0) & (rating <= 4.0), "Poor")
        .when((rating > 4.0) & (rating <= 4.3), "Average")
        .when((rating > 4.3) & (rating <= 4.6), "Good")
        .when((rating > 4.6) & (rating <= 5.1), "Excellent")
    )


def complaint_risk(rating: Column) -> Column:
    return F.when(rating < 4.0, "High").otherwise("Low")


def days_until(day: Column, now: Column) -> Column:
    """Whole days from ``now`` to the midnight that starts ``day``, rounded down."""
    gap = F.unix_timestamp(day.cast("timestamp")) - F.unix_timestamp(now)
    return F.floor(gap / 86400)


def daily_revenue(price: Column, daily_sales: Column) -> Column:
    return F.coalesce(price, F.lit(0.0)) * F.coalesce(daily_sales, F.lit(0.0))


def is_low_stock(stock: Column, threshold: Column, multiplier: float = 1.0) -> Column:
    return stock < (threshold if multiplier == 1.0 else threshold * multiplier)
