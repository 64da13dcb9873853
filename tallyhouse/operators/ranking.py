"""Sorts and top-k reports.

Every ordering ends with the row number, so ties keep row order. A sort
followed by a limit runs as a per-task heap, never as a full sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.render import list_row

def top_n(df: DataFrame, metric: str, n: int = 10, largest: bool = True) -> DataFrame:
    by = F.col(metric).desc_nulls_last() if largest else F.col(metric).asc_nulls_last()
    return df.orderBy(by, "row_id").limit(n)


def formatted_list(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows as numbered lines (``n`` bounds the array)."""
    head = df.orderBy(*(order or ["row_id"])).limit(n)
    keys = [c if isinstance(c, Column) else F.col(c) for c in (order or ["row_id"])]
    entries = head.select(F.struct(*LIST_COLUMNS).alias("r"), F.row_number().over(
        Window.partitionBy(F.lit(0)).orderBy(*keys)).alias("position"))
    return entries.select("position", "r.*").select("position", list_row(F.col("position")).alias("line"))


LIST_COLUMNS = ["product_name", "price", "stock_quantity", "rating"]


def top_n_per_group(df: DataFrame, group: str, metric: str, n: int) -> DataFrame:
    """First ``n`` rows per group; each task prunes to ``n`` before the shuffle."""
    order = Window.partitionBy(group).orderBy(F.col(metric).desc_nulls_last(), "row_id")
    ranked = df.where(F.col(group).isNotNull()).withColumn("position", F.row_number().over(order))
    return ranked.where(F.col("position") <= n)


# Sort specifications a question can ask for: (columns that must be known, order).
def sort_spec(name: str) -> tuple[list[str], list[Column]]:
    specs = {
        "rating_price": (["price", "rating"], [F.col("rating").desc(), F.col("price").asc()]),
        "rating": ([], [F.col("rating").desc_nulls_last()]),
        "price_asc": (["price"], [F.col("price").asc()]),
        "price_desc": (["price"], [F.col("price").desc()]),
        "sales": ([], [F.col("daily_sales_avg").desc_nulls_last()]),
        "stock": ([], [F.col("stock_quantity").desc_nulls_last()]),
    }
    return specs[name]


def sort_catalog(df: DataFrame, spec: str) -> DataFrame:
    """Full ordered output: a range-partitioned sort, one run per task."""
    required, order = sort_spec(spec)
    kept = df.na.drop(subset=required) if required else df
    return kept.orderBy(*order, "row_id")


def listed_with_rest(df: DataFrame, limit: int | None, default: int = 10) -> DataFrame:
    """First rows in row order and how many more there are."""
    shown = limit or default
    total = df.agg(F.count("*")).scalar()
    head = df.orderBy("row_id").limit(shown)
    return head.withColumn("n_more", F.greatest(total - shown, F.lit(0)) if not limit else F.lit(0).cast("long"))
