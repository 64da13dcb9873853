"""Text rendering of products."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate_name(c: Column, width: int = 48, always_mark: bool = False) -> Column:
    """First ``width`` characters; ``...`` marks a cut (or always)."""
    head = F.substring(c, 1, width)
    if always_mark:
        return F.concat(head, F.lit("..."))
    return F.when(F.length(c) > width, F.concat(head, F.lit("..."))).otherwise(c)


def money(c: Column, missing: str = "N/A") -> Column:
    return F.when(c.isNotNull(), F.format_string("$%.2f", c)).otherwise(missing)


def known(name: str) -> Column:
    """A column as text; an unknown value is ``nan``."""
    return F.coalesce(F.col(name).cast("string"), F.lit("nan"))


def product_description() -> Column:
    """One sentence on a product; unknown parts do not blank the rest."""
    low = F.col("stock_quantity") < F.col("minimum_stock_threshold")
    return F.concat(
        known("product_name"), F.lit(" in "), known("category"), F.lit(" category. Priced at "),
        money(F.col("price"), "$nan"), F.lit(" with "), known("rating"),
        F.lit("/5 rating. Stock: "), known("stock_quantity"), F.lit(" units at "),
        known("warehouse_location"), F.lit(". "),
        F.when(low, F.concat(F.lit("⚠️ LOW STOCK - Restock scheduled for "), known("restock_date"), F.lit(". "))).otherwise(""),
    )


def document_content() -> Column:
    """Labelled lines; a line whose condition fails is NULL and drops out."""
    def line(label: str, *parts: Column | str) -> Column:
        cells = [p if isinstance(p, Column) else F.lit(p) for p in parts]
        return F.concat(F.lit(label), *cells)

    low = F.col("stock_quantity") < F.col("minimum_stock_threshold")
    similar, better = F.col("similar_price_alternatives"), F.col("higher_rated_alternatives")
    return F.concat_ws(
        "\n",
        line("Product: ", known("product_name")),
        line("ASIN: ", known("asin")),
        line("Category: ", known("category")),
        line("Price: ", money(F.col("price"), "Not available")),
        F.when(F.col("rating").isNotNull(), line(
            "Rating: ", F.col("rating").cast("string"), "/5 stars (",
            F.format_string("%.0f", F.col("review_count").cast("double")), " reviews)",
        )).otherwise("Rating: Not available"),
        line("Stock: ", known("stock_quantity"), " units in ", known("warehouse_location"), " warehouse"),
        line("Satisfaction: ", known("satisfaction_level")),
        line("Minimum Stock Threshold: ", known("minimum_stock_threshold")),
        F.when(low, line("⚠️ LOW STOCK ALERT: Below minimum threshold of ",
                         known("minimum_stock_threshold"))),
        F.when(low, line("Restock Date: ", known("restock_date"))),
        F.when(similar != "", line("Similar Price Alternatives (ASINs): ", similar)),
        F.when(better != "", line("Higher Rated Alternatives (ASINs): ", better)),
    )


def list_row(position: Column) -> Column:
    rating = F.when(F.col("rating").isNotNull(), F.format_string("%.1f", F.col("rating"))).otherwise("N/A")
    return F.concat(
        position.cast("string"), F.lit(". "), truncate_name(known("product_name")), F.lit(" | "),
        money(F.col("price")), F.lit(" | Stock:"), known("stock_quantity"),
        F.lit(" | "), rating,
    )
