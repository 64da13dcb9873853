"""Cleaning and validation of raw listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.cleaning import clean_price, clean_rating, clean_reviews
from tallyhouse.functions.vocab import (
    DEFAULT_RATING, DEFAULT_REVIEWS, PRICE_RANGE, RATING_RANGE, STOCK_RANGE,
)


def type_listings(raw: DataFrame) -> DataFrame:
    """Raw text columns to typed columns; unparseable values become NULL."""
    return raw.withColumns({
        "price": clean_price(F.col("discounted_price")),
        "rating": clean_rating(F.col("rating")),
        "review_count": clean_reviews(F.col("review_count")),
    }).withColumnRenamed("product_id", "asin")


def exact_median(df: DataFrame, column: str) -> DataFrame:
    """One-row median (mean of the two middle values).

    A sketch gives two values that the middle surely lies between. Moving all others to the nearer of the two keeps
    the middle; equal values are then counted in parallel, so the single final task sees a few values near it.
    """
    known = df.where(F.col(column).isNotNull())
    near = known.agg(F.percentile_approx(column, [0.499, 0.501], 10_000)).scalar()
    moved = known.select(F.least(F.greatest(F.col(column), F.get(near, 0)), F.get(near, 1)).alias(column))
    return moved.groupBy(column).agg(F.count("*").alias("n")).agg(F.expr(f"percentile({column}, 0.5D, n)").alias("median"))


def fill_median(df: DataFrame, column: str = "price") -> DataFrame:
    """NULLs to the median of the whole run, as a scalar subquery (no join)."""
    return df.withColumn(column, F.coalesce(F.col(column), exact_median(df, column).scalar()))


def fill_constants(df: DataFrame) -> DataFrame:
    return df.na.fill({"rating": DEFAULT_RATING, "review_count": float(DEFAULT_REVIEWS)})


def clean_listings(raw: DataFrame) -> DataFrame:
    return fill_constants(fill_median(type_listings(raw)))


def missing_fields(columns: list[str]) -> Column:
    """Array of the required fields that are NULL or blank."""
    flags = [F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(c)) for c in columns]
    return F.array_compact(F.array(*flags))


def in_range(column: str, bounds: tuple[float, float]) -> Column:
    """True inside the closed range; a NULL is not in range."""
    return F.coalesce(F.col(column).between(*bounds), F.lit(False))


def range_flags() -> dict[str, Column]:
    return {
        "price_ok": in_range("price", PRICE_RANGE),
        "rating_ok": in_range("rating", RATING_RANGE),
        "stock_ok": in_range("stock_quantity", STOCK_RANGE),
    }


def dedupe(df: DataFrame, key: str = "asin", order: str = "row_id", keep: str = "first") -> DataFrame:
    """One row per key, the first or last by ``order``.

    The rank filter becomes a group limit that each task applies before the
    shuffle, so a key with very many copies sends one row per task.
    """
    by = F.col(order).asc() if keep == "first" else F.col(order).desc()
    rank = F.row_number().over(Window.partitionBy(key).orderBy(by))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def quality_band(score: Column) -> Column:
    return (
        F.when(score >= 90, "Excellent").when(score >= 80, "Good")
        .when(score >= 70, "Fair").otherwise("Poor")
    )


def quality_report(df: DataFrame, required: list[str], checks: dict[str, Column]) -> DataFrame:
    """Share of rows that pass every check, with its band, in one pass."""
    complete = F.size(missing_fields(required)) == 0
    valid = complete
    for check in checks.values():
        valid = valid & check
    score = F.round(100 * F.avg(valid.cast("int")), 2)
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(~complete).alias("n_incomplete"),
        *[F.count_if(~check).alias(f"n_bad_{name.removesuffix('_ok')}") for name, check in checks.items()],
        score.alias("quality_score"),
        quality_band(score).alias("band"),
    )


def require_fields(df: DataFrame, required: list[str]) -> DataFrame:
    """Fail the job at run time when a required field is missing in any row."""
    missing = missing_fields(required)
    message = F.concat(F.lit("required fields missing: "), F.concat_ws(",", missing))
    gate = F.when(F.size(missing) > 0, F.raise_error(message).cast("boolean")).otherwise(True)
    return df.where(gate)
