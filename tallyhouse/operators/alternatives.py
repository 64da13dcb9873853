"""Similar-price and higher-rated alternatives without a self-join of rows.

Both report at most five products of the same category. Products must be
unique by ``asin`` (run the de-duplication first), carry a stable ``row_id``
and an integer ``price_cents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.ranges import blocks_covering, blocks_of
from tallyhouse.functions.vocab import (
    ALTERNATIVES_KEPT, MIN_RATING_GAP, PRICE_BAND_HIGH, PRICE_BAND_LOW,
)
from tallyhouse.sources.workspace import materialize

# Cents up to 2**24 - 1 ($167,772.15), far above the validated price ceiling.
PRICE_BITS = 2
PRICE_LEVELS = 12


def _keep_first(df: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    """First ``n`` rows per key, pruned in each task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def _ids(array: Column) -> Column:
    return F.transform(array, lambda x: x["asin"])


def with_similar(products: DataFrame, kept: int = ALTERNATIVES_KEPT) -> DataFrame:
    """Adds ``similar``: the first ``kept`` products, in row order, priced within 30 % of each product.

    Only ``kept + 1`` lowest rows per (category, price) can ever be reported,
    and likewise per block of prices, so short lists per block answer every
    band: each distinct price looks its band up as a few blocks. Rows enter
    twice only, to build the lists and to pick up their answer.
    """
    rows = products.where(F.col("category").isNotNull() & F.col("price_cents").isNotNull())
    short = kept + 1
    leaves = _keep_first(rows.select("category", "price_cents", "row_id", "asin"),
                         ["category", "price_cents"], ["row_id"], short)
    lists = _keep_first(
        leaves.select("category", "row_id", "asin",
                      F.explode(blocks_of(F.col("price_cents"), PRICE_LEVELS, PRICE_BITS)).alias("block")),
        ["category", "block"], ["row_id"], short)

    cents = F.col("price_cents")
    low = F.ceil(cents * PRICE_BAND_LOW / 10)
    high = F.floor(cents * PRICE_BAND_HIGH / 10)
    bands = (
        leaves.select("category", "price_cents").distinct()
        .withColumn("block", F.explode(blocks_covering(low, high, PRICE_LEVELS, PRICE_BITS)))
    )
    found = bands.join(lists, ["category", "block"]).select(
        "category", "price_cents", "row_id", "asin")
    answers = (
        _keep_first(found, ["category", "price_cents"], ["row_id"], short)
        .groupBy("category", "price_cents")
        .agg(F.array_sort(F.collect_list(F.struct("row_id", "asin"))).alias("near"))
    )
    others = F.slice(F.filter("near", lambda x: x["asin"] != F.col("asin")), 1, kept)
    return products.join(answers, ["category", "price_cents"], "left").withColumn(
        "similar", F.coalesce(_ids(others), F.array().cast("array<string>"))).drop("near")


def similar_price(products: DataFrame, kept: int = ALTERNATIVES_KEPT) -> DataFrame:
    """asin and ``similar`` for products with a known category and price."""
    rows = products.where(F.col("category").isNotNull() & F.col("price_cents").isNotNull())
    return with_similar(rows.select("row_id", "asin", "category", "price_cents"), kept).select("asin", "similar")


def top_rated(products: DataFrame, kept: int = ALTERNATIVES_KEPT) -> DataFrame:
    """Per category the ``kept`` best rated rows, as one sorted array."""
    rows = products.where(F.col("category").isNotNull() & F.col("rating").isNotNull())
    best = _keep_first(rows.select("category", "rating", "row_id", "asin"),
                       ["category"], [F.col("rating").desc(), "row_id"], kept)
    entry = F.struct((-F.col("rating")).alias("by"), "row_id", "asin", "rating")
    return best.groupBy("category").agg(F.array_sort(F.collect_list(entry)).alias("best"))


def with_better(products: DataFrame, kept: int = ALTERNATIVES_KEPT, gap: float = MIN_RATING_GAP) -> DataFrame:
    """Adds ``better``: the best ``kept`` products rated more than ``gap`` above each product.

    They are a prefix of the category's best list, since anything that beats
    the bar beats everything below it. The list table has one short row per
    category; it is written first, so that its true size decides whether the
    join ships it whole and leaves the products where they are.
    """
    lists = materialize(top_rated(products, kept), "top-rated")
    bar = F.col("rating") + gap
    above = F.filter("best", lambda x: (x["rating"] > bar) & (x["asin"] != F.col("asin")))
    return products.join(lists, "category", "left").withColumn(
        "better", F.coalesce(_ids(above), F.array().cast("array<string>"))).drop("best")


def higher_rated(products: DataFrame, kept: int = ALTERNATIVES_KEPT, gap: float = MIN_RATING_GAP) -> DataFrame:
    """asin and ``better``."""
    return with_better(products, kept, gap).select("asin", "better")


def add_alternatives(products: DataFrame, kept: int = ALTERNATIVES_KEPT) -> DataFrame:
    """Both lists as pipe-joined text, empty where there is none.

    The lists come to the products by category and price, so products do not meet themselves again by key.
    """
    columns = [*products.columns, "similar_price_alternatives", "higher_rated_alternatives"]
    return (
        with_better(with_similar(products, kept), kept)
        .withColumns({
            "similar_price_alternatives": F.coalesce(F.concat_ws("|", "similar"), F.lit("")),
            "higher_rated_alternatives": F.coalesce(F.concat_ws("|", "better"), F.lit("")),
        })
        .select(*columns)
    )


def join_alternatives(products: DataFrame, alternatives: DataFrame) -> DataFrame:
    """Left join on ``asin``; the right side is reduced to one row per key."""
    cols = ["similar_price_alternatives", "higher_rated_alternatives"]
    right = _keep_first(alternatives.select("asin", "row_id", *cols), ["asin"], ["row_id"], 1)
    return products.join(right.drop("row_id"), "asin", "left")
