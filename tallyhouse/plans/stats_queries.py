"""Registered queries: aggregates, breakdowns, top-k and sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhouse.functions import inventory as inv
from tallyhouse.functions.render import truncate_name
from tallyhouse.functions.vocab import BREAKDOWN_ORDER
from tallyhouse.operators import ranking, stats
from tallyhouse.plans.registry import query
from tallyhouse.plans.views import catalog, view

RATING = "round(cast(sum(cast(rating AS decimal(18, 6))) * 1000000 AS double) / (1000000 * count(rating)), 2)"
PRICE = "round(sum(price_cents) / (100 * count(price_cents)), 2)"
STOCK = "cast(coalesce(sum(stock_quantity), 0) AS bigint)"
LOW = "count(*) FILTER (WHERE stock_quantity < minimum_stock_threshold)"

SUMMARY_SQL = f"""
SELECT category, count(asin) AS total_products, {PRICE} AS avg_price, {RATING} AS avg_rating,
       {STOCK} AS total_stock, round(coalesce(sum(daily_sales_avg), 0), 2) AS daily_sales
FROM catalog WHERE category IS NOT NULL GROUP BY category"""
WAREHOUSE_SQL = f"""
SELECT warehouse_location, count(asin) AS asin, {STOCK} AS stock_quantity
FROM catalog WHERE warehouse_location IS NOT NULL GROUP BY warehouse_location"""


@query("category_summary", SUMMARY_SQL)
def category_summary(spark, root):
    return stats.category_summary(catalog(spark, root))


@query("warehouse_summary", WAREHOUSE_SQL)
def _(spark, root):
    return stats.warehouse_summary(catalog(spark, root))


@query("category_stats", f"""
SELECT category, count(asin) AS asin, {RATING} AS rating, {PRICE} AS price, {STOCK} AS stock_quantity
FROM catalog WHERE category IS NOT NULL GROUP BY category""")
def _(spark, root):
    return stats.category_stats(catalog(spark, root))


@query("warehouse_stats", WAREHOUSE_SQL)
def _(spark, root):
    return stats.warehouse_summary(catalog(spark, root))


@query("global_stats", f"""
SELECT count(*) AS total_products, {STOCK} AS total_stock, {LOW} AS low_stock_count,
       {RATING} AS avg_rating, {PRICE} AS avg_price FROM catalog""")
def _(spark, root):
    return stats.global_stats(catalog(spark, root))


_FIGURES = f"count(*) AS n_rows, {STOCK} AS total_stock, {LOW} AS low_stock_count, {RATING} AS avg_rating, {PRICE} AS avg_price"


@query("stats_grouping_sets", f"""
SELECT 'category' AS scope, category AS key, {_FIGURES} FROM catalog WHERE category IS NOT NULL GROUP BY category
UNION ALL
SELECT 'warehouse', warehouse_location, {_FIGURES} FROM catalog WHERE warehouse_location IS NOT NULL GROUP BY warehouse_location
UNION ALL
SELECT 'all', NULL, {_FIGURES} FROM catalog""")
def _(spark, root):
    return stats.dashboard_stats(catalog(spark, root))


_SALES = f"""count(*) AS total_products, {STOCK} AS total_stock,
 round(sum(coalesce(daily_sales_avg, 0)), 2) AS total_daily_sales,
 round(sum(coalesce(price, 0) * coalesce(daily_sales_avg, 0)), 2) AS total_daily_revenue,
 {PRICE} AS avg_price, {RATING} AS avg_rating, round(avg(stock_quantity), 2) AS avg_stock, {LOW} AS low_stock_count"""


@query("sales_summary", f"""
SELECT {_SALES} FROM catalog WHERE warehouse_location = 'Sydney' AND category = 'PROMO'""")
def _(spark, root):
    chosen = catalog(spark, root).where("warehouse_location = 'Sydney' AND category = 'PROMO'")
    return stats.sales_summary(chosen)


@query("sales_summary_by_site", f"SELECT warehouse_location, {_SALES} FROM catalog GROUP BY warehouse_location")
def _(spark, root):
    return stats.sales_summary(catalog(spark, root), "warehouse_location")


@query("average_stats", f"""
SELECT category, {RATING} AS avg_rating, {PRICE} AS avg_price, round(avg(stock_quantity), 2) AS avg_stock,
       count(*) AS total_products, {STOCK} AS total_stock
FROM catalog WHERE category IS NOT NULL GROUP BY ROLLUP (category)""")
def _(spark, root):
    return stats.average_stats(catalog(spark, root))


@query("count_filtered", """
SELECT count(*) AS n FROM catalog
WHERE category = 'SMALL' AND warehouse_location IN ('Perth', 'Sydney') AND price > 2000 AND stock_quantity < 300""")
def _(spark, root):
    chosen = catalog(spark, root).where(
        (F.col("category") == "SMALL") & F.col("warehouse_location").isin("Perth", "Sydney")
        & (F.col("price") > 2000) & (F.col("stock_quantity") < 300))
    return chosen.agg(F.count("*").alias("n"))


@query("low_stock_count", f"SELECT {LOW} AS low_stock_count FROM catalog")
def _(spark, root):
    return catalog(spark, root).agg(stats.low_stock_rows().alias("low_stock_count"))


@query("distinct_categories", """
SELECT category, min(row_id) AS first_row FROM catalog WHERE category IS NOT NULL GROUP BY category""")
def _(spark, root):
    return stats.distinct_categories(catalog(spark, root))


@query("category_breakdown_export", "SELECT category, count(*) AS n_listings FROM raw_listings GROUP BY category")
def _(spark, root):
    return view(spark, root, "raw_listings").groupBy("category").agg(F.count("*").alias("n_listings"))


_SITES = "(VALUES ('Sydney'), ('Melbourne'), ('Brisbane'), ('Perth')) AS s(warehouse_location)"


@query("location_breakdown", f"""
WITH n AS (SELECT s.warehouse_location, count(c.asin) AS item_count FROM {_SITES}
           LEFT JOIN catalog c ON c.warehouse_location = s.warehouse_location GROUP BY 1)
SELECT * FROM n UNION ALL SELECT 'Total', cast(sum(item_count) AS bigint) FROM n""")
def _(spark, root):
    return stats.location_breakdown(catalog(spark, root), BREAKDOWN_ORDER)


@query("location_zero_fill", f"""
WITH n AS (SELECT s.warehouse_location, count(c.asin) AS item_count FROM {_SITES}
           LEFT JOIN (SELECT * FROM catalog WHERE warehouse_location <> 'Perth' AND category = 'PROMO') c
             ON c.warehouse_location = s.warehouse_location GROUP BY 1)
SELECT * FROM n UNION ALL SELECT 'Total', cast(sum(item_count) AS bigint) FROM n""")
def _(spark, root):
    chosen = catalog(spark, root).where("warehouse_location <> 'Perth' AND category = 'PROMO'")
    return stats.location_breakdown(chosen, BREAKDOWN_ORDER)


@query("location_comparison", """
WITH n AS (SELECT warehouse_location, count(*) AS item_count FROM catalog
           WHERE warehouse_location IN ('Sydney', 'Perth') AND contains(lower(product_name), 'gear') GROUP BY 1)
SELECT * FROM n UNION ALL SELECT 'Total', cast(sum(item_count) AS bigint) FROM n""")
def _(spark, root):
    from tallyhouse.functions.questions import contains_any
    chosen = catalog(spark, root).where(contains_any(F.col("product_name"), ["gear"]))
    return stats.location_breakdown(chosen, ["Sydney", "Perth"])


# --- sorts and top-k -------------------------------------------------------

def _top(name: str, metric: str, largest: bool = True) -> None:
    direction = "DESC" if largest else "ASC"

    @query(name, f"SELECT row_id, {metric} FROM catalog ORDER BY {metric} {direction} NULLS LAST, row_id LIMIT 10")
    def _(spark, root):
        return ranking.top_n(catalog(spark, root), metric, 10, largest).select("row_id", metric)


_top("top_n_by_metric", "rating")
_top("top_n_price", "price")
_top("top_n_stock", "stock_quantity")
_top("top_n_reviews", "review_count")
_top("bottom_n_price", "price", largest=False)


@query("top_sellers", """
SELECT row_id, concat(substr(product_name, 1, 50), '...') AS name, daily_sales_avg,
       round(coalesce(price * daily_sales_avg, 0), 2) AS daily_revenue
FROM catalog ORDER BY daily_sales_avg DESC NULLS LAST, row_id LIMIT 5""")
def _(spark, root):
    revenue = F.round(inv.daily_revenue(F.col("price"), F.col("daily_sales_avg")), 2)
    return ranking.top_n(catalog(spark, root), "daily_sales_avg", 5).select(
        "row_id", truncate_name(F.col("product_name"), 50, always_mark=True).alias("name"),
        "daily_sales_avg", revenue.alias("daily_revenue"))


@query("top_n_per_category", """
SELECT category, position, row_id, rating FROM (
  SELECT category, row_id, rating,
         row_number() OVER (PARTITION BY category ORDER BY rating DESC NULLS LAST, row_id) AS position
  FROM catalog WHERE category IS NOT NULL) r WHERE position <= 5""")
def _(spark, root):
    return ranking.top_n_per_group(catalog(spark, root), "category", "rating", 5).select(
        "category", F.col("position").cast("long").alias("position"), "row_id", "rating")


_SORTS = {
    "rating_price": "rating DESC, price ASC", "rating": "rating DESC NULLS LAST", "price_asc": "price ASC",
    "price_desc": "price DESC", "sales": "daily_sales_avg DESC NULLS LAST", "stock": "stock_quantity DESC NULLS LAST",
}
_TYPED = """SELECT c.row_id, CASE WHEN c.row_id % 50 <= 1 THEN NULL ELSE c.price END AS price, c.rating, c.daily_sales_avg, c.stock_quantity FROM catalog c"""


def _gappy(spark, root):
    """Catalogue with unknown prices where the raw text had none."""
    price = F.when(F.col("row_id") % 50 > 1, F.col("price"))
    return catalog(spark, root).withColumn("price", price).select(
        "row_id", "price", "rating", "daily_sales_avg", "stock_quantity")


def _sort(name: str, spec: str) -> None:
    need = "WHERE price IS NOT NULL" if spec in ("rating_price", "price_asc", "price_desc") else ""

    @query(name, f"SELECT row_id, price, rating FROM ({_TYPED}) t {need} ORDER BY {_SORTS[spec]}, row_id")
    def _(spark, root):
        return ranking.sort_catalog(_gappy(spark, root), spec).select("row_id", "price", "rating")


_sort("sort_rating_price", "rating_price")
_sort("sort_single", "rating")
_sort("sort_price_asc", "price_asc")
_sort("sort_price_desc", "price_desc")
_sort("sort_sales", "sales")
_sort("sort_stock", "stock")


@query("low_stock_list", """
SELECT row_id, substr(product_name, 1, 50) AS name, stock_quantity, minimum_stock_threshold,
       minimum_stock_threshold - stock_quantity AS deficit, warehouse_location, cast(restock_date AS string) AS restock_date
FROM catalog WHERE stock_quantity < minimum_stock_threshold ORDER BY stock_quantity, row_id LIMIT 20""")
def _(spark, root):
    low = catalog(spark, root).where("stock_quantity < minimum_stock_threshold")
    return ranking.top_n(low, "stock_quantity", 20, largest=False).select(
        "row_id", F.substring("product_name", 1, 50).alias("name"), "stock_quantity", "minimum_stock_threshold",
        (F.col("minimum_stock_threshold") - F.col("stock_quantity")).alias("deficit"), "warehouse_location",
        F.col("restock_date").cast("string").alias("restock_date"))


@query("list_limit", """
SELECT row_id, product_name, greatest((SELECT count(*) FROM catalog WHERE category = 'LARGE') - 10, 0) AS n_more
FROM catalog WHERE category = 'LARGE' ORDER BY row_id LIMIT 10""")
def _(spark, root):
    chosen = catalog(spark, root).where("category = 'LARGE'").select("row_id", "product_name")
    return ranking.listed_with_rest(chosen, None)


@query("formatted_list", """
SELECT position, concat(cast(position AS string), '. ', product_name, ' | $', printf('%.2f', price), ' | Stock:',
  cast(stock_quantity AS string), ' | ', printf('%.1f', rating)) AS line
FROM (SELECT *, row_number() OVER (ORDER BY rating DESC, price, row_id) AS position FROM catalog) c WHERE position <= 10""")
def _(spark, root):
    return ranking.formatted_list(catalog(spark, root), 10, F.col("rating").desc(), F.col("price"), F.col("row_id")).withColumn(
        "position", F.col("position").cast("long"))


def _head(name: str, n: int) -> None:
    @query(name, f"SELECT row_id, product_name FROM catalog WHERE warehouse_location = 'Perth' ORDER BY row_id LIMIT {n}")
    def _(spark, root):
        chosen = catalog(spark, root).where("warehouse_location = 'Perth'")
        return chosen.orderBy("row_id").limit(n).select("row_id", "product_name")


_head("list_first_10", 10)
_head("list_first_15", 15)


@query("union_categories", """
SELECT row_id, category FROM catalog WHERE category = 'PROMO' UNION ALL
SELECT row_id, category FROM catalog WHERE category = 'SMALL'""")
def _(spark, root):
    rows = catalog(spark, root).select("row_id", "category")
    return rows.where("category = 'PROMO'").unionByName(rows.where("category = 'SMALL'"))
