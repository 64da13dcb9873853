"""Registered queries: cleaning, validation, enrichment, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions import cleaning as cl
from tallyhouse.functions import inventory as inv
from tallyhouse.functions import render
from tallyhouse.operators import cleaning as ops
from tallyhouse.operators import enrichment as enrich
from tallyhouse.plans.registry import query
from tallyhouse.plans.views import RUN_TS, catalog, view
from tallyhouse.sources.tables import table


def run_ts():
    return F.lit(RUN_TS).cast("timestamp")


REQUIRED = ["asin", "product_name", "category", "price", "rating"]

PRICE_SQL = "try_cast(replace(replace(discounted_price, '$', ''), ',', '') AS double)"
RATING_SQL = "try_cast(nullif(regexp_extract(rating, '([0-9.]+)', 1), '') AS double)"
REVIEWS_SQL = "try_cast(replace(review_count, ',', '') AS double)"
TYPED_SQL = f"""typed AS (SELECT row_id, product_id AS asin, product_name, category,
  {PRICE_SQL} AS price, {RATING_SQL} AS rating, {REVIEWS_SQL} AS review_count FROM raw_listings)"""


def typed(spark: SparkSession, root: str) -> DataFrame:
    return ops.type_listings(view(spark, root, "raw_listings"))


@query("clean_price", f"SELECT row_id, discounted_price, {PRICE_SQL} AS price FROM raw_listings")
def _(spark, root):
    raw = view(spark, root, "raw_listings")
    return raw.select("row_id", "discounted_price", cl.clean_price(F.col("discounted_price")).alias("price"))


@query("clean_rating", f"SELECT row_id, rating AS raw_rating, {RATING_SQL} AS rating FROM raw_listings")
def _(spark, root):
    raw = view(spark, root, "raw_listings")
    return raw.select("row_id", F.col("rating").alias("raw_rating"), cl.clean_rating(F.col("rating")).alias("rating"))


@query("clean_reviews", f"SELECT row_id, {REVIEWS_SQL} AS review_count FROM raw_listings")
def _(spark, root):
    raw = view(spark, root, "raw_listings")
    return raw.select("row_id", cl.clean_reviews(F.col("review_count")).alias("review_count"))


@query("rename_key", "SELECT product_id AS asin, category, rank FROM raw_listings")
def _(spark, root):
    return view(spark, root, "raw_listings").withColumnRenamed("product_id", "asin").select("asin", "category", "rank")


@query("fill_median_price", f"""
WITH {TYPED_SQL}
SELECT row_id, asin, coalesce(price, (SELECT median(price) FROM typed)) AS price FROM typed""")
def _(spark, root):
    return ops.fill_median(typed(spark, root).select("row_id", "asin", "price"))


@query("fill_constants", f"""
WITH {TYPED_SQL}
SELECT row_id, coalesce(rating, 4.5e0) AS rating, coalesce(review_count, 0e0) AS review_count FROM typed""")
def _(spark, root):
    return ops.fill_constants(typed(spark, root)).select("row_id", "rating", "review_count")


@query("clean_listings", f"""
WITH {TYPED_SQL}
SELECT row_id, asin, category, coalesce(price, (SELECT median(price) FROM typed)) AS price,
       coalesce(rating, 4.5e0) AS rating, coalesce(review_count, 0e0) AS review_count FROM typed""")
def _(spark, root):
    return ops.clean_listings(view(spark, root, "raw_listings")).select(
        "row_id", "asin", "category", "price", "rating", "review_count")


@query("doc_defaults", f"""
WITH {TYPED_SQL}
SELECT row_id, cast(asin AS string) AS asin, coalesce(price, 0e0) AS price, coalesce(rating, 0e0) AS rating,
       coalesce(cast(review_count AS bigint), 0) AS review_count FROM typed""")
def _(spark, root):
    meta = F.struct(
        F.col("asin").cast("string").alias("asin"),
        F.coalesce(F.col("price"), F.lit(0.0)).alias("price"),
        F.coalesce(F.col("rating"), F.lit(0.0)).alias("rating"),
        F.coalesce(F.col("review_count").cast("long"), F.lit(0)).alias("review_count"),
    )
    return typed(spark, root).select("row_id", meta.alias("metadata")).select("row_id", "metadata.*")


@query("dq_required", f"""
WITH {TYPED_SQL}
SELECT row_id, concat_ws(',',
  CASE WHEN asin IS NULL OR trim(asin) = '' THEN 'asin' END,
  CASE WHEN product_name IS NULL OR trim(product_name) = '' THEN 'product_name' END,
  CASE WHEN category IS NULL OR trim(category) = '' THEN 'category' END,
  CASE WHEN price IS NULL THEN 'price' END,
  CASE WHEN rating IS NULL THEN 'rating' END) AS missing FROM typed""")
def _(spark, root):
    return typed(spark, root).select("row_id", F.concat_ws(",", ops.missing_fields(REQUIRED)).alias("missing"))


@query("dq_ranges", f"""
WITH {TYPED_SQL}
SELECT t.row_id, coalesce(t.price BETWEEN 0.01 AND 10000, false) AS price_ok,
       coalesce(t.rating BETWEEN 0 AND 5, false) AS rating_ok,
       coalesce(c.stock_quantity BETWEEN 0 AND 10000, false) AS stock_ok
FROM typed t LEFT JOIN catalog c ON t.asin = c.asin""")
def _(spark, root):
    stock = catalog(spark, root).select("asin", "stock_quantity")
    rows = typed(spark, root).join(stock, "asin", "left")
    return rows.select("row_id", *[c.alias(n) for n, c in ops.range_flags().items()])


def _dedupe_sql(direction: str) -> str:
    return f"""
SELECT row_id, product_id, discounted_price FROM raw_listings
QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY row_id {direction}) = 1"""


@query("dq_dedupe", _dedupe_sql("ASC"))
def _(spark, root):
    raw = view(spark, root, "raw_listings").select("row_id", "product_id", "discounted_price")
    return ops.dedupe(raw, "product_id", "row_id", "first")


@query("dq_dedupe_last", _dedupe_sql("DESC"))
def _(spark, root):
    raw = view(spark, root, "raw_listings").select("row_id", "product_id", "discounted_price")
    return ops.dedupe(raw, "product_id", "row_id", "last")


@query("dq_score", f"""
WITH {TYPED_SQL}, flags AS (
  SELECT (trim(asin) <> '' AND trim(product_name) <> '' AND trim(category) <> ''
          AND price IS NOT NULL AND rating IS NOT NULL) AS complete,
         coalesce(price BETWEEN 0.01 AND 10000, false) AS p, coalesce(rating BETWEEN 0 AND 5, false) AS r
  FROM typed),
score AS (SELECT count(*) AS n_rows, count(*) FILTER (NOT complete) AS n_incomplete,
  count(*) FILTER (NOT p) AS n_bad_price, count(*) FILTER (NOT r) AS n_bad_rating,
  round(100 * avg(CASE WHEN complete AND p AND r THEN 1 ELSE 0 END), 2) AS quality_score FROM flags)
SELECT *, CASE WHEN quality_score >= 90 THEN 'Excellent' WHEN quality_score >= 80 THEN 'Good'
               WHEN quality_score >= 70 THEN 'Fair' ELSE 'Poor' END AS band FROM score""")
def _(spark, root):
    flags = ops.range_flags()
    checks = {k: flags[k] for k in ("price_ok", "rating_ok")}
    return ops.quality_report(typed(spark, root), REQUIRED, checks)


# --- enrichment ------------------------------------------------------------

@query("assign_warehouse", """
SELECT row_id, product_id, CASE row_id % 4 WHEN 0 THEN 'Melbourne' WHEN 1 THEN 'Sydney'
  WHEN 2 THEN 'Brisbane' ELSE 'Perth' END AS warehouse_location FROM raw_listings""")
def _(spark, root):
    raw = view(spark, root, "raw_listings")
    return raw.select("row_id", "product_id", inv.warehouse_for(F.col("row_id")).alias("warehouse_location"))


@query("inventory_facts", """
SELECT p.p_partkey AS row_id, p.p_name AS product_name,
  coalesce(f.units, 0) % 451 AS stock_quantity, coalesce(f.n_sales, 0) AS n_sales,
  round(coalesce(f.units / f.n_days, 0), 2) AS daily_sales_avg,
  cast(f.last_sold AS string) AS last_sold_date, f.lead_days AS supplier_lead_time_days
FROM part p LEFT JOIN (
  SELECT l_partkey, cast(sum(l_quantity) AS bigint) AS units, count(*) AS n_sales,
    count(DISTINCT cast(l_shipdate AS date)) AS n_days, max(cast(l_shipdate AS date)) AS last_sold,
    round(avg(CASE WHEN l_shipdate >= o_orderdate
                   THEN date_diff('day', cast(o_orderdate AS date), cast(l_shipdate AS date)) END), 2) AS lead_days
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey) f
ON p.p_partkey = f.l_partkey""")
def _(spark, root):
    products = table(spark, root, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("product_name"))
    facts = enrich.sales_facts(table(spark, root, "lineitem"), table(spark, root, "orders"))
    # the tables have no stock; a figure that follows the units sold stands in
    return enrich.inventory_facts(products, facts).withColumn("stock_quantity", F.col("units") % 451).drop("units")


@query("restock_date", f"""
SELECT row_id, cast(cast(timestamp '{RUN_TS}' AS date) + cast(7 + row_id % 23 AS int) AS string) AS restock_date,
       cast(cast(timestamp '{RUN_TS}' AS date) - cast(row_id % 30 AS int) AS string) AS last_sold_date FROM catalog""")
def _(spark, root):
    day = F.to_date(run_ts())
    return catalog(spark, root).select(
        "row_id",
        F.date_add(day, (7 + F.col("row_id") % 23).cast("int")).cast("string").alias("restock_date"),
        F.date_sub(day, (F.col("row_id") % 30).cast("int")).cast("string").alias("last_sold_date"))


@query("last_sold", f"""
SELECT row_id, cast(last_sold_date AS string) AS last_sold_date,
  date_diff('day', last_sold_date, cast(timestamp '{RUN_TS}' AS date)) AS days_since_sale FROM catalog""")
def _(spark, root):
    return catalog(spark, root).select(
        "row_id", F.col("last_sold_date").cast("string").alias("last_sold_date"),
        F.datediff(F.to_date(run_ts()), F.col("last_sold_date")).cast("long").alias("days_since_sale"))


def _rating_query(name: str, fn, sql: str) -> None:
    @query(name, f"SELECT row_id, rating, {sql} AS {name} FROM catalog")
    def _(spark, root):
        return catalog(spark, root).select("row_id", "rating", fn(F.col("rating")).alias(name))


_rating_query("sentiment_score", inv.sentiment_score, "round(rating * 20, 1)")
_rating_query("recommendation_score", inv.recommendation_score, "round(rating / 5 * 100, 1)")
_rating_query("satisfaction_level", inv.satisfaction_level,
              "CASE WHEN rating > 0 AND rating <= 4.0 THEN 'Poor' WHEN rating > 4.0 AND rating <= 4.3 THEN 'Average' "
              "WHEN rating > 4.3 AND rating <= 4.6 THEN 'Good' WHEN rating > 4.6 AND rating <= 5.1 THEN 'Excellent' END")
_rating_query("complaint_risk", inv.complaint_risk, "CASE WHEN rating < 4.0 THEN 'High' ELSE 'Low' END")

DAYS_SQL = (f"cast(floor((epoch(cast(restock_date AS timestamp)) - epoch(timestamp '{RUN_TS}')) / 86400) AS bigint)")


def with_days(df: DataFrame) -> DataFrame:
    return df.withColumn("days_until_restock", inv.days_until(F.col("restock_date"), run_ts()))


@query("days_until_restock", f"SELECT row_id, {DAYS_SQL} AS days_until_restock FROM catalog")
def _(spark, root):
    return with_days(catalog(spark, root)).select("row_id", "days_until_restock")


@query("daily_revenue", "SELECT row_id, round(coalesce(price, 0) * coalesce(daily_sales_avg, 0), 4) AS daily_revenue FROM catalog")
def _(spark, root):
    revenue = inv.daily_revenue(F.col("price"), F.col("daily_sales_avg"))
    return catalog(spark, root).select("row_id", F.round(revenue, 4).alias("daily_revenue"))


@query("stock_deficit", "SELECT row_id, minimum_stock_threshold - stock_quantity AS deficit FROM catalog")
def _(spark, root):
    return catalog(spark, root).select("row_id", (F.col("minimum_stock_threshold") - F.col("stock_quantity")).alias("deficit"))


@query("product_description", """
SELECT row_id, concat(product_name, ' in ', category, ' category. Priced at $', printf('%.2f', price), ' with ',
  cast(rating AS string), '/5 rating. Stock: ', cast(stock_quantity AS string), ' units at ', warehouse_location, '. ',
  CASE WHEN stock_quantity < minimum_stock_threshold
       THEN concat('⚠️ LOW STOCK - Restock scheduled for ', cast(restock_date AS string), '. ') ELSE '' END)
  AS product_description FROM catalog""")
def _(spark, root):
    return catalog(spark, root).select("row_id", render.product_description().alias("product_description"))


@query("truncate_name", """
SELECT row_id, CASE WHEN length(long_name) > 48 THEN concat(substr(long_name, 1, 48), '...') ELSE long_name END AS name48,
       concat(substr(long_name, 1, 50), '...') AS name50, substr(long_name, 1, 60) AS name60
FROM (SELECT row_id, concat(product_name, ' / ', category, ' / ', warehouse_location, repeat('.', cast(row_id % 40 AS int))) AS long_name FROM catalog) n""")
def _(spark, root):
    dots = F.expr("repeat('.', cast(row_id % 40 AS int))")
    name = F.concat("product_name", F.lit(" / "), "category", F.lit(" / "), "warehouse_location", dots)
    named = catalog(spark, root).select("row_id", name.alias("long_name"))
    return named.select(
        "row_id", render.truncate_name(F.col("long_name")).alias("name48"),
        render.truncate_name(F.col("long_name"), 50, always_mark=True).alias("name50"),
        F.substring("long_name", 1, 60).alias("name60"))


@query("list_row_format", f"""
WITH {TYPED_SQL}
SELECT t.row_id, concat(cast(t.row_id % 10 + 1 AS string), '. ', t.product_name, ' | ',
   CASE WHEN t.price IS NULL THEN 'N/A' ELSE concat('$', printf('%.2f', t.price)) END,
   ' | Stock:', cast(c.stock_quantity AS string), ' | ',
   CASE WHEN t.rating IS NULL THEN 'N/A' ELSE printf('%.1f', t.rating) END) AS line
FROM typed t JOIN catalog c ON t.asin = c.asin""")
def _(spark, root):
    stock = catalog(spark, root).select("asin", "stock_quantity")
    rows = typed(spark, root).join(stock, "asin")
    return rows.select("row_id", render.list_row(F.col("row_id") % 10 + 1).alias("line"))


# --- filters ---------------------------------------------------------------

def _filter(name: str, predicate: str, sql: str | None = None) -> None:
    columns = "row_id, category, warehouse_location, price, rating, stock_quantity"

    @query(name, f"SELECT {columns} FROM catalog WHERE {sql or predicate}")
    def _(spark, root):
        return catalog(spark, root).where(predicate).select(*columns.split(", "))


_filter("filter_category", "category = 'PROMO'")
_filter("filter_location", "lower(warehouse_location) = 'sydney'")
_filter("filter_locations_in", "warehouse_location IN ('Perth', 'Brisbane')")
_filter("filter_location_ne", "NOT (warehouse_location <=> 'Perth')", "warehouse_location IS DISTINCT FROM 'Perth'")
_filter("filter_rating_gt", "rating > 4.5")
_filter("filter_price_gt", "price > 3000")
_filter("filter_price_lt", "price < 3000")
_filter("filter_stock_gt", "stock_quantity > 200")
_filter("filter_stock_lt", "stock_quantity < 50")
_filter("low_stock", "stock_quantity < minimum_stock_threshold")
_filter("high_performers", "rating >= 4.6 AND daily_sales_avg > 30")


@query("filter_keywords", """
SELECT row_id, product_name FROM catalog
WHERE coalesce(contains(lower(product_name), 'ring') OR contains(lower(product_name), 'gizmo'), false)""")
def _(spark, root):
    from tallyhouse.functions.questions import contains_any
    return catalog(spark, root).where(contains_any(F.col("product_name"), ["ring", "gizmo"])).select("row_id", "product_name")


@query("drop_null_keys", f"""
WITH {TYPED_SQL} SELECT row_id, price, rating FROM typed WHERE price IS NOT NULL AND rating IS NOT NULL""")
def _(spark, root):
    return typed(spark, root).na.drop(subset=["price", "rating"]).select("row_id", "price", "rating")


@query("restock_queue", f"SELECT row_id, {DAYS_SQL} AS days_until_restock FROM catalog WHERE {DAYS_SQL} <= 7")
def _(spark, root):
    rows = with_days(catalog(spark, root))
    return rows.where(enrich.split_predicates()["restock_queue"]).select("row_id", "days_until_restock")


SPLIT_SQL = f"""
SELECT row_id, coalesce(stock_quantity < minimum_stock_threshold, false) AS low,
       coalesce(rating >= 4.6 AND daily_sales_avg > 30, false) AS high, {DAYS_SQL} <= 7 AS soon FROM catalog"""


@query("active_inventory", f"SELECT row_id FROM ({SPLIT_SQL}) s WHERE NOT (low OR high OR soon)")
def _(spark, root):
    rows = with_days(catalog(spark, root))
    return rows.where(enrich.split_predicates()["active_inventory"]).select("row_id")


@query("category_split", f"""
WITH s AS ({SPLIT_SQL})
SELECT row_id, 'low_stock' AS split FROM s WHERE low UNION ALL
SELECT row_id, 'high_performers' FROM s WHERE high UNION ALL
SELECT row_id, 'restock_queue' FROM s WHERE soon UNION ALL
SELECT row_id, 'active_inventory' FROM s WHERE NOT (low OR high OR soon)""")
def _(spark, root):
    return enrich.tag_splits(with_days(catalog(spark, root))).select("row_id", "split")
