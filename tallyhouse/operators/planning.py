"""Site recommendations, transfers and adjustments, as table jobs.

Stock is first summed per site and category (and keyword set), and that table
is written. Its true size then decides whether the lookups ship it whole, in
which case the requests are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators.requests import ANY, any_or, category_key, key_of, keyword_classes, keyword_key
from tallyhouse.schemas import TRANSFERS
from tallyhouse.sources.workspace import materialize

MAX_SUGGESTED_TRANSFER = 50


def stock_cube(products: DataFrame, *extra: str) -> DataFrame:
    """Units and rows per (category or any, site or any)."""
    base = products.groupBy("category", "warehouse_location", *extra).agg(
        F.coalesce(F.sum("stock_quantity"), F.lit(0)).alias("units"), F.count("*").alias("item_count"))
    keyed = base.withColumn("category_key", any_or("category")).withColumn("site", any_or("warehouse_location"))
    return materialize(keyed.groupBy("category_key", "site", *extra).agg(
        F.sum("units").alias("units"), F.sum("item_count").alias("item_count")), "stock-cube")


def site_lists(products: DataFrame, asked: DataFrame) -> DataFrame:
    """Sites by stock per distinct (category, keyword set), as one short array."""
    classed, edges = keyword_classes(products.where(F.col("warehouse_location").isNotNull()), asked)
    both = classed.withColumn("class_key", F.explode(F.array(F.col("class_key"), F.lit(ANY))))
    cube = stock_cube(both, "class_key").where(F.col("site") != ANY).join(edges, "class_key").groupBy(
        "category_key", "keyword_key", "site").agg(
        F.sum("units").alias("units"), F.sum("item_count").alias("item_count"))
    entry = F.struct((-F.col("units")).alias("by"), F.substr("site", F.lit(2)).alias("site"), "units", "item_count")
    return materialize(cube.groupBy("category_key", "keyword_key").agg(
        F.array_sort(F.collect_list(entry)).alias("sites")), "site-lists")


def with_keys(requests: DataFrame) -> DataFrame:
    return requests.withColumns({
        "category_key": category_key(), "keyword_key": keyword_key(F.col("keywords"))})


def ranked_sites(products: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests with their sites by stock (``kept``), the excluded one left out.

    Requests: ``request_id, category, keywords, excluded``. The ranking of
    sites is made once per distinct (category, keyword set); a request only
    drops its excluded site from it.
    """
    asked = with_keys(requests)
    excluded = stock_cube(products).where(F.col("site") != ANY).select(
        "category_key", F.substr("site", F.lit(2)).alias("excluded"), F.col("units").alias("excluded_units"))
    joined = asked.join(site_lists(products, asked), ["category_key", "keyword_key"], "left").join(
        excluded, ["category_key", "excluded"], "left")
    # Without an excluded site nothing is dropped.
    kept = F.filter("sites", lambda s: ~F.coalesce(s["site"] == F.col("excluded"), F.lit(False)))
    best = F.get("kept", 0)
    left = F.coalesce("excluded_units", F.lit(0))
    suggestion = F.when(F.col("excluded").isNotNull() & (left == 0) & best["units"].isNotNull(), F.least(
        F.floor(best["units"] / 2), F.lit(MAX_SUGGESTED_TRANSFER)))
    return joined.withColumn("kept", kept).withColumn("excluded_units", left).withColumn(
        "suggested_transfer", suggestion)


def recommend_sites(products: DataFrame, requests: DataFrame) -> DataFrame:
    """Best site and two alternatives per request."""
    best = F.get("kept", 0)
    return ranked_sites(products, requests).select(
        "request_id", best["site"].alias("best_site"), best["units"].alias("best_units"),
        best["item_count"].alias("best_items"),
        F.get("kept", 1)["site"].alias("second_site"), F.get("kept", 2)["site"].alias("third_site"),
        "excluded_units", "suggested_transfer")


def excluded_stock(products: DataFrame, requests: DataFrame) -> DataFrame:
    """Units at the excluded site, in the category if one is given."""
    cube = stock_cube(products).where(F.col("site") != ANY).select(
        "category_key", F.substr("site", F.lit(2)).alias("excluded"), "units")
    asked = requests.select("request_id", "excluded", category_key().alias("category_key"))
    return asked.join(cube, ["category_key", "excluded"], "left").select(
        "request_id", "excluded", F.coalesce("units", F.lit(0)).alias("units"))


# --- transfers -------------------------------------------------------------

def parse_transfers(df: DataFrame, column: str = "transfer_json") -> DataFrame:
    """JSON transfer plans to one row per transfer."""
    parsed = F.from_json(F.col(column), TRANSFERS, {"mode": "PERMISSIVE"})
    kept = [c for c in df.columns if c != column]
    plan = df.select(*kept, parsed.alias("p"))
    # The outer form keeps the optimizer from parsing once more for a filter.
    steps = plan.select(*kept, F.explode_outer(F.when(F.col("p.is_transfer"), F.col("p.transfers"))).alias("t"))
    return steps.where("t IS NOT NULL").select(*kept, "t.*")


def complete_transfer() -> Column:
    """Both places, a category and a quantity other than 0 are given."""
    named = [F.coalesce(F.col(c) != "", F.lit(False)) for c in ("from_city", "to_city", "category")]
    return named[0] & named[1] & named[2] & F.coalesce(F.col("quantity") != 0, F.lit(False))


def transfer_legs(transfers: DataFrame) -> DataFrame:
    """Two signed legs per complete transfer; incomplete ones are skipped."""
    legs = F.array(
        F.struct(F.col("from_city").alias("warehouse_location"), (-F.col("quantity")).alias("delta")),
        F.struct(F.col("to_city").alias("warehouse_location"), F.col("quantity").alias("delta")))
    kept = [c for c in transfers.columns if c not in ("from_city", "to_city", "quantity")]
    return transfers.where(complete_transfer()).select(*kept, F.explode(legs).alias("leg")).select(*kept, "leg.*")


def stock_by_site(products: DataFrame) -> DataFrame:
    return materialize(products.groupBy("warehouse_location", "category").agg(
        F.coalesce(F.sum("stock_quantity"), F.lit(0)).alias("units")), "site-stock")


def transfer_stock(products: DataFrame, transfers: DataFrame) -> DataFrame:
    """Current units at both ends of each transfer."""
    legs = transfer_legs(transfers)
    return legs.join(stock_by_site(products), ["warehouse_location", "category"], "left").withColumn(
        "units", F.coalesce("units", F.lit(0)))


def project_transfers(products: DataFrame, transfers: DataFrame, *by: str) -> DataFrame:
    """Units per (site, category) before and after all transfers (per ``by``)."""
    deltas = transfer_legs(transfers).groupBy(*by, "warehouse_location", "category").agg(F.sum("delta").alias("delta"))
    before = F.coalesce("units", F.lit(0))
    after = before + F.col("delta")
    return deltas.join(stock_by_site(products), ["warehouse_location", "category"], "left").select(
        *by, "warehouse_location", "category", before.alias("units_before"), "delta", after.alias("units_after"),
        (after < 0).alias("shortage"), F.greatest(-after, F.lit(0)).alias("missing_units"))


# --- adjustments -----------------------------------------------------------

def count_rows(products: DataFrame, requests: DataFrame, *keep: str) -> DataFrame:
    """Rows per request: ``request_id, category, locations`` and ``keep``.

    The named sites are distinct, so their counts add up.
    """
    sites = F.array_distinct(F.transform("locations", key_of))
    asked = requests.withColumn("site", F.explode(
        F.when(F.size(sites) > 0, sites).otherwise(F.array(F.lit(ANY))))).withColumn(
        "category_key", category_key())
    cube = stock_cube(products).select("category_key", "site", "item_count")
    return asked.join(cube, ["category_key", "site"], "left").groupBy("request_id", *keep).agg(
        F.coalesce(F.sum("item_count"), F.lit(0)).alias("current"))


def project_adjustments(products: DataFrame, requests: DataFrame) -> DataFrame:
    """Row count after adding or removing ``quantity`` rows, with the change in %.

    Requests: ``request_id, operation, quantity, category, locations``.
    """
    counted = count_rows(products, requests, "operation", "quantity")
    q, now = F.col("quantity"), F.col("current")
    given = F.coalesce(F.col("operation") != "", F.lit(False)) & F.coalesce(q != 0, F.lit(False))
    status = (
        F.when(~given, "incomplete")
        .when((F.col("operation") == "subtract") & (q > now), "not enough")
        .when((F.col("operation") == "add") & (now == 0), "new inventory")
        .when(F.col("operation").isin("add", "subtract"), "ok")
        .otherwise("unsupported"))
    signed = F.when(F.col("operation") == "subtract", -q).otherwise(q)
    done = status.isin("ok", "new inventory")
    return counted.select(
        "request_id", "operation", "quantity", "current", status.alias("status"),
        F.when(done, now + signed).alias("after"),
        F.when(status.isin("ok"), F.round(signed / F.nullif(now, F.lit(0)) * 100, 1)).alias("change_percent"))
