"""Registered queries: requests, recommendations, transfers, adjustments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions import questions as q
from tallyhouse.functions import vocab
from tallyhouse.operators import context as ctx
from tallyhouse.operators import planning, requests as rq
from tallyhouse.plans import question_sql as s
from tallyhouse.plans.registry import query
from tallyhouse.plans.views import catalog, view


def _list(column: str):
    return F.when(F.col(column).isNotNull(), F.array(column)).otherwise(F.array().cast("array<string>"))


def intent_json(spark: SparkSession, root: str) -> DataFrame:
    """Requests as the JSON a language model returns for them."""
    bounds = F.map_filter(F.create_map(
        F.lit("rating"), F.concat(F.lit(">"), F.col("min_rating").cast("string")),
        F.lit("price"), F.concat(F.lit(">"), F.col("min_price").cast("string")),
        F.lit("stock"), F.concat(F.lit("> "), F.col("min_stock").cast("string"))), lambda k, v: v.isNotNull())
    intent = F.struct(
        F.lit("count").alias("intent"), _list("location").alias("locations"),
        F.array("excluded").alias("exclude_locations"), "category", "operation",
        F.col("n_rows").alias("quantity"), bounds.alias("filters"), _list("keyword").alias("product_keywords"))
    return view(spark, root, "requests").select("request_id", F.to_json(intent).alias("intent_json"))


def parsed_requests(spark: SparkSession, root: str) -> DataFrame:
    return rq.requests_from_intents(rq.parse_intents(intent_json(spark, root)))


def plain_requests(spark: SparkSession, root: str) -> DataFrame:
    return view(spark, root, "requests").withColumns({"locations": _list("location"), "keywords": _list("keyword")})


MATCH = """(r.category IS NULL OR r.category = c.category) AND (r.location IS NULL OR r.location = c.warehouse_location)
  AND (r.keyword IS NULL OR contains(lower(c.product_name), r.keyword))
  AND (r.min_rating IS NULL OR c.rating > r.min_rating) AND (r.min_price IS NULL OR c.price > r.min_price)
  AND (r.min_stock IS NULL OR c.stock_quantity > r.min_stock)"""


@query("parse_intent_json", """
SELECT request_id, 'count' AS intent, coalesce(location, '') AS locations, excluded AS exclude_locations, category,
  operation, n_rows AS quantity, coalesce(keyword, '') AS product_keywords,
  CASE WHEN min_rating IS NULL THEN NULL ELSE concat('>', cast(min_rating AS string)) END AS rating_filter,
  cast(min_price AS double) AS price_above FROM requests""")
def _(spark, root):
    parsed = rq.parse_intents(intent_json(spark, root))
    return parsed.select(
        "request_id", "intent", F.concat_ws(",", "locations").alias("locations"),
        F.get("exclude_locations", 0).alias("exclude_locations"), "category", "operation", "quantity",
        F.concat_ws(",", "product_keywords").alias("product_keywords"),
        F.try_element_at("filters", F.lit("rating")).alias("rating_filter"),
        rq.filter_bound(F.col("filters"), "price", ">").alias("price_above"))


@query("request_match", f"""
SELECT r.request_id, count(c.asin) AS n_matches, cast(coalesce(sum(c.stock_quantity), 0) AS bigint) AS total_units
FROM requests r LEFT JOIN catalog c ON {MATCH} GROUP BY r.request_id""")
def _(spark, root):
    return rq.match_requests(catalog(spark, root), parsed_requests(spark, root))


@query("request_first_rows", f"""
SELECT request_id, coalesce(string_agg(asin, ',' ORDER BY row_id) FILTER (WHERE k <= n_rows), '') AS asins
FROM (SELECT r.request_id, r.n_rows, c.asin, c.row_id, row_number() OVER (PARTITION BY r.request_id ORDER BY c.row_id) AS k
      FROM requests r LEFT JOIN catalog c ON {MATCH}) m GROUP BY request_id""")
def _(spark, root):
    found = rq.first_rows(catalog(spark, root), parsed_requests(spark, root))
    return found.select("request_id", F.concat_ws(",", "asins").alias("asins"))


_KW = [w for w in s.WORDS]
_ASKED = s.CONTEXT + f""", asked AS (SELECT conv_id * 1000000 + turn AS request_id, category, location, words,
  {s.RATING} AS rating_above, {s.PRICE} AS price_above, {s.STOCK} AS stock_above FROM ctx WHERE route = 'data'),
names AS (SELECT DISTINCT lower(product_name) AS name FROM products),
masks AS (SELECT name, cast({' + '.join(f"(CASE WHEN contains(name, {s.lit(w)}) THEN {1 << i} ELSE 0 END)" for i, w in enumerate(_KW))} AS bigint) AS mask FROM names)"""


@query("answer_questions", _ASKED + """
SELECT r.request_id, count(c.asin) AS n_matches, cast(coalesce(sum(c.stock_quantity), 0) AS bigint) AS total_units
FROM asked r LEFT JOIN (SELECT c.*, m.mask FROM catalog c JOIN masks m ON lower(c.product_name) = m.name) c
  ON (r.category IS NULL OR r.category = c.category) AND (r.location IS NULL OR r.location = c.warehouse_location)
  AND (r.words = 0 OR (r.words & c.mask) <> 0) AND (r.rating_above IS NULL OR c.rating > r.rating_above)
  AND (r.price_above IS NULL OR c.price > r.price_above) AND (r.stock_above IS NULL OR c.stock_quantity > r.stock_above)
GROUP BY r.request_id""")
def _(spark, root):
    return rq.match_requests(catalog(spark, root), question_requests(spark, root))


def question_requests(spark: SparkSession, root: str) -> DataFrame:
    """Catalogue questions, with their context, as requests."""
    rows = ctx.carry_context(view(spark, root, "questions"), s.CATEGORIES, s.WORDS).where("route = 'data'")
    none = F.lit(None).cast("double")
    return rows.select(
        (F.col("conv_id") * 1000000 + F.col("turn")).alias("request_id"), "category",
        _list("location").alias("locations"), ctx.mask_words(F.col("words"), s.WORDS).alias("keywords"),
        q.number(F.col("norm"), vocab.RATING_PATTERNS).alias("rating_above"),
        q.number(F.col("norm"), vocab.PRICE_PATTERNS).alias("price_above"), none.alias("price_below"),
        q.number(F.col("norm"), vocab.STOCK_PATTERNS).alias("stock_above"), none.alias("stock_below"),
        q.extract_limit(F.col("norm")).alias("n_rows"))


@query("warehouse_recommendation", """
WITH hit AS (SELECT r.request_id, c.warehouse_location AS site, cast(sum(c.stock_quantity) AS bigint) AS units, count(*) AS items
  FROM requests r JOIN catalog c ON (r.category IS NULL OR r.category = c.category)
    AND (r.keyword IS NULL OR contains(lower(c.product_name), r.keyword)) AND c.warehouse_location <> r.excluded
  GROUP BY 1, 2),
pos AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY units DESC, site) AS k FROM hit),
ex AS (SELECT r.request_id, cast(coalesce(sum(c.stock_quantity), 0) AS bigint) AS excluded_units FROM requests r
  LEFT JOIN catalog c ON c.warehouse_location = r.excluded AND (r.category IS NULL OR r.category = c.category) GROUP BY 1)
SELECT r.request_id, max(site) FILTER (WHERE k = 1) AS best_site, max(units) FILTER (WHERE k = 1) AS best_units,
  max(items) FILTER (WHERE k = 1) AS best_items, max(site) FILTER (WHERE k = 2) AS second_site,
  max(site) FILTER (WHERE k = 3) AS third_site, any_value(excluded_units) AS excluded_units,
  CASE WHEN any_value(excluded_units) = 0 THEN least(cast(floor(max(units) FILTER (WHERE k = 1) / 2) AS bigint), 50) END AS suggested_transfer
FROM requests r LEFT JOIN pos p ON p.request_id = r.request_id JOIN ex ON ex.request_id = r.request_id GROUP BY r.request_id""")
def _(spark, root):
    return planning.recommend_sites(catalog(spark, root), plain_requests(spark, root))


@query("excluded_stock_lookup", """
SELECT r.request_id, r.excluded, cast(coalesce(sum(c.stock_quantity), 0) AS bigint) AS units FROM requests r
LEFT JOIN catalog c ON c.warehouse_location = r.excluded AND (r.category IS NULL OR r.category = c.category)
GROUP BY r.request_id, r.excluded""")
def _(spark, root):
    return planning.excluded_stock(catalog(spark, root), view(spark, root, "requests"))


# --- transfers -------------------------------------------------------------

def transfer_json(spark: SparkSession, root: str) -> DataFrame:
    plan = F.struct(F.lit(True).alias("is_transfer"), F.array(F.struct(
        "from_city", "to_city", "category", "quantity")).alias("transfers"))
    return view(spark, root, "transfers").select("transfer_id", F.to_json(plan).alias("transfer_json"))


def _transfers(spark, root):
    return planning.parse_transfers(transfer_json(spark, root))


@query("parse_transfer_json", "SELECT transfer_id, from_city, to_city, category, quantity FROM transfers")
def _(spark, root):
    return _transfers(spark, root)


_LEGS = """legs AS (
  SELECT transfer_id, from_city AS warehouse_location, category, -quantity AS delta FROM transfers WHERE category IS NOT NULL
  UNION ALL SELECT transfer_id, to_city, category, quantity FROM transfers WHERE category IS NOT NULL)"""


@query("transfer_stock_lookup", f"""
WITH {_LEGS} SELECT l.transfer_id, l.warehouse_location, l.category, l.delta, coalesce(b.units, 0) AS units
FROM legs l LEFT JOIN stock_by_site b ON b.warehouse_location = l.warehouse_location AND b.category = l.category""")
def _(spark, root):
    return planning.transfer_stock(catalog(spark, root), _transfers(spark, root))


@query("transfer_projection", f"""
WITH {_LEGS}, d AS (SELECT warehouse_location, category, cast(sum(delta) AS bigint) AS delta FROM legs GROUP BY 1, 2)
SELECT d.warehouse_location, d.category, coalesce(b.units, 0) AS units_before, d.delta,
  coalesce(b.units, 0) + d.delta AS units_after, coalesce(b.units, 0) + d.delta < 0 AS shortage,
  greatest(-(coalesce(b.units, 0) + d.delta), 0) AS missing_units
FROM d LEFT JOIN stock_by_site b ON b.warehouse_location = d.warehouse_location AND b.category = d.category""")
def _(spark, root):
    return planning.project_transfers(catalog(spark, root), _transfers(spark, root))


@query("adjustment_projection", """
WITH n AS (SELECT r.request_id, r.operation, r.quantity, count(c.asin) AS cur FROM requests r
  LEFT JOIN catalog c ON (r.category IS NULL OR r.category = c.category) AND (r.location IS NULL OR r.location = c.warehouse_location)
  GROUP BY 1, 2, 3),
st AS (SELECT *, CASE WHEN quantity = 0 THEN 'incomplete' WHEN operation = 'subtract' AND quantity > cur THEN 'not enough'
  WHEN operation = 'add' AND cur = 0 THEN 'new inventory' ELSE 'ok' END AS status,
  CASE WHEN operation = 'subtract' THEN -quantity ELSE quantity END AS d FROM n)
SELECT request_id, operation, quantity, cur AS current, status,
  CASE WHEN status IN ('ok', 'new inventory') THEN cur + d END AS after,
  CASE WHEN status = 'ok' THEN round(d / nullif(cur, 0) * 100, 1) END AS change_percent FROM st""")
def _(spark, root):
    return planning.project_adjustments(catalog(spark, root), plain_requests(spark, root))
