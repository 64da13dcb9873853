"""Registered queries: alternatives."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhouse.operators import alternatives as alt
from tallyhouse.plans.registry import query
from tallyhouse.plans.views import products

SIMILAR_SQL = """
SELECT a.asin, coalesce((SELECT string_agg(s.asin, '|' ORDER BY s.row_id) FROM (
    SELECT b.asin, b.row_id FROM products b WHERE b.category = a.category AND b.asin <> a.asin
      AND b.price_cents * 10 >= a.price_cents * 7 AND b.price_cents * 10 <= a.price_cents * 13
    ORDER BY b.row_id LIMIT 5) s), '') AS similar_price_alternatives
FROM products a"""
HIGHER_SQL = """
SELECT a.asin, coalesce((SELECT string_agg(s.asin, '|' ORDER BY s.rating DESC, s.row_id) FROM (
    SELECT b.asin, b.row_id, b.rating FROM products b WHERE b.category = a.category AND b.asin <> a.asin
      AND b.rating > a.rating + 0.3e0
    ORDER BY b.rating DESC, b.row_id LIMIT 5) s), '') AS higher_rated_alternatives
FROM products a"""


def _products(spark, root):
    return products(spark, root).select("row_id", "asin", "category", "price_cents", "rating")


@query("similar_price_alternatives", SIMILAR_SQL)
def _(spark, root):
    return alt.similar_price(_products(spark, root)).select(
        "asin", F.concat_ws("|", "similar").alias("similar_price_alternatives"))


@query("higher_rated_alternatives", HIGHER_SQL)
def _(spark, root):
    return alt.higher_rated(_products(spark, root)).select(
        "asin", F.concat_ws("|", "better").alias("higher_rated_alternatives"))


@query("join_alternatives", f"""
WITH s AS ({SIMILAR_SQL}), h AS ({HIGHER_SQL})
SELECT c.row_id, c.asin, s.similar_price_alternatives, h.higher_rated_alternatives
FROM products c LEFT JOIN s ON c.asin = s.asin LEFT JOIN h ON c.asin = h.asin""")
def _(spark, root):
    items = _products(spark, root)
    found = alt.add_alternatives(items)
    return alt.join_alternatives(items.select("row_id", "asin"), found)
