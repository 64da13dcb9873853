"""Input views derived from the given tables, in SQL both engines accept.

A view is written once; ``{...}`` marks the few spots where the dialects
differ. Spark reads the tables through :func:`view`; the SQL twins get the same
text as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tallyhouse.sources.tables import table

RUN_TS = "2001-12-01 13:00:00"

# Categories and product words that occur in the test tables.
TABLE_CATEGORIES = {
    "economy": "ECONOMY", "large": "LARGE", "medium": "MEDIUM",
    "promo": "PROMO", "small": "SMALL", "standard": "STANDARD",
}
TABLE_PRODUCT_WORDS = ["ring", "bolt", "anvil", "widget", "gear", "gizmo", "plate", "rod"]


def _pick(index: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"(CASE {index} {arms} ELSE '{values[-1]}' END)"


_CITY = ["Melbourne", "Sydney", "Brisbane", "Perth"]
_CITY_LOWER = [c.lower() for c in _CITY]
_MISHEARD = ["melborn", "Sidney", "brisbeyn", "pört"]
_TYPES = ["economy", "large", "medium", "promo", "small", "standard"]

_TEMPLATES = {
    "sales_facts": """
SELECT l_partkey, count(*) AS n_sales, cast(sum(l_quantity) AS bigint) AS units,
       count(DISTINCT l_shipdate) AS n_days, cast(max(l_shipdate) AS date) AS last_sold
FROM lineitem GROUP BY l_partkey""",
    "products": """
SELECT p_partkey AS row_id, cast(p_partkey AS string) AS asin, p_name AS product_name, p_type AS category,
       cast(round(p_retailprice * (10 + p_size) * 10) AS bigint) AS price_cents,
       cast(round(p_retailprice * (10 + p_size) * 10) AS double) / 100 AS price,
       cast(30 + p_size % 21 AS double) / 10 AS rating,
       CASE p_partkey % 4 WHEN 0 THEN 'Melbourne' WHEN 1 THEN 'Sydney'
                          WHEN 2 THEN 'Brisbane' ELSE 'Perth' END AS warehouse_location,
       10 + p_partkey % 41 AS minimum_stock_threshold,
       date '2001-12-01' + cast(7 + p_partkey % 23 AS int) AS restock_date
FROM part""",
    "catalog": """
SELECT p.*, coalesce(f.n_sales, 0) AS review_count,
       coalesce(f.units, 0) % 451 AS stock_quantity,
       round(cast(coalesce(f.units, 0) AS double) / f.n_days, 2) AS daily_sales_avg,
       f.last_sold AS last_sold_date
FROM products p LEFT JOIN sales_facts f ON p.row_id = f.l_partkey""",
    "listing_rows": """
SELECT row_id, asin, product_name, category, price_cents, price, rating, review_count
FROM catalog
UNION ALL
SELECT row_id + 1000000000000, asin, product_name, category, price_cents + 100, price + 1,
       rating, review_count
FROM catalog WHERE row_id % 97 = 0""",
    "raw_listings": """
SELECT row_id, asin AS product_id,
       CASE WHEN row_id % 60 = 7 THEN '' ELSE product_name END AS product_name,
       category,
       concat('#', cast(row_id % 100 + 1 AS string)) AS rank,
       CASE WHEN row_id % 50 = 0 THEN '' WHEN row_id % 50 = 1 THEN '$10.00 - $20.00'
            WHEN row_id % 50 = 2 THEN '$0.00'
            ELSE concat('$', {money:price}) END AS discounted_price,
       CASE WHEN row_id % 40 = 3 THEN 'no rating' WHEN row_id % 40 = 4 THEN '4.5.1'
            ELSE concat(cast(rating AS string), ' out of 5 stars') END AS rating,
       CASE WHEN row_id % 45 = 5 THEN '' ELSE {thousands:review_count * 1000} END AS review_count,
       CASE WHEN row_id % 3 = 0 THEN 'Yes' ELSE 'No' END AS is_prime,
       CASE row_id % 3 WHEN 0 THEN concat('/dp/', asin)
                       WHEN 1 THEN concat('https://www.amazon.com/dp/', asin)
                       ELSE '' END AS product_link,
       concat('https://img.example.com/', asin, '.jpg') AS image_url,
       concat('2001-12-0', cast(1 + row_id % 9 AS string), 'T02:00:00') AS scraped_at
FROM listing_rows""",
    "transfers": f"""
SELECT o_orderkey AS transfer_id,
       {_pick('o_custkey % 4', _CITY)} AS from_city,
       {_pick('(o_custkey + 1 + o_orderkey % 3) % 4', _CITY)} AS to_city,
       CASE o_orderkey % 7 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'LARGE' WHEN 2 THEN 'MEDIUM'
            WHEN 3 THEN 'PROMO' WHEN 4 THEN 'SMALL' WHEN 5 THEN 'STANDARD' ELSE NULL END AS category,
       1 + o_orderkey % 50 AS quantity
FROM orders""",
    "questions": f"""
SELECT conv_id, turn,
  CASE
   WHEN turn = 0 THEN CASE conv_id % 6
     WHEN 0 THEN concat('how many ', word, ' items in ', city)
     WHEN 1 THEN concat('How many ', word, ' items in ', misheard)
     WHEN 2 THEN concat('kaç adet ', word, ' ürün var')
     WHEN 3 THEN concat('list ', word, ' ', product, ' rating 4.', tenth, ' üstü fiyat ', amount, ' üzeri')
     WHEN 4 THEN concat('show me wireless headphones and kitap in ', city, ' price > ', amount)
     ELSE concat('total electronics earbuds stok ', units, ' üzeri in ', misheard) END
   WHEN turn % 3 = 1 THEN CASE conv_id % 6
     WHEN 0 THEN concat('show top ', few, ' of these')
     WHEN 1 THEN concat('listele ', few, ' tane')
     WHEN 2 THEN concat('sadece ', product, ' göster')
     WHEN 3 THEN concat('peki ', city, ' ', product, ' kaç tane')
     WHEN 4 THEN 'bunları göster en ucuz fiyat'
     ELSE concat('where should i go if ', city, ' has no stock') END
   WHEN turn % 3 = 2 THEN CASE conv_id % 5
     WHEN 0 THEN concat('in ', city, ' rating > 4.', tenth)
     WHEN 1 THEN concat('what about ', misheard)
     WHEN 2 THEN concat('compare ', city, ' and sydney total')
     WHEN 3 THEN concat('en yüksek rating uygun fiyat ', word, ' listele')
     ELSE concat('instead of ', city, ' recommend ', product) END
   ELSE CASE conv_id % 5
     WHEN 0 THEN concat('list all widget price > ', amount)
     WHEN 1 THEN concat('which product is cheapest in ', word)
     WHEN 2 THEN concat('transfer ', few, ' ', word, ' from ', city, ' to hobart')
     WHEN 3 THEN concat('stock > ', units, ' ', product, ' count')
     ELSE concat('en çok satan ', few, ' ürün ', word) END
  END AS text
FROM (SELECT conv_id, turn,
        {_pick('(conv_id + turn) % 4', _CITY_LOWER)} AS city,
        {_pick('(conv_id + turn) % 4', _MISHEARD)} AS misheard,
        {_pick('(conv_id * 7 + turn) % 6', _TYPES)} AS word,
        {_pick('(conv_id * 5 + turn) % 8', TABLE_PRODUCT_WORDS)} AS product,
        cast((conv_id + turn) % 9 AS string) AS tenth,
        cast(3 + (conv_id + turn) % 5 AS string) AS few,
        cast(1000 + (conv_id * 130 + turn * 290) % 3000 AS string) AS amount,
        cast(100 + (conv_id * 13 + turn * 29) % 300 AS string) AS units
      FROM conversations) q
UNION ALL SELECT conv_id + 1000000000 AS conv_id, turn, text FROM conversations""",
    "requests": f"""
SELECT c_custkey AS request_id,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE {_pick('c_custkey % 6', [t.upper() for t in _TYPES])} END AS category,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE {_pick('c_custkey % 4', _CITY)} END AS location,
       {_pick('(c_custkey + 1) % 4', _CITY)} AS excluded,
       CASE WHEN c_custkey % 4 = 0 THEN {_pick('(c_custkey / 4) % 8', TABLE_PRODUCT_WORDS).replace('(c_custkey / 4)', 'cast(floor(c_custkey / 4) AS bigint)')} ELSE NULL END AS keyword,
       CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE cast(30 + c_custkey % 19 AS double) / 10 END AS min_rating,
       CASE WHEN c_custkey % 3 = 1 THEN NULL ELSE 900 + 250 * (c_custkey % 17) END AS min_price,
       CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE 10 * (c_custkey % 23) END AS min_stock,
       3 + c_custkey % 8 AS n_rows,
       CASE WHEN c_custkey % 2 = 0 THEN 'add' ELSE 'subtract' END AS operation,
       c_custkey % 60 AS quantity
FROM customer""",
    "stock_by_site": """
SELECT warehouse_location, category, cast(sum(stock_quantity) AS bigint) AS units,
       count(*) AS item_count
FROM catalog GROUP BY warehouse_location, category""",
    "listing_runs": """
SELECT o_orderkey AS listing_id,
       concat(CASE WHEN o_orderkey % 10 < 4 THEN '20011101' WHEN o_orderkey % 10 < 7 THEN '20011125'
                   ELSE '20011130' END, '_020000') AS run_id,
       cast(round(o_totalprice * 100) AS bigint) AS price_cents
FROM orders""",
}

_SPARK = {"money": "format_number({}, 2)", "thousands": "format_number({}, 0)"}
_DUCK = {"money": "format('{{:,.2f}}', {})", "thousands": "format('{{:,}}', cast({} AS bigint))"}


def _render(text: str, dialect: dict[str, str]) -> str:
    def swap(m: re.Match) -> str:
        return dialect[m.group(1)].format(m.group(2))

    return re.sub(r"\{(money|thousands):([^}]*)\}", swap, text)


DUCK_VIEWS: dict[str, str] = {n: _render(t, _DUCK).strip() for n, t in _TEMPLATES.items()}
_SPARK_VIEWS: dict[str, str] = {n: _render(t, _SPARK).strip() for n, t in _TEMPLATES.items()}

_BASE = ["part", "lineitem", "orders", "customer", "conversations"]


def view(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The derived view ``name`` over the tables in ``root``."""
    text = _SPARK_VIEWS[name]
    inputs = {}
    for other in [*_SPARK_VIEWS, *_BASE]:
        pattern = rf"\b(FROM|JOIN) {other}\b"
        if other != name and re.search(pattern, text):
            text = re.sub(pattern, rf"\1 {{{other}}}", text)
            inputs[other] = table(spark, root, other) if other in _BASE else view(spark, root, other)
    return spark.sql(text, **inputs)


def products(spark: SparkSession, root: str) -> DataFrame:
    """Catalogue columns that need no sales facts."""
    return view(spark, root, "products")


def catalog(spark: SparkSession, root: str) -> DataFrame:
    return view(spark, root, "catalog")
