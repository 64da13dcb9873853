"""Registered queries: documents, chunks, neighbours and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.vocab import LINK_HOST
from tallyhouse.operators import alternatives as alt
from tallyhouse.operators import enrichment as enrich
from tallyhouse.operators import retrieval as rt
from tallyhouse.plans.alternatives_queries import HIGHER_SQL, SIMILAR_SQL
from tallyhouse.plans.registry import query
from tallyhouse.plans.views import catalog, view
from tallyhouse.sources import pages as pg
from tallyhouse.sources.tables import table


def full_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Catalogue with satisfaction levels and alternatives."""
    return alt.add_alternatives(enrich.satisfaction_columns(catalog(spark, root)))


_LEVEL = """CASE WHEN rating > 0 AND rating <= 4.0 THEN 'Poor' WHEN rating > 4.0 AND rating <= 4.3 THEN 'Average'
  WHEN rating > 4.3 AND rating <= 4.6 THEN 'Good' WHEN rating > 4.6 AND rating <= 5.1 THEN 'Excellent' END"""
DOCUMENTS_SQL = f"""s AS ({SIMILAR_SQL}), h AS ({HIGHER_SQL}), docs AS (
SELECT c.asin AS doc_id, concat_ws(chr(10), concat('Product: ', c.product_name), concat('ASIN: ', c.asin),
  concat('Category: ', c.category), concat('Price: $', printf('%.2f', c.price)),
  concat('Rating: ', cast(c.rating AS string), '/5 stars (', cast(c.review_count AS string), ' reviews)'),
  concat('Stock: ', cast(c.stock_quantity AS string), ' units in ', c.warehouse_location, ' warehouse'),
  concat('Satisfaction: ', {_LEVEL}), concat('Minimum Stock Threshold: ', cast(c.minimum_stock_threshold AS string)),
  CASE WHEN c.stock_quantity < c.minimum_stock_threshold THEN concat('⚠️ LOW STOCK ALERT: Below minimum threshold of ', cast(c.minimum_stock_threshold AS string)) END,
  CASE WHEN c.stock_quantity < c.minimum_stock_threshold THEN concat('Restock Date: ', cast(c.restock_date AS string)) END,
  CASE WHEN s.similar_price_alternatives <> '' THEN concat('Similar Price Alternatives (ASINs): ', s.similar_price_alternatives) END,
  CASE WHEN h.higher_rated_alternatives <> '' THEN concat('Higher Rated Alternatives (ASINs): ', h.higher_rated_alternatives) END) AS content,
  c.category, c.price, c.rating, c.stock_quantity, c.warehouse_location
FROM catalog c LEFT JOIN s ON s.asin = c.asin LEFT JOIN h ON h.asin = c.asin)"""


@query("document_content", f"WITH {DOCUMENTS_SQL} SELECT doc_id, content FROM docs")
def _(spark, root):
    return rt.build_documents(full_catalog(spark, root)).select("doc_id", "content")


@query("build_documents", f"""WITH {DOCUMENTS_SQL}
SELECT doc_id, content, category, price, rating, stock_quantity, warehouse_location FROM docs""")
def _(spark, root):
    m = [F.col(f"metadata.{c}") for c in ("category", "price", "rating", "stock_quantity", "warehouse_location")]
    return rt.build_documents(full_catalog(spark, root)).select("doc_id", "content", *m)


@query("chunk_documents", """
SELECT doc_id, lang, source, cast(i AS int) AS chunk_no, substr(text, cast(i * 900 + 1 AS bigint), 1000) AS chunk
FROM (SELECT doc_id, lang, source, text,
        unnest(range(0, greatest(cast(ceil((length(text) - 100) / 900.0) AS bigint), 1))) AS i
      FROM documents WHERE length(text) > 0) d""")
def _(spark, root):
    docs = table(spark, root, "documents").select("doc_id", "lang", "source", "text")
    return rt.chunk_documents(docs, "doc_id", "text")


_NEAR = """SELECT query_id, vec_id, position, distance FROM (
  SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS position FROM (
    SELECT q.vec_id AS query_id, e.vec_id, round(list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS distance
    FROM embeddings q, embeddings e) d) r WHERE position <= 10"""


def neighbours(spark: SparkSession, root: str) -> DataFrame:
    vectors = table(spark, root, "embeddings").select("vec_id", "embedding")
    return rt.nearest(vectors, vectors)


@query("knn_topk", f"{_NEAR}")
def _(spark, root):
    return neighbours(spark, root).select("query_id", "position", "distance", "vec_id")


@query("knn_join", f"""WITH near AS ({_NEAR})
SELECT n.query_id, n.position, n.vec_id, q.label AS query_label, e.label AS label
FROM near n JOIN embeddings q ON q.vec_id = n.query_id JOIN embeddings e ON e.vec_id = n.vec_id""")
def _(spark, root):
    labels = table(spark, root, "embeddings").select("vec_id", "label")
    own = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    near = neighbours(spark, root).select("query_id", "position", "vec_id")
    return near.join(labels, "vec_id").join(own, "query_id")


@query("assemble_context", f"""WITH near AS ({_NEAR})
SELECT n.query_id, string_agg(d.text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n.position) AS context
FROM near n JOIN documents d ON d.doc_id = n.vec_id GROUP BY n.query_id""")
def _(spark, root):
    return rt.assemble_context(neighbours(spark, root), table(spark, root, "documents"))


# --- pages -----------------------------------------------------------------

@query("extract_pages", """
SELECT page_id, url, coalesce(nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), ''),
    nullif(trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)), ''), '') AS title,
  coalesce(nullif(trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)), ''), '') AS heading,
  regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang,
  trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS article,
  cast(len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS int) AS n_links
FROM pages""")
def _(spark, root):
    return pg.extract_pages(table(spark, root, "pages"))


_LINKS = """links AS (SELECT page_id, unnest(range(0, len(hrefs))) AS pos, unnest(hrefs) AS href, host FROM (
  SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hrefs, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS host FROM pages) p),
resolved AS (SELECT page_id, cast(pos AS int) AS pos, CASE WHEN href LIKE 'http%' THEN href ELSE concat(host, href) END AS link FROM links)"""


@query("resolve_links", f"WITH {_LINKS} SELECT page_id, pos, link FROM resolved")
def _(spark, root):
    return pg.page_links(table(spark, root, "pages"))


@query("page_dedupe", f"""WITH {_LINKS} SELECT page_id, link, min(pos) AS pos FROM resolved WHERE link <> '' GROUP BY page_id, link""")
def _(spark, root):
    return pg.distinct_links(table(spark, root, "pages"))


def listing_pages(spark: SparkSession, root: str) -> DataFrame:
    """Listing markup rendered from the raw listings, 40 cards to a page.

    Every tenth card names the product only in the link label, and each page
    repeats its first card and ends with one that has no id.
    """
    raw = view(spark, root, "raw_listings")
    label = F.when(F.col("row_id") % 10 == 0, F.concat(F.lit(' aria-label="'), "product_name", F.lit('"'))).otherwise("")
    name = F.when(F.col("row_id") % 10 == 0, "").otherwise(F.concat(F.lit("<span><div>"), "product_name", F.lit("</div></span>")))
    href = F.when(F.col("product_link") == "", "").otherwise(F.concat(F.lit(' href="'), "product_link", F.lit('"')))

    def span(css: str, column: str):
        return F.when(F.col(column) == "", "").otherwise(F.concat(F.lit(f'<span class="{css}">'), column, F.lit("</span>")))

    card = F.concat(
        F.lit('<div data-asin="'), "product_id", F.lit('">'), span("zg-bdg-text", "rank"),
        F.lit('<a class="a-link-normal"'), label, href, F.lit(">"), name, F.lit("</a>"),
        span("p13n-sc-price", "discounted_price"), span("a-icon-alt", "rating"), span("a-size-small", "review_count"),
        F.lit('<img class="a-dynamic-image" src="'), "image_url", F.lit('"/>'),
        F.when(F.col("is_prime") == "Yes", '<i class="a-icon-prime"></i>').otherwise(""), F.lit("</div>"))
    keyed = raw.select(F.floor(F.col("row_id") / 40).alias("block"), "category", "scraped_at", "row_id", card.alias("card"))
    cards = F.transform(F.array_sort(F.collect_list(F.struct("row_id", "card"))), lambda x: x["card"])
    body = F.concat_ws("\n", F.flatten(F.array("cards", F.slice("cards", 1, 1))))
    grouped = keyed.groupBy("block", "category", "scraped_at").agg(cards.alias("cards"))
    return grouped.select(
        F.concat_ws("/", "block", "category", "scraped_at").alias("page_no"), "category", "scraped_at",
        F.concat(F.lit("<ol>\n"), body, F.lit('\n<div data-asin=""></div></ol>')).alias("html"))


@query("extract_listings", f"""
SELECT product_id, product_name, category, rank, discounted_price, rating, review_count, is_prime,
  CASE WHEN product_link = '' THEN concat('{LINK_HOST}/dp/', product_id)
       WHEN product_link LIKE 'http%' THEN product_link ELSE concat('{LINK_HOST}', product_link) END AS product_link,
  image_url, scraped_at FROM raw_listings""")
def _(spark, root):
    return pg.extract_listings(listing_pages(spark, root))


@query("page_sequence_stop", """
WITH p AS (SELECT category, cast(floor(row_id / 10) AS bigint) + 1 AS page_num, count(*) AS n_rows FROM products GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY page_num) AS k FROM p)
SELECT category, page_num, n_rows FROM r WHERE page_num = k""")
def _(spark, root):
    page = F.floor(F.col("row_id") / 10) + 1
    pages = view(spark, root, "products").groupBy("category", page.alias("page_num")).agg(F.count("*").alias("n_rows"))
    return pg.until_first_gap(pages)


@query("quota_cutoff", """
WITH n AS (SELECT category, count(*) AS n, min(row_id) AS o FROM raw_listings GROUP BY category),
b AS (SELECT category, coalesce(sum(n) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
SELECT row_id, product_id, category FROM raw_listings WHERE category IN (SELECT category FROM b WHERE before < 1000)""")
def _(spark, root):
    rows = view(spark, root, "raw_listings").select("row_id", "product_id", "category")
    return pg.apply_quota(rows, "row_id", 1000)
