"""Field extraction from stored web pages (fetching them is not our job)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.vocab import CRAWL_TARGET, LINK_HOST
from tallyhouse.operators.ordered import with_running
from tallyhouse.sources.workspace import materialize


def first_group(text: Column, pattern: str) -> Column:
    """First capture group, NULL when there is no match or it is empty."""
    return F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))


def plain_text(html: Column) -> Column:
    """Markup to spaces, white space squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), "[ \\t\\r\\n]+", " "))


def extract_pages(pages: DataFrame) -> DataFrame:
    """Title (heading as fallback), heading, language, article text, links."""
    html = F.col("html")
    title = first_group(html, "<title>([^<]*)</title>")
    heading = first_group(html, "<h1>([^<]*)</h1>")
    article = plain_text(F.regexp_extract(html, "(?s)<article>(.*)</article>", 1))
    return pages.select(
        "page_id", "url",
        F.coalesce(title, heading, F.lit("")).alias("title"),
        F.coalesce(heading, F.lit("")).alias("heading"),
        F.coalesce(first_group(html, '<html lang="([a-z]+)"'), F.lit("")).alias("lang"),
        article.alias("article"),
        F.size(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))).alias("n_links"),
    )


def absolute_link(href: Column, host: Column) -> Column:
    """Absolute links as they are; others below the host."""
    return F.when(F.startswith(href, F.lit("http")), href).otherwise(F.concat(host, href))


def link_array(url: Column, html: Column) -> Column:
    """All links of a page, absolute, in page order."""
    host = F.regexp_extract(url, "^(https?://[^/?#]+)", 1)
    hrefs = F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))
    return F.transform(hrefs, lambda href: absolute_link(href, host))


def page_links(pages: DataFrame) -> DataFrame:
    """One row per link, in page order."""
    return pages.select("page_id", F.posexplode(link_array(F.col("url"), F.col("html"))).alias("pos", "link"))


def first_of_each(items: Column, value: Callable[[Column], Column]) -> Column:
    """``(value, pos, item)`` of the first item with each value other than '', in page order.

    Items are sorted by value and place, neighbours compared, and the firsts
    put back in order: no item is searched for in the whole array.
    """
    placed = F.array_sort(F.transform(items, lambda x, i: F.struct(value(x).alias("value"), i.alias("pos"), x.alias("item"))))
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform(placed, lambda x: x["value"]))
    paired = F.zip_with(placed, before, lambda own, earlier: F.struct(own.alias("own"), earlier.alias("earlier")))
    firsts = F.filter(paired, lambda p: (p["own"]["value"] != "") & ~p["own"]["value"].eqNullSafe(p["earlier"]))
    return F.array_sort(F.transform(firsts, lambda p: F.struct(p["own"]["pos"].alias("pos"), p["own"]["value"].alias("value"), p["own"]["item"].alias("item"))))


def distinct_links(pages: DataFrame) -> DataFrame:
    """First occurrence of each link of a page.

    A page is one row, so this needs no shuffle.
    """
    linked = pages.select("page_id", link_array(F.col("url"), F.col("html")).alias("links"))
    once = linked.select("page_id", F.explode(first_of_each(F.col("links"), lambda x: x)).alias("x"))
    return once.select("page_id", F.col("x.pos").alias("pos"), F.col("x.item").alias("link"))


# --- listing pages ---------------------------------------------------------

# One product card; the quoted class names are those of the listing markup.
CARD = '<div data-asin='
NAME = '<span><div[^>]*>([^<]*)</div></span>'
LABEL = 'class="a-link-normal"[^>]*aria-label="([^"]*)"'
FIELDS = {
    "rank": 'class="(?:zg-bdg-text|zg-badge-text|a-badge-text)">([^<]*)<',
    "discounted_price": 'class="(?:p13n-sc-price|a-color-price|a-offscreen)">([^<]*)<',
    "rating": 'class="a-icon-alt">([^<]*)<',
    "review_count": 'class="a-size-small">([^<]*)<',
    "image_url": '<img[^>]*src="([^"]*)"',
}


def extract_listings(pages: DataFrame) -> DataFrame:
    """Product rows from listing pages (``page_no, category, scraped_at, html``).

    Cards without an id are skipped and an id counts once per page. A missing
    field is the empty string, a missing link is built from the id.
    """
    def id_of(card: Column) -> Column:
        return F.regexp_extract(card, '^"([^"]*)"', 1)

    card = F.col("card")
    split = pages.select("page_no", "category", "scraped_at", F.split("html", CARD).alias("parts"))
    # What stands before the first card is none; the ids are worked out per page, before the cards become rows: no shuffle.
    cards = F.slice(F.col("parts"), 2, F.greatest(F.size("parts") - 1, F.lit(0)))
    rows = split.select("page_no", "category", "scraped_at", F.explode(first_of_each(cards, id_of)).alias("x")).select(
        "page_no", "category", "scraped_at", F.col("x.item").alias("card"), F.col("x.value").alias("product_id"))
    href = first_group(card, 'class="a-link-normal"[^>]*href="([^"]*/dp/[^"]*)"')
    link = F.coalesce(absolute_link(href, F.lit(LINK_HOST)), F.concat(F.lit(f"{LINK_HOST}/dp/"), F.col("product_id")))
    fields = {n: F.coalesce(first_group(card, p), F.lit("")) for n, p in FIELDS.items()}
    return rows.select(
        "product_id",
        F.coalesce(first_group(card, NAME), first_group(card, LABEL), F.lit("")).alias("product_name"),
        "category", *[c.alias(n) for n, c in fields.items()],
        F.when(F.contains(card, F.lit("a-icon-prime")), "Yes").otherwise("No").alias("is_prime"),
        link.alias("product_link"), "scraped_at")


def until_first_gap(pages: DataFrame, group: str = "category", page: str = "page_num", rows: str = "n_rows") -> DataFrame:
    """Pages 1..n of each group, up to the first empty or missing page.

    A page whose successor has no rows ends its group; the smallest such page
    is found by an equi-join and a minimum, without ordering a group.
    """
    filled = pages.where(F.col(rows) > 0)
    present = filled.select(group, page).distinct()
    following = present.select(group, (F.col(page) - 1).alias(page))
    last = present.join(following, [group, page], "left_anti").groupBy(group).agg(F.min(page).alias("_last"))
    started = present.where(F.col(page) == 1).select(group)
    return filled.join(last, group).where(F.col(page) <= F.col("_last")).join(started, group, "left_semi").drop("_last")


def quota_groups(rows: DataFrame, order: str, target: int = CRAWL_TARGET, group: str = "category", ranges: int | None = None) -> DataFrame:
    """Groups in order while the total before them is below the target.

    The running total goes over one row per group, in ranges of the order, so
    any number of groups is shared out over tasks.
    """
    counts = rows.groupBy(group).agg(F.count("*").alias("n"), F.min(order).alias("_order"))
    taken = with_running(counts, ["_order", group], {"before": F.col("n")}, ranges)
    return taken.where(F.col("before") < target).select(group, "n", "before")


def apply_quota(rows: DataFrame, order: str, target: int = CRAWL_TARGET, group: str = "category") -> DataFrame:
    kept = materialize(quota_groups(rows, order, target, group).select(group), "quota")
    return rows.join(kept, group, "left_semi")
