"""Answer texts for a table of questions with parsed intents.

``asks``: ``request_id, text, intent, category, locations, excluded, keywords,
operation, quantity`` and ``transfers`` (array of structs, may be NULL). Each
route is one table job; the routes are unioned. The line formats are fixed
values. Questions that need a language model get no text (route ``retrieval``);
an intent that is none of those known gets one that says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import questions as q
from tallyhouse.functions.render import list_row
from tallyhouse.functions.vocab import BREAKDOWN_ORDER, NOT_UNDERSTOOD
from tallyhouse.operators import planning
from tallyhouse.operators.requests import AXES, first_rows

LISTING_WORDS = ["show", "list", "display", "give me"]
DEFAULT_ROWS = 10


def text_of(*parts: Column | str | int) -> Column:
    """Concatenation; integers and columns are cast to text."""
    return F.concat(*[(p if isinstance(p, Column) else F.lit(str(p))).cast("string") for p in parts])


def lines(*parts: Column) -> Column:
    """Lines joined; NULL ones drop out."""
    return F.concat_ws("\n", *parts)


def route(asks: DataFrame) -> DataFrame:
    moves = q.is_transfer(F.lower("text")) & (F.size("transfers") > 0)
    known = F.col("intent").isin("recommendation", "simulation", "count", "comparison")
    searched = F.col("intent").isNull() | F.col("intent").isin("product_query", "unknown")
    kind = F.when(F.coalesce(moves, F.lit(False)), "transfer").when(known, F.col("intent")).when(searched, "retrieval")
    kind = kind.otherwise("not understood")
    return asks.withColumn("kind", kind)


def _unbounded(asks: DataFrame) -> DataFrame:
    """The bound columns a request has, all absent."""
    none = F.lit(None).cast("double")
    names = {c for _, above, below in AXES.values() for c in (above, below) if c} | {"stock_below"}
    return asks.withColumns({n: none for n in sorted(names)})


def count_answers(products: DataFrame, asks: DataFrame) -> DataFrame:
    """A count, or a list when the text asks for one or holds a number."""
    text = F.lower("text")
    asked = _unbounded(asks.withColumn("keywords", F.array().cast("array<string>"))).withColumns({
        "limit": F.nullif(q.first_number(text), F.lit(0)), "wants_list": q.contains_any(text, LISTING_WORDS)})
    asked = asked.withColumn("n_rows", F.coalesce("limit", F.lit(DEFAULT_ROWS)))
    counts = planning.count_rows(products, asked).withColumnRenamed("current", "n_matches")
    named = F.concat_ws(" + ", F.when(F.col("category") != "", text_of("Category: ", F.col("category"))),
                        F.when(F.size("locations") > 0, text_of("Locations: ", F.array_join("locations", ", "))))
    desc = F.coalesce(F.nullif(named, F.lit("")), F.lit("All items"))

    shown = first_rows(products, asked.where(F.col("wants_list") | F.col("limit").isNotNull()))
    rows = shown.select("request_id", F.posexplode("asins").alias("i", "asin")).join(
        products.select("asin", "product_name", "price", "stock_quantity", "rating"), "asin")
    listed = rows.select("request_id", "i", list_row(F.col("i") + 1).alias("line")).groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("i", "line"))).alias("rows"))

    n, limit = F.col("n_matches"), F.col("limit")
    title = F.when(limit.isNotNull(), text_of("Top ", limit, " Products (", desc, "):")).otherwise(
        text_of(desc, " - ", n, " items:"))
    more = F.when(limit.isNull() & (n > DEFAULT_ROWS), text_of("\n... and ", n - DEFAULT_ROWS, " more items."))
    body = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    as_list = F.when(n == 0, "No products found matching these criteria.").otherwise(
        lines(title, F.lit(""), body, more))
    as_count = text_of("**", n, " items** (", desc, ")")
    answer = F.when(F.col("wants_list") | limit.isNotNull(), as_list).otherwise(as_count)
    return asked.join(counts, "request_id").join(listed, "request_id", "left").select(
        "request_id", "kind", answer.alias("answer"))


def comparison_answers(products: DataFrame, asks: DataFrame) -> DataFrame:
    """Counts for the named sites (two or more), else for all."""
    asked = planning.with_keys(asks)
    joined = asked.join(planning.site_lists(products, asked), ["category_key", "keyword_key"], "left")
    named = F.size("locations") >= 2
    sites = F.when(named, F.col("locations")).otherwise(F.array(*[F.lit(s) for s in BREAKDOWN_ORDER]))
    counted = joined.withColumn("counts", F.transform(sites, lambda site: F.struct(
        site.alias("site"),
        F.coalesce(F.get(F.filter("sites", lambda s: s["site"] == site), F.lit(0))["item_count"], F.lit(0)).alias("n"))))
    title = F.when(named, text_of("Total items in ", F.array_join("locations", " and "), ":")).otherwise("Breakdown by warehouse:")
    each = F.array_join(F.transform("counts", lambda c: text_of("• ", c["site"], ": **", c["n"], " items**")), "\n")
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda acc, c: acc + c["n"])
    answer = lines(title, F.lit(""), each, text_of("\n**Total: ", total, " items**"))
    return counted.select("request_id", "kind", answer.alias("answer"))


def recommendation_answers(products: DataFrame, asks: DataFrame) -> DataFrame:
    ranked = planning.ranked_sites(products, asks)
    best, excluded, left = F.get("kept", 0), F.col("excluded"), F.col("excluded_units")
    others = F.transform(F.slice("kept", 2, 2), lambda s, i: text_of(
        "   ", i + 1, ". ", s["site"], ": ", s["units"], " units (", s["item_count"], " items)"))
    answer = lines(
        text_of("✅ **Primary Recommendation: ", best["site"], "**"),
        text_of("   - Stock Available: **", best["units"], " units** (", best["item_count"], " different items)"),
        F.lit("   - Reason: Highest inventory for this category"),
        F.when(F.size("kept") > 1, lines(F.lit("\n📍 **Alternative Options:**"), F.array_join(others, "\n"))),
        F.when(excluded.isNotNull() & (left == 0), lines(
            text_of("\n⚠️ **Alert:** ", excluded, " is OUT OF STOCK for this category"),
            text_of("💡 **Suggestion:** Transfer ", F.col("suggested_transfer"), " units from ", best["site"], " to ", excluded))),
        F.when(left > 0, text_of("\nℹ️ ", excluded, " has ", left, " units (lower than ", best["site"], ")")),
    )
    none = F.coalesce(F.size("kept"), F.lit(0)) <= 0
    return ranked.select("request_id", "kind", F.when(
        none, "⚠️ No stock found in any warehouse for this item.").otherwise(answer).alias("answer"))


def one_decimal(x: Column) -> Column:
    """Text with one decimal; a tie that is exact in binary goes to the even digit."""
    exact_tie = x * 4 == F.floor(x * 4)
    return F.format_string("%.1f", F.when(exact_tie, F.bround(x, 1)).otherwise(x))


def simulation_answers(products: DataFrame, asks: DataFrame) -> DataFrame:
    result = planning.project_adjustments(products, asks).select(
        "request_id", "current", "status", "after")
    joined = asks.join(result, "request_id")
    n, now, after, status = F.col("quantity"), F.col("current"), F.col("after"), F.col("status")
    places, category = F.array_join("locations", ", "), F.col("category")
    has_place, has_category = F.size("locations") > 0, F.coalesce(category != "", F.lit(False))
    sign = F.when(F.col("operation") == "subtract", "-").otherwise("+")
    verb = F.when(F.col("operation") == "subtract", "Subtract").otherwise("Add")
    doing = F.when(F.col("operation") == "subtract", "removing").otherwise("adding")
    percent = F.when(status == "new inventory", "(new inventory)").otherwise(
        text_of("(", sign, one_decimal(n / F.nullif(now, F.lit(0)) * 100), "%)"))
    done = lines(
        text_of("📊 **Simulation: ", verb, " ", n, " items**"), F.lit(""),
        text_of("• Current total: **", now, " items**"), text_of("• After ", doing, " ", n, ": **", after, " items**"),
        text_of("• Change: **", sign, n, " items** ", percent),
        F.when(has_place, text_of("\n🏙️ Locations: ", places)), F.when(has_category, text_of("📦 Category: ", category)))
    refused = lines(
        text_of("⚠️ **Cannot remove ", n, " items** - only **", now, " items** available!\n"),
        text_of("📍 Location: ", F.when(has_place, places).otherwise("All warehouses")),
        text_of("📦 Category: ", F.when(has_category, category).otherwise("All categories")))
    answer = (
        F.when(status == "incomplete", "⚠️ I need to know the operation and quantity for simulation. "
               "Example: 'If I order 100 items from Sydney'")
        .when(status == "not enough", refused)
        .when(status == "unsupported", "⚠️ Unsupported operation. Use 'add' or 'subtract'.")
        .otherwise(done))
    return joined.select("request_id", "kind", answer.alias("answer"))


def transfer_answers(products: DataFrame, asks: DataFrame) -> DataFrame:
    """The plan line by line, then units per (site, category) after all of it.

    Lists are per question, so their length is that of its own plan.
    """
    steps = asks.select("request_id", "kind", F.posexplode("transfers").alias("i", "t")).select(
        "request_id", "kind", "i", "t.*")

    def grouped(c: Column) -> Column:
        return F.format_number(c, 0)

    step = F.when(planning.complete_transfer(), lines(
        text_of("**Transfer ", F.col("i") + 1, ":** ", grouped(F.col("quantity")), " ", F.col("category")),
        text_of("  📤 From: ", F.col("from_city"), " → 📥 To: ", F.col("to_city")), F.lit("")),
    ).otherwise(text_of("⚠️ Transfer ", F.col("i") + 1, ": Missing information, skipped."))
    plan = steps.withColumn("line", step).groupBy("request_id", "kind").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("plan"))

    projected = planning.project_transfers(products, steps, "request_id")
    delta, after = F.col("delta"), F.col("units_after")
    arrow = F.when(delta < 0, "⬇️").when(delta > 0, "⬆️").otherwise("➡️")
    change = F.when(delta > 0, text_of("+", grouped(delta))).otherwise(grouped(delta))
    line = lines(
        text_of("**", F.col("warehouse_location"), "** (", F.col("category"), "):"),
        text_of("  • Before: ", grouped(F.col("units_before")), " units"),
        text_of("  • After: **", grouped(after), " units** ", arrow, " (", change, ")"), F.lit(""),
        F.when(F.col("shortage"), lines(text_of(
            "  ⚠️ **WARNING:** Insufficient stock! Need ", grouped(F.col("missing_units")), " more units."), F.lit(""))))
    results = projected.withColumn("line", line).groupBy("request_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("warehouse_location", "category", "line"))), lambda x: x["line"]), "\n").alias("results"))
    answer = lines(F.lit("📦 **INVENTORY TRANSFER SIMULATION**\n"), F.col("plan"), F.lit("---"),
                   F.lit("📊 **RESULTS AFTER ALL TRANSFERS:**\n"), F.col("results"))
    return plan.join(results, "request_id", "left").select("request_id", "kind", answer.alias("answer"))


def answer_asks(products: DataFrame, asks: DataFrame) -> DataFrame:
    """One answer per question: ``request_id, kind, answer``."""
    routed = route(asks)

    def of(kind: str) -> DataFrame:
        return routed.where(F.col("kind") == kind)

    text = F.when(F.col("kind") == "not understood", NOT_UNDERSTOOD)
    out = routed.where(F.col("kind").isin("retrieval", "not understood")).select("request_id", "kind", text.alias("answer"))
    for kind, job in (("count", count_answers), ("comparison", comparison_answers),
                      ("recommendation", recommendation_answers), ("simulation", simulation_answers),
                      ("transfer", transfer_answers)):
        out = out.unionByName(job(products, of(kind)))
    return out
