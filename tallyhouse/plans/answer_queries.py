"""Registered queries: answer texts per route, and all routes together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators import answers
from tallyhouse.plans.registry import query
from tallyhouse.plans.views import catalog, view

KINDS = ["recommendation", "count", "count", "comparison", "simulation", "transfer", "unknown"]
_KIND = "CASE request_id % 7 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
_TEXT = ("CASE WHEN request_id % 7 = 5 THEN 'transfer stock between sites' WHEN request_id % 7 = 2 THEN "
         "CASE WHEN request_id % 2 = 0 THEN concat('show me ', cast(n_rows AS string), ' items') ELSE 'list items' END ELSE 'how many items' END")


def asks(spark: SparkSession, root: str) -> DataFrame:
    """Requests with an intent each, as a language model would return them."""
    none = F.array().cast("array<string>")
    one = F.when(F.col("location").isNotNull(), F.array("location")).otherwise(none)
    two = F.when(F.col("location").isNotNull(), F.array("location", "excluded")).otherwise(none)
    plan = F.array(
        F.struct(F.col("location").alias("from_city"), F.col("excluded").alias("to_city"), "category", "quantity"),
        F.struct(F.col("excluded").alias("from_city"), F.lit("Sydney").alias("to_city"), "category",
                 (F.col("quantity") * 100).alias("quantity")))
    kind = F.expr(_KIND)
    return view(spark, root, "requests").select(
        "request_id", F.expr(_TEXT).alias("text"), kind.alias("intent"), "category", "operation", "quantity",
        F.when(kind == "comparison", two).otherwise(one).alias("locations"),
        F.when(F.col("request_id") % 2 == 0, F.col("excluded")).alias("excluded"),
        F.when(F.col("keyword").isNotNull(), F.array("keyword")).otherwise(none).alias("keywords"),
        F.when(kind == "transfer", plan).alias("transfers"))


_ASKS = f"""asks AS (SELECT request_id, {_TEXT} AS text, {_KIND} AS kind, category, operation, quantity, location, keyword,
  excluded AS other, CASE WHEN request_id % 2 = 0 THEN excluded END AS excluded, n_rows FROM requests)"""

COUNT = """
hit AS (SELECT a.request_id, a.category, a.location, a.text, c.*, row_number() OVER (PARTITION BY a.request_id ORDER BY c.row_id) AS k,
    count(c.asin) OVER (PARTITION BY a.request_id) AS n,
    try_cast(nullif(regexp_extract(a.text, '([0-9]+)', 1), '') AS bigint) AS lim
  FROM asks a LEFT JOIN (SELECT row_id, asin, product_name, price, rating, stock_quantity, category AS cat, warehouse_location FROM catalog) c
    ON (a.category IS NULL OR a.category = c.cat) AND (a.location IS NULL OR a.location = c.warehouse_location)
  WHERE a.kind = 'count'),
listed AS (SELECT request_id, any_value(text) AS text, max(n) AS n, max(lim) AS lim,
    coalesce(nullif(concat_ws(' + ', 'Category: ' || any_value(category), 'Locations: ' || any_value(location)), ''), 'All items') AS d,
    string_agg(concat(cast(k AS string), '. ', product_name, ' | $', printf('%.2f', price), ' | Stock:', cast(stock_quantity AS string),
       ' | ', printf('%.1f', rating)), chr(10) ORDER BY k) FILTER (WHERE k <= coalesce(lim, 10)) AS body FROM hit GROUP BY request_id),
count_answers AS (SELECT request_id, 'count' AS kind, CASE WHEN text = 'how many items' THEN concat('**', n, ' items** (', d, ')')
    WHEN n = 0 THEN 'No products found matching these criteria.'
    ELSE concat_ws(chr(10), CASE WHEN lim IS NULL THEN concat(d, ' - ', n, ' items:') ELSE concat('Top ', lim, ' Products (', d, '):') END, '', body,
      CASE WHEN lim IS NULL AND n > 10 THEN concat(chr(10), '... and ', n - 10, ' more items.') END) END AS answer FROM listed)"""

_SITES = "(VALUES ('Sydney', 1), ('Melbourne', 2), ('Brisbane', 3), ('Perth', 4)) AS v(site, pos)"
COMPARISON = f"""
sites AS (SELECT a.request_id, v.site, v.pos FROM asks a, {_SITES} WHERE a.kind = 'comparison' AND a.location IS NULL
  UNION ALL SELECT request_id, location, 1 FROM asks WHERE kind = 'comparison' AND location IS NOT NULL
  UNION ALL SELECT request_id, other, 2 FROM asks WHERE kind = 'comparison' AND location IS NOT NULL),
site_n AS (SELECT s.request_id, s.site, s.pos, count(c.asin) AS n FROM sites s JOIN asks a ON a.request_id = s.request_id
  LEFT JOIN catalog c ON c.warehouse_location = s.site AND (a.category IS NULL OR a.category = c.category)
    AND (a.keyword IS NULL OR contains(lower(c.product_name), a.keyword)) GROUP BY 1, 2, 3),
comparison_answers AS (SELECT a.request_id, 'comparison' AS kind, concat_ws(chr(10),
    CASE WHEN any_value(a.location) IS NULL THEN 'Breakdown by warehouse:' ELSE concat('Total items in ', any_value(a.location), ' and ', any_value(a.other), ':') END, '',
    string_agg(concat('• ', site, ': **', n, ' items**'), chr(10) ORDER BY pos), concat(chr(10), '**Total: ', sum(n), ' items**')) AS answer
  FROM site_n s JOIN asks a ON a.request_id = s.request_id GROUP BY a.request_id)"""

RECOMMENDATION = """
rec AS (SELECT a.request_id, c.warehouse_location AS site, cast(sum(c.stock_quantity) AS bigint) AS units, count(*) AS items
  FROM asks a JOIN catalog c ON (a.category IS NULL OR a.category = c.category) AND (a.keyword IS NULL OR contains(lower(c.product_name), a.keyword))
    AND (a.excluded IS NULL OR c.warehouse_location <> a.excluded) WHERE a.kind = 'recommendation' GROUP BY 1, 2),
rec_pos AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY units DESC, site) AS k FROM rec),
rec_ex AS (SELECT a.request_id, cast(coalesce(sum(c.stock_quantity), 0) AS bigint) AS left_units FROM asks a
  LEFT JOIN catalog c ON c.warehouse_location = a.excluded AND (a.category IS NULL OR a.category = c.category) WHERE a.kind = 'recommendation' GROUP BY 1),
rec_row AS (SELECT a.request_id, any_value(a.excluded) AS ex, any_value(e.left_units) AS lu, max(site) FILTER (WHERE k = 1) AS s1,
    max(units) FILTER (WHERE k = 1) AS u1, max(items) FILTER (WHERE k = 1) AS i1,
    string_agg(concat('   ', k - 1, '. ', site, ': ', units, ' units (', items, ' items)'), chr(10) ORDER BY k) FILTER (WHERE k BETWEEN 2 AND 3) AS rest
  FROM asks a JOIN rec_ex e ON e.request_id = a.request_id LEFT JOIN rec_pos p ON p.request_id = a.request_id GROUP BY a.request_id),
recommendation_answers AS (SELECT request_id, 'recommendation' AS kind, CASE WHEN s1 IS NULL THEN '⚠️ No stock found in any warehouse for this item.'
  ELSE concat_ws(chr(10), concat('✅ **Primary Recommendation: ', s1, '**'), concat('   - Stock Available: **', u1, ' units** (', i1, ' different items)'),
    '   - Reason: Highest inventory for this category', chr(10) || '📍 **Alternative Options:**' || chr(10) || rest,
    CASE WHEN ex IS NOT NULL AND lu = 0 THEN concat(chr(10), '⚠️ **Alert:** ', ex, ' is OUT OF STOCK for this category', chr(10),
      '💡 **Suggestion:** Transfer ', least(cast(floor(u1 / 2) AS bigint), 50), ' units from ', s1, ' to ', ex) END,
    CASE WHEN lu > 0 THEN concat(chr(10), 'ℹ️ ', ex, ' has ', lu, ' units (lower than ', s1, ')') END) END AS answer FROM rec_row)"""

SIMULATION = """
sim AS (SELECT a.request_id, a.operation, a.quantity AS q, a.location, a.category, count(c.asin) AS cur FROM asks a LEFT JOIN catalog c
  ON (a.category IS NULL OR a.category = c.category) AND (a.location IS NULL OR a.location = c.warehouse_location)
  WHERE a.kind = 'simulation' GROUP BY 1, 2, 3, 4, 5),
sim_s AS (SELECT *, CASE WHEN operation = 'subtract' THEN '-' ELSE '+' END AS sg FROM sim),
simulation_answers AS (SELECT request_id, 'simulation' AS kind, CASE
  WHEN q = 0 THEN '⚠️ I need to know the operation and quantity for simulation. Example: ''If I order 100 items from Sydney'''
  WHEN operation = 'subtract' AND q > cur THEN concat('⚠️ **Cannot remove ', q, ' items** - only **', cur, ' items** available!', chr(10), chr(10),
     '📍 Location: ', coalesce(location, 'All warehouses'), chr(10), '📦 Category: ', coalesce(category, 'All categories'))
  ELSE concat_ws(chr(10), concat('📊 **Simulation: ', CASE WHEN sg = '-' THEN 'Subtract' ELSE 'Add' END, ' ', q, ' items**'), '',
     concat('• Current total: **', cur, ' items**'),
     concat('• After ', CASE WHEN sg = '-' THEN 'removing' ELSE 'adding' END, ' ', q, ': **', CASE WHEN sg = '-' THEN cur - q ELSE cur + q END, ' items**'),
     concat('• Change: **', sg, q, ' items** ', CASE WHEN cur = 0 THEN '(new inventory)' ELSE concat('(', sg, printf('%.1f', q / cur * 100), '%)') END),
     chr(10) || '🏙️ Locations: ' || location, '📦 Category: ' || category) END AS answer FROM sim_s)"""

TRANSFER = """
steps AS (SELECT request_id, 1 AS i, location AS f, other AS t, category, quantity AS q FROM asks WHERE kind = 'transfer'
  UNION ALL SELECT request_id, 2, other, 'Sydney', category, quantity * 100 FROM asks WHERE kind = 'transfer'),
full_steps AS (SELECT *, (f IS NOT NULL AND t IS NOT NULL AND category IS NOT NULL AND q <> 0) AS ok FROM steps),
tplan AS (SELECT request_id, string_agg(CASE WHEN ok THEN concat('**Transfer ', i, ':** ', format('{:,}', q), ' ', category, chr(10),
     '  📤 From: ', f, ' → 📥 To: ', t, chr(10)) ELSE concat('⚠️ Transfer ', i, ': Missing information, skipped.') END, chr(10) ORDER BY i) AS plan
  FROM full_steps GROUP BY request_id),
tlegs AS (SELECT request_id, f AS site, category, -q AS d FROM full_steps WHERE ok UNION ALL SELECT request_id, t, category, q FROM full_steps WHERE ok),
tsum AS (SELECT l.request_id, l.site, l.category, cast(sum(d) AS bigint) AS d, any_value(coalesce(b.units, 0)) AS b FROM tlegs l
  LEFT JOIN stock_by_site b ON b.warehouse_location = l.site AND b.category = l.category GROUP BY 1, 2, 3),
tres AS (SELECT request_id, string_agg(concat('**', site, '** (', category, '):', chr(10), '  • Before: ', format('{:,}', b), ' units', chr(10),
    '  • After: **', format('{:,}', b + d), ' units** ', CASE WHEN d < 0 THEN '⬇️' WHEN d > 0 THEN '⬆️' ELSE '➡️' END, ' (',
    CASE WHEN d > 0 THEN '+' ELSE '' END, format('{:,}', d), ')', chr(10),
    CASE WHEN b + d < 0 THEN concat(chr(10), '  ⚠️ **WARNING:** Insufficient stock! Need ', format('{:,}', -(b + d)), ' more units.', chr(10)) ELSE '' END),
    chr(10) ORDER BY site, category) AS results FROM tsum GROUP BY request_id),
transfer_answers AS (SELECT p.request_id, 'transfer' AS kind, concat_ws(chr(10), '📦 **INVENTORY TRANSFER SIMULATION**' || chr(10), plan, '---',
    '📊 **RESULTS AFTER ALL TRANSFERS:**' || chr(10), results) AS answer FROM tplan p LEFT JOIN tres r ON r.request_id = p.request_id)"""

_ALL = {"count": COUNT, "comparison": COMPARISON, "recommendation": RECOMMENDATION, "simulation": SIMULATION, "transfer": TRANSFER}
_JOBS = {"count": answers.count_answers, "comparison": answers.comparison_answers,
         "recommendation": answers.recommendation_answers, "simulation": answers.simulation_answers,
         "transfer": answers.transfer_answers}


def _answers(kind: str) -> None:
    @query(f"answer_{kind}", f"WITH {_ASKS}, {_ALL[kind]} SELECT request_id, kind, answer FROM {kind}_answers")
    def _(spark, root):
        routed = answers.route(asks(spark, root))
        return _JOBS[kind](catalog(spark, root), routed.where(F.col("kind") == kind))


for _name in _ALL:
    _answers(_name)


@query("answer_all", f"""
WITH {_ASKS}, {", ".join(_ALL.values())}
{" UNION ALL ".join(f"SELECT request_id, kind, answer FROM {k}_answers" for k in _ALL)}
UNION ALL SELECT request_id, 'retrieval', NULL FROM asks WHERE kind = 'unknown'""")
def _(spark, root):
    return answers.answer_asks(catalog(spark, root), asks(spark, root))
