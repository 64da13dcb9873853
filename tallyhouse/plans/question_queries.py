"""Registered queries: reading questions and carrying their context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions import questions as q
from tallyhouse.functions import vocab
from tallyhouse.operators import context as ctx
from tallyhouse.plans import question_sql as s
from tallyhouse.plans.registry import query
from tallyhouse.plans.views import catalog, view
from tallyhouse.sources.tables import table


def asked(spark: SparkSession, root: str) -> DataFrame:
    return view(spark, root, "questions").withColumn("norm", q.normalize_text(F.col("text")))


def _ask(name: str, sql: str, **columns) -> None:
    """Query of one or more expressions over the normalised text."""
    @query(name, s.ask(sql))
    def _(spark, root):
        built = {n: fn(F.col("norm")) for n, fn in columns.items()}
        return asked(spark, root).select("conv_id", "turn", *[c.alias(n) for n, c in built.items()])


_ask("normalize_text", "norm AS normalized", normalized=lambda t: t)
_ask("extract_locations", f"{s.LOCATIONS} AS locations, {s.FIRST_LOCATION} AS first_location",
     locations=lambda t: F.concat_ws(",", q.extract_locations(t)),
     first_location=lambda t: F.get(q.extract_locations(t), 0))
_ask("map_category", f"{s.category()} AS category", category=lambda t: q.map_category(t, s.CATEGORIES))
_ask("map_category_substring", f"{s.category(s.anywhere)} AS category",
     category=lambda t: q.map_category(t, s.CATEGORIES, whole=False))
_ask("extract_keywords", f"{s.present(s.WORDS, s.whole)} AS keywords",
     keywords=lambda t: F.concat_ws(",", q.found_in_order(t, s.WORDS)))
_ask("extract_keywords_substring", f"{s.present(s.WORDS, s.anywhere)} AS keywords",
     keywords=lambda t: F.concat_ws(",", q.found_in_order(t, s.WORDS, whole=False)))
_ask("extract_rating_bound", f"{s.RATING} AS rating_above", rating_above=lambda t: q.number(t, vocab.RATING_PATTERNS))
_ask("extract_price_bound",
     f"{s.PRICE} AS price_above, {s.number([vocab.COUNT_PRICE_PATTERN])} AS price_value, "
     f"CASE WHEN {s.anywhere(vocab.ABOVE_WORDS)} THEN 'above' WHEN {s.anywhere(vocab.BELOW_WORDS)} THEN 'below' END AS direction",
     price_above=lambda t: q.number(t, vocab.PRICE_PATTERNS),
     price_value=lambda t: q.number(t, [vocab.COUNT_PRICE_PATTERN]), direction=q.direction)
_ask("extract_stock_bound",
     f"{s.STOCK} AS stock_above, {s.number([vocab.COUNT_STOCK_PATTERN])} AS stock_value, "
     f"array_to_string(list_transform(list_filter(regexp_extract_all(norm, {s.lit(vocab.NUM)}, 1), lambda x: cast(x AS double) > 10), "
     "lambda x: cast(round(cast(x AS double)) AS bigint)), ',') AS large_numbers",
     stock_above=lambda t: q.number(t, vocab.STOCK_PATTERNS),
     stock_value=lambda t: q.number(t, [vocab.COUNT_STOCK_PATTERN]),
     large_numbers=lambda t: F.concat_ws(",", F.transform(q.large_numbers(t), lambda x: F.round(x).cast("long").cast("string"))))
_ask("extract_limit", f"{s.LIMIT} AS n_asked, cast({s.number(['([0-9]+)'])} AS bigint) AS first_number",
     n_asked=q.extract_limit, first_number=q.first_number)
_ask("extract_sort", f"{s.SORT} AS sort_by", sort_by=q.extract_sort)


def has_filter(t):
    return (
        (F.size(q.extract_locations(t)) > 0) | q.map_category(t, s.CATEGORIES).isNotNull() | q.has_word(t, s.WORDS)
        | q.number(t, vocab.RATING_PATTERNS).isNotNull() | q.number(t, vocab.PRICE_PATTERNS).isNotNull()
        | q.number(t, vocab.STOCK_PATTERNS).isNotNull())


_ask("classify_output", f"{s.OUTPUT} AS output",
     output=lambda t: q.classify_output(t, q.extract_limit(t).isNotNull(), has_filter(t)))
_ask("route_intent", f"{s.ROUTE} AS route", route=lambda t: q.route_intent(t, s.WORDS))
_ask("extract_exclusion", f"{s.EXCLUSION} AS excluded", excluded=q.extract_exclusion)
_ask("multi_location_detect", f"{s.MULTI} AS is_breakdown, {s.BREAKDOWN_LOCATIONS} AS locations", is_breakdown=q.multi_location,
     locations=lambda t: F.concat_ws(",", q.extract_locations(t, vocab.BREAKDOWN_ORDER)))
_ask("detect_pointer", f"{s.POINTER} AS is_pointer", is_pointer=lambda t: q.is_pointer(t, s.WORDS))


@query("category_word_match", f"""
WITH {s.NORM}, c AS (SELECT category, min(row_id) AS first_row FROM products WHERE category IS NOT NULL GROUP BY category),
hit AS (SELECT n.conv_id, n.turn, c.category, row_number() OVER (PARTITION BY n.conv_id, n.turn ORDER BY c.first_row) AS r
        FROM n, c WHERE contains(n.norm, lower(c.category))
          OR len(list_filter(string_split(lower(c.category), ' '), lambda w: w <> '' AND contains(n.norm, w))) > 0)
SELECT conv_id, turn, category FROM hit WHERE r = 1""")
def _(spark, root):
    return ctx.category_named(asked(spark, root), view(spark, root, "products"))


def _context(spark, root):
    return ctx.carry_context(view(spark, root, "questions"), s.CATEGORIES, s.WORDS)


@query("context_carry", s.CONTEXT + " SELECT conv_id, turn, route, category, location, words FROM ctx")
def _(spark, root):
    return _context(spark, root).select("conv_id", "turn", "route", "category", "location", "words")


@query("detect_follow_up", s.CONTEXT + """
SELECT conv_id, turn, wording OR (short AND coalesce(lag(category IS NOT NULL OR location IS NOT NULL OR words <> 0)
  OVER (PARTITION BY conv_id ORDER BY turn), false)) AS is_follow_up FROM ctx""")
def _(spark, root):
    return ctx.with_follow_up(_context(spark, root)).select("conv_id", "turn", "is_follow_up")


@query("merge_keywords", s.CONTEXT + ", list AS (SELECT conv_id, turn, unnest([" + ", ".join(
    f"CASE WHEN words & {1 << i} <> 0 THEN {s.lit(w)} END" for i, w in enumerate(s.WORDS)) + """]) AS word FROM ctx)
SELECT conv_id, turn, string_agg(word, ',' ORDER BY word) AS keywords FROM list WHERE word IS NOT NULL GROUP BY conv_id, turn""")
def _(spark, root):
    words = F.array_sort(ctx.mask_words(F.col("words"), s.WORDS))
    rows = _context(spark, root).where("words <> 0")
    return rows.select("conv_id", "turn", F.concat_ws(",", words).alias("keywords"))


# --- speakable text --------------------------------------------------------

def _drop(col: str, parts) -> str:
    for p in parts:
        col = f"replace({col}, {s.lit(p)}, '')"
    return col


def _marked(spark, root):
    """Whole documents with markup around them, the shape of an answer."""
    docs = table(spark, root, "documents")
    return docs.select("doc_id", F.concat(
        F.lit("## **Result**: *"), F.col("lang"), F.lit("* | $12 | N/A | `x` 📦 [site](http://a.b) --- ⭐ ⚠️\n"),
        F.col("text")).alias("text"))


_MARKED = """SELECT doc_id, concat('## **Result**: *', lang, '* | $12 | N/A | `x` 📦 [site](http://a.b) --- ⭐ ⚠️
', text) AS text FROM documents"""
_RT = "regexp_replace(regexp_replace(substr(text, 1, 600), '\\*\\*([^*]+)\\*\\*', '\\1', 'g'), '\\*([^*]+)\\*', '\\1', 'g')"
_RT = _drop(_RT, ["*", "#", "`", *vocab.SPOKEN_SYMBOLS])
_RT = f"trim(regexp_replace(replace(replace({_RT}, '$', ' dollars '), 'N/A', 'not available'), '[ \\t\\r\\n\\f]+', ' ', 'g'))"
_AS = _drop(f"replace({_drop('text', ['*', '#'])}, '|', ' ')", ["---", "```", "📊", "📋", "💡"])
_AS = _drop(f"replace(replace({_AS}, '⭐', ' yıldız '), '⚠️', ' uyarı ')", ["🏆", "📈", "🔊", "💰", "📦"])
_AS = f"regexp_replace({_AS}, '\\n+', '. ', 'g')"
_AS = f"trim(regexp_replace(regexp_replace({_AS}, '[ \\t\\r\\n\\f]+', ' ', 'g'), '[.]+', '.', 'g'))"
_AS = f"replace(replace({_AS}, '$', ' dolar '), 'N/A', 'bilgi yok')"
_SI = _drop("text", ["*", "#", "|", "---"])
_BR = f"regexp_replace({_drop('text', ['*'])}, '#{{1,6}}[ \\t\\r\\n\\f]', '', 'g')"
_BR = f"regexp_replace(regexp_replace({_BR}, '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '`([^`]+)`', '\\1', 'g')"
_BR = _drop(_BR, ["---", "|"])
_STRIP = {
    "realtime": _RT,
    "assistant": f"CASE WHEN length({_AS}) > 500 THEN concat(substr({_AS}, 1, 500), '... ve daha fazlası.') ELSE {_AS} END",
    "simple": f"CASE WHEN length({_SI}) > 800 THEN concat(substr({_SI}, 1, 800), '...') ELSE {_SI} END",
    "browser": _BR,
}


def _strip(name: str, variant: str) -> None:
    @query(name, f"WITH d AS ({_MARKED}) SELECT doc_id, {_STRIP[variant]} AS spoken FROM d")
    def _(spark, root):
        return _marked(spark, root).select("doc_id", q.strip_markup(F.col("text"), variant).alias("spoken"))


_strip("strip_markup", "realtime")
_strip("strip_markup_assistant", "assistant")
_strip("strip_markup_simple", "simple")
_strip("strip_markup_browser", "browser")

_ANSWER = " ".join(f"WHEN {s.anywhere(w, 'lower(text)')} THEN {s.lit(c)}" for c, w in vocab.ANSWER_WORDS.items())


@query("detect_answer_category", f"SELECT conv_id, turn, CASE {_ANSWER} END AS category FROM conversations")
def _(spark, root):
    rows = table(spark, root, "conversations")
    return rows.select("conv_id", "turn", q.answer_category(F.col("text")).alias("category"))
