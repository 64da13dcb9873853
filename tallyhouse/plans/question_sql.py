"""SQL twins of the question functions (DuckDB dialect)."""

from __future__ import annotations

from tallyhouse.functions import questions as q
from tallyhouse.functions import vocab
from tallyhouse.plans.views import TABLE_CATEGORIES, TABLE_PRODUCT_WORDS

CATEGORIES = {**vocab.CATEGORY_WORDS, **TABLE_CATEGORIES}
WORDS = vocab.PRODUCT_WORDS + TABLE_PRODUCT_WORDS


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(pattern: str, col: str = "norm") -> str:
    return f"coalesce(regexp_matches({col}, {lit(pattern)}), false)"


def whole(words: list[str], col: str = "norm") -> str:
    return rx(q.word_pattern(words), col)


def anywhere(words: list[str], col: str = "norm") -> str:
    return "(" + " OR ".join(f"contains({col}, {lit(w)})" for w in words) + ")"


def normalized(col: str) -> str:
    out = f"lower({col})"
    for place, variants in vocab.PLACE_VARIANTS.items():
        for _ in range(2):
            out = f"regexp_replace({out}, {lit(q.word_pattern(variants))}, '\\1{place}\\3', 'g')"
    return out


def category(test=whole, words=CATEGORIES) -> str:
    arms = " ".join(f"WHEN {test([w])} THEN {lit(c)}" for w, c in words.items())
    return f"CASE {arms} END"


def present(words: list[str], test) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {test([w])} THEN {lit(w)} END" for w in words) + ")"


def _named(sites: list[str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN contains(norm, {lit(w.lower())}) THEN {lit(w)} END" for w in sites) + ")"


LOCATIONS, BREAKDOWN_LOCATIONS = _named(vocab.WAREHOUSES), _named(vocab.BREAKDOWN_ORDER)
FIRST_LOCATION = "CASE " + " ".join(
    f"WHEN contains(norm, {lit(w.lower())}) THEN {lit(w)}" for w in vocab.WAREHOUSES) + " END"
HAS_SITE = anywhere([w.lower() for w in vocab.WAREHOUSES])


def number(patterns: list[str]) -> str:
    parts = ", ".join(f"nullif(regexp_extract(norm, {lit(p)}, 1), '')" for p in patterns)
    return f"try_cast(coalesce({parts}) AS double)"


_SITES = f"(?:{'|'.join(w.lower() for w in vocab.BREAKDOWN_ORDER)})"
MULTI = "(" + " OR ".join(rx(p.replace("{sites}", _SITES)) for p in vocab.BREAKDOWN_PATTERNS) + ")"
POINTER = (f"({anywhere(vocab.POINTER_WORDS)} AND NOT {whole(WORDS)} "
           f"AND NOT {whole(vocab.ROUTE_CATEGORY_WORDS)} AND NOT {HAS_SITE})")
ROUTE = f"""CASE WHEN {rx('|'.join(vocab.TRANSFER_PATTERNS))} THEN 'transfer'
 WHEN {anywhere(vocab.RECOMMEND_PHRASES)} THEN 'recommendation'
 WHEN {anywhere(vocab.PRODUCT_PHRASES)} AND NOT {anywhere(vocab.PLACE_PHRASES)} THEN 'product'
 WHEN {POINTER} THEN 'previous'
 WHEN ({anywhere(vocab.DATA_PHRASES)} OR {HAS_SITE}) AND {MULTI} THEN 'breakdown'
 WHEN {anywhere(vocab.DATA_PHRASES)} OR {HAS_SITE} THEN 'data' ELSE 'retrieval' END"""

EXCLUSION = "CASE " + " ".join(
    "WHEN " + rx("|".join(vocab.EXCLUSION_PATTERNS).replace("{site}", w.lower())) + f" THEN {lit(w)}"
    for w in vocab.WAREHOUSES) + " END"

_BEST = f"({anywhere(['en yüksek', 'en iyi', 'en çok'])} AND contains(norm, 'rating'))"
SORT = f"""CASE WHEN {_BEST} AND {anywhere(['uygun', 'ucuz', 'düşük'])} THEN 'rating_price'
 WHEN {_BEST} THEN 'rating'
 WHEN {anywhere(['en ucuz', 'en uygun'])} OR (contains(norm, 'fiyat') AND contains(norm, 'düşük')) THEN 'price_asc'
 WHEN contains(norm, 'en pahalı') OR (contains(norm, 'fiyat') AND contains(norm, 'yüksek')) THEN 'price_desc'
 WHEN {anywhere(['en çok satan', 'satış'])} THEN 'sales'
 WHEN contains(norm, 'en çok stok') OR (contains(norm, 'stok') AND contains(norm, 'en')) THEN 'stock' END"""

BY_WORDING = rx("|".join(vocab.FOLLOW_UP_PATTERNS))
BY_LENGTH = (f"(len(regexp_extract_all(norm, '[^ \\t\\n]+')) <= 6 AND (({HAS_SITE} AND NOT "
             f"{whole(vocab.FOLLOW_UP_CATEGORY_WORDS)}) OR {anywhere(vocab.SHORT_QUANTITY_WORDS)}))")
MASK = " + ".join(f"(CASE WHEN {whole([w])} THEN {1 << i} ELSE 0 END)" for i, w in enumerate(WORDS))
LIMIT = f"cast({number(vocab.LIMIT_PATTERNS)} AS bigint)"
RATING = number(vocab.RATING_PATTERNS)
PRICE = number(vocab.PRICE_PATTERNS)
STOCK = number(vocab.STOCK_PATTERNS)
HAS_FILTER = (f"({HAS_SITE} OR ({category()}) IS NOT NULL OR {whole(WORDS)} OR {RATING} IS NOT NULL "
              f"OR {PRICE} IS NOT NULL OR {STOCK} IS NOT NULL)")
OUTPUT = f"""CASE WHEN {anywhere(vocab.COUNT_WORDS)} AND NOT {anywhere(vocab.LIST_WORDS)} THEN 'count'
 WHEN {anywhere(vocab.LIST_OR_WHICH_WORDS)} OR {LIMIT} IS NOT NULL THEN 'list'
 WHEN {HAS_FILTER} THEN 'count' ELSE 'none' END"""

NORM = f"n AS (SELECT conv_id, turn, text, {normalized('text')} AS norm FROM questions)"


def ask(columns: str) -> str:
    return f"WITH {NORM} SELECT conv_id, turn, {columns} FROM n"


CONTEXT = f"""WITH {NORM}, m AS (
  SELECT conv_id, turn, norm, {ROUTE} AS route, {category()} AS cat,
    CASE WHEN {whole(vocab.EVERYWHERE_WORDS)} THEN '' ELSE {FIRST_LOCATION} END AS loc,
    cast({MASK} AS bigint) AS mask, {BY_WORDING} AS wording, {BY_LENGTH} AS short FROM n),
s AS (SELECT *, sum(CASE WHEN route = 'data' AND NOT (wording OR short) THEN 1 ELSE 0 END)
         OVER (PARTITION BY conv_id ORDER BY turn) AS seg,
    CASE WHEN route = 'data' THEN cat END AS c, CASE WHEN route = 'data' THEN loc END AS l,
    CASE WHEN route = 'data' THEN mask ELSE 0 END AS w FROM m),
ctx AS (SELECT conv_id, turn, norm, route, wording, short,
    last_value(c IGNORE NULLS) OVER f AS category, nullif(last_value(l IGNORE NULLS) OVER f, '') AS location,
    bit_or(w) OVER f AS words FROM s
  WINDOW f AS (PARTITION BY conv_id, seg ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
