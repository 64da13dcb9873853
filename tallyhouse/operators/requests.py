"""A table of filter requests answered against the catalogue.

Requests and products are never paired. Requests collapse to their distinct
filters; products collapse to counts per cell of the thresholds that occur;
ranges then become equality on nested blocks (``functions.ranges``). Work is
one pass over each side plus a part that depends only on how many different
thresholds people use.

Request columns: ``request_id, category, locations, keywords, rating_above,
price_above, price_below, stock_above, stock_below, n_rows``. NULL (or an
empty list) means "no filter".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.ranges import LEVEL_SHIFT, blocks_covering, blocks_of, levels_for
from tallyhouse.operators.grams import containing
from tallyhouse.operators.ordered import with_running
from tallyhouse.schemas import INTENT
from tallyhouse.sources.workspace import materialize

ANY = "*"
BITS = 2
WORD_BREAK = "\u0001"

# axis -> (value of a product, lower bound, upper bound)
AXES = {
    "rating": ("rating", "rating_above", None),
    "price": ("price", "price_above", "price_below"),
    "stock": ("stock_quantity", "stock_above", "stock_below"),
}


def key_of(value: Column) -> Column:
    """A value as part of a key; the sign in front keeps it apart from the wildcard."""
    return F.concat(F.lit("="), value)


def category_key() -> Column:
    """The asked category; none and an empty one are no filter."""
    return F.coalesce(key_of(F.nullif(F.col("category"), F.lit(""))), F.lit(ANY))


# --- intake ----------------------------------------------------------------

def parse_intents(df: DataFrame, column: str = "intent_json") -> DataFrame:
    """JSON intents to columns; malformed text gives NULLs."""
    parsed = F.from_json(F.col(column), INTENT, {"mode": "PERMISSIVE"})
    return df.withColumn("i", parsed).select(*[c for c in df.columns if c != column], "i.*")


def filter_bound(filters: Column, name: str, sign: str) -> Column:
    """Number behind ``>`` or ``<`` in one entry of the filter map."""
    text = F.try_element_at(filters, F.lit(name))
    return F.nullif(F.regexp_extract(text, rf"^ *{sign}=? *([0-9.]+)", 1), F.lit("")).try_cast("double")


def requests_from_intents(intents: DataFrame) -> DataFrame:
    """Request columns from parsed intents, filter map included."""
    m = F.col("filters")
    return intents.select(
        "request_id", "category", "locations",
        F.col("product_keywords").alias("keywords"),
        filter_bound(m, "rating", ">").alias("rating_above"),
        filter_bound(m, "price", ">").alias("price_above"),
        filter_bound(m, "price", "<").alias("price_below"),
        filter_bound(m, "stock", ">").alias("stock_above"),
        filter_bound(m, "stock", "<").alias("stock_below"),
        F.col("quantity").alias("n_rows"),
    )


# --- keywords --------------------------------------------------------------

def keyword_key(keywords: Column) -> Column:
    """Canonical text of a keyword set; ``*`` when there is none."""
    words = F.array_sort(F.array_distinct(F.transform(keywords, F.lower)))
    return F.coalesce(key_of(F.nullif(F.concat_ws(WORD_BREAK, words), F.lit(""))), F.lit(ANY))


def name_key() -> Column:
    return F.coalesce(F.lower("product_name"), F.lit(""))


def name_words(products: DataFrame, words: DataFrame) -> DataFrame:
    """(name, word) for each distinct name and each asked word it contains."""
    return containing(products.select(name_key().alias("text")), words).withColumnRenamed("text", "name")


def keyword_classes(products: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Products with a ``class_key``, and the classes of each keyword set.

    A class is the set of asked words a name contains, so every product is in
    one class. A keyword set ("any of these words") is the sum of the classes
    that share a word with it; ``*`` stands for all products.
    """
    sets = keys.select("keyword_key").distinct()
    members = sets.where(F.col("keyword_key") != ANY).select(
        "keyword_key", F.explode(F.split(F.substr("keyword_key", F.lit(2)), WORD_BREAK)).alias("word"))
    found = name_words(products, members.select("word").distinct())
    # A name holds few asked words, so the arrays are short.
    names = found.groupBy("name").agg(F.array_sort(F.collect_set("word")).alias("words"))
    names = materialize(names.withColumn("class_key", key_of(F.concat_ws(WORD_BREAK, "words"))), "name-classes")
    classed = products.withColumn("name", name_key()).join(
        names.select("name", "class_key"), "name", "left").drop("name").withColumn(
        "class_key", F.coalesce("class_key", F.lit("")))
    shared = names.select("class_key", F.explode("words").alias("word")).distinct().join(members, "word")
    edges = shared.select("keyword_key", "class_key").distinct().unionByName(
        sets.where(F.col("keyword_key") == ANY).withColumn("class_key", F.lit(ANY)))
    return classed, materialize(edges, "keyword-classes")


def any_or(column: str) -> Column:
    """The value and the wildcard, so that unfiltered requests match by equality."""
    return F.explode(F.array_compact(F.array(key_of(F.col(column)), F.lit(ANY))))


# --- matching --------------------------------------------------------------

def _signatures(requests: DataFrame) -> DataFrame:
    """Requests with canonical filters: bounds as they are and text keys."""
    cols = {"category_key": category_key(), "keyword_key": keyword_key(F.col("keywords"))}
    sites = F.array_sort(F.array_distinct(F.transform("locations", key_of)))
    cols["sites"] = F.when(F.size(sites) > 0, sites).otherwise(F.array(F.lit(ANY)))
    for axis, (_, above, below) in AXES.items():
        for end, bound in (("lo", above), ("hi", below)):
            cols[f"{axis}_{end}"] = (F.col(bound) if bound else F.lit(None)).cast("double")
    return requests.withColumns(cols)


# Price and stock ranges are looked up by block. Ratings have few distinct
# values, so their bound is compared directly.
BLOCK_AXES = ["price", "stock"]
SIGNATURE = ["category_key", "keyword_key", "sites"] + [f"{a}_{e}" for a in AXES for e in ("lo", "hi")]


def axis_ranks(signatures: DataFrame, products: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """``axis, value, rank`` for each value and bound in use, and how many bounds each axis has.

    Ranks come from the order of all values of an axis, in ranges: 2 p - 1 is
    the p-th bound itself, 2 p the gap behind it. So "over the p-th" is 2 p
    and up, and "under the p-th" is 2 p - 2 and down.
    """
    def listed(rows: DataFrame, columns: list[tuple[str, str]], bound: int) -> DataFrame:
        each = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(c).cast("double").alias("value")) for a, c in columns])
        return rows.select(F.explode(each).alias("x")).select("x.*").where("value IS NOT NULL").withColumn("bound", F.lit(bound).cast("long"))

    bounds = listed(signatures, [(a, f"{a}_{e}") for a in AXES for e in ("lo", "hi")], 1)
    values = listed(products, [(a, value) for a, (value, _, _) in AXES.items()], 0)
    both = values.unionByName(bounds).groupBy("axis", "value").agg(F.max("bound").alias("bound"))
    ranked = materialize(with_running(both, ["axis", "value"], {"below": F.col("bound")}), "ranks")
    sizes = dict.fromkeys(AXES, 0) | {r["axis"]: r["n"] for r in ranked.groupBy("axis").agg(F.sum("bound").alias("n")).collect()}
    before = F.lit(0)
    for axis in AXES:
        before = before + F.when(F.col("axis") > axis, sizes[axis]).otherwise(0)
    return ranked.select("axis", "value", (2 * (F.col("below") - before) + F.col("bound")).cast("int").alias("rank")), sizes


def task_count(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


class Matcher:
    """Shared preparation of the two request reports."""

    def __init__(self, products: DataFrame, requests: DataFrame, *extra: str):
        # Every branch below reads the requests, so their parsing runs once.
        asked = _signatures(requests).select("request_id", *SIGNATURE, *extra)
        self.requests = materialize(asked.withColumn("sig", F.md5(F.to_json(F.struct(*SIGNATURE)))), "requests")
        self.signatures = materialize(self.requests.select("sig", *SIGNATURE).distinct(), "signatures")
        self.ranks, sizes = axis_ranks(self.signatures, products)
        self.levels = {a: levels_for(2 * sizes[a] + 1, BITS) for a in AXES}
        self.products = products

    def with_rank(self, rows: DataFrame, axis: str, column: str) -> DataFrame:
        """Adds ``<column>_r``, the rank of a value or bound of the axis."""
        places = self.ranks.where(F.col("axis") == axis).select(F.col("value").alias("_v"), F.col("rank").alias(f"{column}_r"))
        return rows.join(places, F.col(column) == F.col("_v"), "left").drop("_v")

    def cells(self) -> DataFrame:
        """Products with their keyword class and their axis ranks."""
        rows = self.products
        for axis, (value, _, _) in AXES.items():
            rows = self.with_rank(rows.withColumn(f"{axis}_v", F.col(value).cast("double")), axis, f"{axis}_v")
            rows = rows.withColumnRenamed(f"{axis}_v_r", f"{axis}_r")
        classed, edges = keyword_classes(rows, self.signatures)
        self.edges = edges
        return classed

    def keyed(self, cells: DataFrame) -> DataFrame:
        """Each cell under its own keys and under "any"; unknown ratings rank lowest."""
        return cells.withColumns({
            "rating_r": F.coalesce("rating_r", F.lit(-1)),
            "class_key": F.explode(F.array(F.col("class_key"), F.lit(ANY))),
        }).withColumn("category_key", any_or("category")).withColumn("site", any_or("warehouse_location"))

    def blocked(self, cells: DataFrame) -> DataFrame:
        """One row per block a cell lies in; unknown values fit "no filter" only.

        The rows multiply here, so they are first spread over all tasks: few
        bytes before this step are many after it, which the sizes that decide
        on the merging of partitions do not show.
        """
        out = cells.repartition(task_count(cells), *CELL)
        for axis in BLOCK_AXES:
            top = F.array(F.lit(self.levels[axis] << LEVEL_SHIFT).cast("long"))
            blocks = F.when(F.col(f"{axis}_r").isNull(), top).otherwise(
                blocks_of(F.col(f"{axis}_r"), self.levels[axis], BITS))
            out = out.withColumn(f"{axis}_b", F.explode(blocks))
        return out

    def lookups(self, signatures: DataFrame | None = None) -> DataFrame:
        """The blocks each distinct filter consists of."""
        # Most requests share the "no keyword" key, so the rows are spread after the join.
        asked = self.signatures if signatures is None else signatures
        for column, axis in (("rating_lo", "rating"), *((f"{a}_{e}", a) for a in BLOCK_AXES for e in ("lo", "hi"))):
            asked = self.with_rank(asked, axis, column)
        asked = asked.join(self.edges, "keyword_key")
        out = asked.repartition(task_count(asked), "sig").withColumn("site", F.explode("sites"))
        for axis in BLOCK_AXES:
            low = F.coalesce(F.col(f"{axis}_lo_r") + 1, F.lit(0))
            # With no upper bound the range runs to the end of the axis, so that
            # an absent filter is the single top block.
            end = (1 << (BITS * self.levels[axis])) - 1
            high = F.coalesce(F.col(f"{axis}_hi_r") - 1, F.lit(end))
            out = out.withColumn(f"{axis}_b", F.explode(blocks_covering(low, high, self.levels[axis], BITS)))
        return out.select("sig", F.coalesce(F.col("rating_lo_r") + 1, F.lit(-1)).alias("rating_from"), *NODE)


RANKS = [f"{a}_r" for a in AXES]
CELL = ["category_key", "class_key", "site"] + RANKS
NODE = ["category_key", "class_key", "site"] + [f"{a}_b" for a in BLOCK_AXES]


def match_requests(products: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request: number of matching products and their units."""
    m = Matcher(products, requests)
    sums = [F.sum("n").alias("n"), F.sum("units").alias("units")]
    cells = m.cells().groupBy("category", "warehouse_location", "class_key", *RANKS).agg(
        F.count("*").alias("n"), F.sum("stock_quantity").alias("units"))
    merged = m.keyed(cells).groupBy(*CELL).agg(*sums)
    nodes = m.blocked(merged).groupBy(*NODE, "rating_r").agg(*sums)
    found = m.lookups().join(nodes, NODE).where("rating_r >= rating_from").groupBy("sig").agg(
        F.sum("n").alias("n_matches"), F.sum("units").alias("total_units"))
    return m.requests.join(found, "sig", "left").select(
        "request_id", F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
        F.coalesce("total_units", F.lit(0)).alias("total_units"))


#: Lists have lengths of 16, 256, 4096 and so on; each request reads the shortest that is long enough.
LENGTH_BITS = 4


def length_class(n_rows: Column) -> Column:
    return F.ceil(F.length(F.bin(n_rows - 1)) / LENGTH_BITS).cast("int")


def first_rows(products: DataFrame, requests: DataFrame, default: int = 10) -> DataFrame:
    """Per request: its first ``n_rows`` matching products in row order; a number under 1 counts as none.

    Requests are told apart by the length of their lists, so one that asks for
    very many rows does not lengthen the lists of the others.
    """
    wanted = F.when(F.col("n_rows") >= 1, F.col("n_rows")).otherwise(default).cast("long")
    m = Matcher(products, requests.withColumn("n_rows", wanted), "n_rows")
    asked = m.requests.withColumn("length", length_class(F.col("n_rows")))
    cells = materialize(m.cells().select("row_id", "asin", "category", "warehouse_location", "class_key", *RANKS), "cells")
    lengths = sorted(r["length"] for r in asked.select("length").distinct().collect())
    lists = None
    for length in lengths:  # one for each power of 16
        part = lists_of(m, cells, m.signatures.join(asked.where(F.col("length") == length).select("sig").distinct(), "sig", "left_semi"), length)
        lists = part if lists is None else lists.unionByName(part)
    if lists is None:
        return asked.select("request_id", F.array().cast("array<string>").alias("asins"))
    shown = F.transform(F.slice("rows", 1, F.col("n_rows").cast("int")), lambda r: r["asin"])
    return asked.join(lists, ["sig", "length"], "left").select(
        "request_id", F.coalesce(shown, F.array().cast("array<string>")).alias("asins"))


def lists_of(m: Matcher, cells: DataFrame, signatures: DataFrame, length: int) -> DataFrame:
    """``sig, length, rows``: the first products of each filter, ``16 ** length`` at most.

    A block keeps that many rows, which is applied in each task before the
    shuffle, and only blocks that these filters ask for are kept.
    """
    longest = 1 << (LENGTH_BITS * length)

    def head(rows: DataFrame, *keys: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("row_id"))
        return rows.withColumn("r", rank).where(F.col("r") <= longest).drop("r")

    # Lists are cut per cell first, so that only cells multiply, not products.
    short = head(cells, "category", "warehouse_location", "class_key", *RANKS)
    looked = materialize(m.lookups(signatures), "lookups")
    blocks = m.blocked(head(m.keyed(short), *CELL)).select("row_id", "asin", "rating_r", *NODE)
    nodes = head(blocks.join(looked.select(*NODE).distinct(), NODE, "left_semi"), *NODE, "rating_r")
    by_sig = Window.partitionBy("sig").orderBy("row_id")
    found = looked.join(nodes, NODE).where("rating_r >= rating_from").withColumn(
        "position", F.row_number().over(by_sig)).where(F.col("position") <= longest)
    return found.groupBy("sig").agg(F.array_sort(F.collect_list(F.struct("position", "asin"))).alias("rows")).withColumn(
        "length", F.lit(length))
