"""Conversation context: what a follow-up question inherits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions import questions as q
from tallyhouse.functions import vocab
from tallyhouse.operators.carry import carry_last
from tallyhouse.operators.grams import containing
from tallyhouse.sources.workspace import materialize

CHUNK_TURNS = 4096
MOST_WORDS = 63


def word_mask(text: Column, words: list[str], seen: Column | None = None) -> Column:
    """Bit ``i`` is set when word ``i`` is in the text."""
    if len(words) > MOST_WORDS:
        raise ValueError(f"a mask holds {MOST_WORDS} words")
    if seen is None:
        return q.once(q.words_seen(text, words), lambda s: word_mask(text, words, s))
    bits = [F.when(q.saw(text, seen, w), F.lit(1 << i)).otherwise(0).cast("long") for i, w in enumerate(words)]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return total


def mask_words(mask: Column, words: list[str]) -> Column:
    return F.array_compact(F.array(*[
        F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(w)) for i, w in enumerate(words)]))


def mentions(questions: DataFrame, categories: dict[str, str], words: list[str]) -> DataFrame:
    """What each question says by itself. The text is cut into words once."""
    t, seen = F.col("norm"), F.col("_seen")
    rows = questions.withColumn("norm", q.normalize_text(F.col("text"))).withColumn("_seen", q.words_seen(
        t, categories, words, vocab.EVERYWHERE_WORDS, vocab.ROUTE_CATEGORY_WORDS, vocab.FOLLOW_UP_CATEGORY_WORDS))
    return rows.withColumns({
        "route": q.route_intent(t, words, seen),
        "own_category": q.map_category(t, categories, seen=seen),
        # An empty name means "no place filter" and ends an inherited one.
        "own_location": F.when(q.has_word(t, vocab.EVERYWHERE_WORDS, seen=seen), "").otherwise(F.get(q.extract_locations(t), 0)),
        "own_words": word_mask(t, words, seen),
        "by_wording": q.refers_back(t),
        "by_length": q.short_follow_up(t, seen),
    }).drop("_seen")


def carry_context(questions: DataFrame, categories: dict[str, str], words: list[str]) -> DataFrame:
    """Context after each turn, per conversation.

    Only questions answered from the catalogue change the context. One that is
    no follow-up starts it afresh; a follow-up keeps the category and place it
    does not name itself and adds its words to those kept. A short question
    counts as a follow-up only if there is context, but inheriting from an
    empty context changes nothing, so the rule does not need the outcome of
    the previous turn and the fold stays a plain one.
    """
    return fold_mentions(mentions(questions, categories, words), keep=("norm",))


def fold_mentions(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The context after each turn, given what each says by itself; ``keep``: further columns."""
    answered = F.col("route") == "data"
    follows = F.col("by_wording") | F.col("by_length")
    state = carry_last(
        rows, "conv_id", "turn", F.floor(F.col("turn") / CHUNK_TURNS),
        reset=answered & ~follows,
        last={
            "category": F.when(answered, F.col("own_category")),
            "location": F.when(answered, F.col("own_location")),
        },
        union={"words": F.when(answered, F.col("own_words")).otherwise(F.lit(0).cast("long"))},
    )
    return state.select(
        "conv_id", "turn", *keep, "route", "by_wording", "by_length", "category",
        F.nullif("location", F.lit("")).alias("location"), "words",
    )


def with_follow_up(context: DataFrame) -> DataFrame:
    """Adds whether the turn is a follow-up, given the context before it.

    A turn's context is handed on to the next turn by an equi-join on the turn
    number, so no conversation is sorted in one piece.
    """
    has = F.col("category").isNotNull() | F.col("location").isNotNull() | (F.col("words") != 0)
    before = context.select("conv_id", (F.col("turn") + 1).alias("turn"), has.alias("_had"))
    joined = context.join(before, ["conv_id", "turn"], "left")
    follow = F.col("by_wording") | (F.col("by_length") & F.coalesce("_had", F.lit(False)))
    return joined.withColumn("is_follow_up", follow).drop("_had")


def category_named(questions: DataFrame, products: DataFrame) -> DataFrame:
    """First category, in appearance order, of which the normalised text has a word: ``conv_id, turn, category``.

    A word stands for the first category that has it. Questions are cut into
    runs without spaces; the different runs are searched for the words, and
    questions meet the runs that have one by equality.
    """
    known = products.where(F.col("category").isNotNull()).groupBy("category").agg(F.min("row_id").alias("first_row"))
    first = F.struct("first_row", "category")
    words = known.select(first.alias("first"), F.explode(F.split(F.lower("category"), " ")).alias("word")).where(
        "word <> ''").groupBy("word").agg(F.min("first").alias("first"))
    words = materialize(words, "category-words")
    asked = questions.withColumn("_question", F.monotonically_increasing_id()).select("_question", "conv_id", "turn", "norm")
    asked = materialize(asked, "asked")
    runs = asked.select("_question", F.explode(F.array_distinct(F.split("norm", " "))).alias("text"))
    hits = containing(runs, words).join(words, "word").groupBy("text").agg(F.min("first").alias("first"))
    found = runs.join(materialize(hits, "category-runs"), "text").groupBy("_question").agg(F.min("first").alias("first"))
    return asked.join(found, "_question").select("conv_id", "turn", F.col("first.category").alias("category"))
