"""Substring search between two tables as an equi-join.

A text is listed under the runs of up to three characters in it. A word is
looked up under one of its runs, the one that fewest texts have; the hit is
then verified in full. A run that very many texts share is split by a hash of
the text, and the words under it go to all splits, so no task gets it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.sources.workspace import materialize

GRAM = 3
SPLIT_ROWS = 4096


def grams(text: Column, size: int) -> Column:
    """All different runs of ``size`` characters, found in one pass."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def own_grams(word: Column) -> Column:
    """Runs a word can be looked up under; a short word is its own."""
    return F.when(F.length(word) <= GRAM, F.array(word)).otherwise(grams(word, GRAM))


def containing(texts: DataFrame, words: DataFrame, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(text, word) for each different ``text`` and each different non-empty ``word`` that is in it."""
    asked = words.select("word").where("word <> ''").distinct()
    under = materialize(asked.select("word", F.explode(own_grams(F.col("word"))).alias("gram")), "word-grams")
    wanted = under.select("gram").distinct()
    every = F.flatten(F.array(*[grams(F.col("text"), n) for n in range(1, GRAM + 1)]))
    named = texts.select("text").where("text <> ''").distinct()
    listed = materialize(named.select("text", F.explode(every).alias("gram")).join(wanted, "gram", "left_semi"), "text-grams")
    sizes = listed.groupBy("gram").agg(F.count("*").alias("n"))
    # A word with a run that no text has is in none.
    rated = under.join(sizes, "gram", "left")
    best = rated.groupBy("word").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best")).where("best.n > 0")
    splits = F.ceil(F.col("best.n") / split_rows)
    chosen = materialize(best.select("word", F.col("best.gram").alias("gram"), splits.alias("splits")), "word-gram")
    places = chosen.select("gram", "splits").distinct()
    dealt = listed.join(places, "gram").select("text", "gram", F.pmod(F.xxhash64("text"), F.col("splits")).alias("split"))
    spread = chosen.select("word", "gram", F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1)).alias("split"))
    return dealt.join(spread, ["gram", "split"]).where(F.contains("text", "word")).select("text", "word")
