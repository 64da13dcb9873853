"""Mixing sources to target weights: how often each document is taken so that sources share the words as wanted.

1. Sizes: the words of each document, summed by source in partial sums, so one source may hold most rows.
2. Weights: sources in order of their names get the weights in turn; their ranks come from ranges of the names.
3. Targets: the words of all sources are shared by weight; no target may exceed ``most`` times its source's size, and
   what is over is shared by weight among the others, until none is above. A round is one sum over the sources.
4. Copies: a document is taken floor(rate) times, rate being target / source size, and once more if a number in [0, 1)
   hashed from the seed, its id and its text lies below the fraction. Nothing but the row decides, so reruns agree.

A null text has no words; null ids and sources are values of their own, the null source comes last. Rows that agree in id
and text draw alike. Sources without words have rate 0. Texts of any length are counted whole, by one expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators.ordered import with_running
from tallyhouse.sources.workspace import materialize

WEIGHTS = (1, 2, 3)
MOST = 3
#: Hexadecimal digits of the digest that make the draw: 52 bits, as many as a double holds.
DIGITS = 13


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(seed: int, doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) for each id and text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, DIGITS), 16, 10).cast("long") / F.lit(16**DIGITS)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds ``target`` to rows of (source, source_size), one for each source."""
    ranked = with_running(sizes.withColumn("_null", F.col("source").isNull()), ["_null", "source"], {"_rank": F.lit(1)})
    turn = F.array(*map(F.lit, weights))
    rows = materialize(ranked.withColumn("_weight", F.element_at(turn, (F.col("_rank") % len(weights) + 1).cast("int"))), "sources")
    cap = F.col("source_size") * most

    def level(above: Column) -> tuple[float, int]:
        """Words for each unit of weight if the sources ``above`` their limit get that, and how many these are."""
        got = rows.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, cap)).alias("capped"),
                       F.sum(F.when(~above, F.col("_weight"))).alias("weight"), F.count(F.when(above, 1)).alias("n")).first()
        return float((got["all"] or 0) - (got["capped"] or 0)) / (got["weight"] or 1), got["n"]

    words, n = level(F.lit(False))
    while True:
        above = cap < F.col("_weight") * F.lit(words)
        words, now = level(above)
        if now == n:
            break
        n = now
    target = F.when(above, cap.cast("double")).otherwise(F.col("_weight") * F.lit(words))
    return rows.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", keep: tuple[str, ...] = ("doc_id",),
        weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """The columns ``keep`` of each row of ``docs``, size, source_size, target (its source's) and copies, how often the
    mix takes the row. Other columns are not read, so their names cannot clash."""
    inner = [f"c{i}" for i in range(len(keep))]
    sized = docs.select(F.col(source).alias("source"), n_words(F.col(text)).alias("size"),
                        draw(seed, F.col(id_column), F.col(text)).alias("draw"), *(F.col(c).alias(i) for c, i in zip(keep, inner)))
    totals = docs.groupBy(F.col(source).alias("source")).agg(F.sum(n_words(F.col(text))).alias("source_size"))
    # Written, so that its measured size decides whether it is broadcast.
    targets = materialize(source_targets(totals, weights, most), "targets").withColumnRenamed("source", "_source")
    rows = sized.join(targets, F.col("source").eqNullSafe(F.col("_source")))
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    copies = F.floor(rate) + (F.col("draw") < rate - F.floor(rate)).cast("long")
    return rows.select(*(F.col(i).alias(c) for c, i in zip(keep, inner)), "size", "source_size", "target", copies.alias("copies"))


def emitted(mixed: DataFrame, copy: str = "copy") -> DataFrame:
    """A row for each time that the mix takes a document, numbered from 1."""
    return mixed.where("copies > 0").withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")
