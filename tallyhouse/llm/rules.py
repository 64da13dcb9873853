"""Quality rules: counts of each text, and a log-likelihood ratio between trusted and raw text.

Words and word pairs are hashed to a fixed number of buckets. Their counts over trusted texts and over all texts give
two multinomials (smoothed by ``SMOOTH`` in each bucket); a text's score is the sum of the log ratios of its words
and pairs, divided by their number plus ``SHRINK``, so that a few words decide little. The threshold is fixed and
every text is judged by it. DataFrame functions only.

Null and empty texts have no words and a score of 0; they fail the base rule of 50 words. Rows with a null id are
judged but never trusted. Repeated rows count and are judged each. A text's words are arrays in one row, so a very long
text takes a task some twenty times its size.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.sources.workspace import materialize

BUCKETS = 10_000
SMOOTH = 1.0
SHRINK = 50
THRESHOLD = -0.025
#: Ids of trusted rows that may be sent to all executors; more are joined by a shuffle.
MOST_SENT = 1_000_000

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def without(text: Column, letters: str) -> Column:
    return F.translate(text, letters, "")


def word_ids(text: Column) -> Column:
    """Hashes of a text's words. No function inside an array function here names a column: should the optimizer put
    an expression in a column's place, it is computed once for a text, not for each word."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def window_ids(n: int) -> Column:
    """Hashes of every ``n`` neighbours of the column ``word_ids``."""
    size = f"greatest(size(word_ids) - {n - 1}, 0)"
    parts = ", ".join(f"slice(word_ids, {k + 1}, {size})" for k in range(n))
    return F.expr(f"transform(arrays_zip({parts}), x -> xxhash64(x))")


#: Places of windows that occur twice or more, in order, from the sorted pairs of hash and place.
AGAIN = """sort_array(transform(filter(arrays_zip(sorted, prev, next),
    x -> x.sorted.h = x.prev.h OR x.sorted.h = x.next.h), x -> x.sorted.i))"""
COVERED = "aggregate(again, named_struct('n', 0L, 'to', 0L), (s, i) -> named_struct("\
    "'n', s.n + i + 3 - greatest(cast(i as bigint), s.to), 'to', i + 3L), s -> s.n)"


def with_counts(docs: DataFrame, text: str) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the arrays they are counted on."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: without(x, SPACES) != "")
    rows = docs.withColumn("word_ids", word_ids(t)).withColumn("lines", lines)
    rows = rows.withColumn("triples", window_ids(3))
    rows = rows.withColumn("sorted", F.expr(
        "IF(size(array_distinct(triples)) = size(triples), array(), "
        "sort_array(transform(triples, (h, i) -> named_struct('h', h, 'i', i))))"))
    rows = rows.withColumn("prev", F.expr("concat(array(cast(NULL AS struct<h: bigint, i: int>)), sorted)"))
    rows = rows.withColumn("next", F.expr("slice(sorted, 2, size(sorted))"))
    rows = rows.withColumn("again", F.expr(f"IF(size(sorted) = 0, array(), {AGAIN})"))
    return rows.select(
        *docs.columns, "word_ids", F.size("word_ids").cast("long").alias("n_words"),
        F.length(without(t, SPACES)).cast("long").alias("word_chars"),
        (F.length(t) - F.length(without(t, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"IF(size(again) = 0, 0L, {COVERED})").alias("n_repeat_words"))


def grams() -> Column:
    """Buckets of all words and word pairs of the columns ``word_ids`` and ``pairs``."""
    return F.expr(f"transform(concat(word_ids, pairs), h -> cast(pmod(h, {BUCKETS}) as int))")


def log_ratios(docs: DataFrame, trusted: DataFrame, id_column: str, text: str) -> list[float]:
    """Log ratio of each bucket. ``trusted``: a column of ids. The driver holds one number for each bucket."""
    ids = trusted.select(F.col(id_column).alias("trusted_id")).where("trusted_id IS NOT NULL").distinct()
    if ids.count() <= MOST_SENT:
        ids = F.broadcast(ids)
    rows = docs.select(F.col(id_column).alias("id"), word_ids(F.coalesce(F.col(text), F.lit(""))).alias("word_ids"))
    rows = rows.join(ids, F.col("id") == F.col("trusted_id"), "left").withColumn("pairs", window_ids(2))
    # explode_outer: for explode the optimizer adds a filter that computes the array once more
    counted = rows.select(F.col("trusted_id").isNotNull().alias("good"), F.explode_outer(grams()).alias("bucket"))
    found = counted.where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("good").alias("good")).collect()
    n, good = {r.bucket: r.n for r in found}, {r.bucket: r.good for r in found}
    all_n, all_good = sum(n.values()) + SMOOTH * BUCKETS, sum(good.values()) + SMOOTH * BUCKETS
    return [math.log((good.get(b, 0) + SMOOTH) / all_good) - math.log((n.get(b, 0) + SMOOTH) / all_n) for b in range(BUCKETS)]


def judge(docs: DataFrame, trusted: DataFrame, id_column: str = "doc_id", text: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """The id column, the counts, base_failed, score and kept. Other columns are not read."""
    ratios = F.from_json(F.lit(json.dumps(log_ratios(docs, trusted, id_column, text))), "array<double>")
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    rows = with_counts(rows, "text").withColumn("pairs", window_ids(2)).withColumn("grams", grams())
    total = F.aggregate("grams", F.lit(0.0), lambda s, b: s + F.get(ratios, b))
    rows = rows.withColumn("score", total / (F.size("grams") + SHRINK))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       failed.alias("base_failed"), "score", (~failed & (F.col("score") >= threshold)).alias("kept"))
    # a written table, as a later filter on these columns would otherwise be computed apart from them
    return materialize(rows, "rules").withColumnRenamed("id", id_column)
