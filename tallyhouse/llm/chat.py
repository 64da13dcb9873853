"""Chat formatting from every participant's view.

For each participant of a dialogue the whole dialogue is rendered once: that speaker's messages as the assistant's,
all others' as a named user's, system messages as the system's. The assistant's words and their end mark are to be
trained on. The result has a row for each message and view, with its place in the rendered dialogue: joined in order
of ``position`` the column ``rendered`` is the dialogue, and characters ``mask_start`` to ``mask_end`` of it are
trained on. No dialogue is gathered in one row, as one may hold a third of all messages.

DataFrame functions only. Messages are ordered by turn, then role, then text; they are dealt out by range, numbered
there, and offsets over a dialogue are sums within a range plus the sums of the ranges before it.

A null text is an empty message, a null turn comes first, a null role speaks as ``unknown`` but has no view of its
own. Messages with a null conv_id are one dialogue. A dialogue without participants has no rows. Repeated rows are
messages each. Marks inside a text or name are broken up by a blank, so they cannot end a message. Very long texts are
rendered whole. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.sources.workspace import materialize

SYSTEM = "system"
BEGIN, CLOSE = "<|im_start|>", "<|im_end|>"


def plain(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|(im_start|im_end)\|>", "< |$1|>")


def header() -> Column:
    """A message's first line, from the columns ``chat_role`` and ``name``."""
    return F.concat(F.lit(BEGIN), "chat_role", F.coalesce(F.concat(F.lit(" name="), "name"), F.lit("")), F.lit("\n"))


def rotations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
              text: str = "text") -> DataFrame:
    """conv_id, perspective, position, turn, chat_role, name, rendered, char_start, mask_start, mask_end."""
    rows = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    n = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text", F.monotonically_increasing_id()]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order[:-1])
    rows = rows.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id())
    rows = materialize(rows.withColumn("size", F.length(plain(F.col("text"))).cast("long")), "messages")
    views = rows.where(F.col("role") != SYSTEM).select(F.col("conv").alias("of"), F.col("role").alias("perspective")).distinct()
    # places and offsets need lengths alone; texts join them at the end
    seen = rows.select("conv", "role", "part", "seq", "size").join(views, F.col("conv").eqNullSafe(F.col("of"))).drop("of")
    is_system, is_own = F.coalesce(F.col("role") == SYSTEM, F.lit(False)), F.col("role").eqNullSafe(F.col("perspective"))
    chat_role = F.when(is_system, SYSTEM).when(is_own, "assistant").otherwise("user")
    name = F.when(~is_system & ~is_own, F.regexp_replace(plain(F.coalesce("role", F.lit("unknown"))), r"\s", "_"))
    seen = seen.withColumn("chat_role", chat_role).withColumn("name", name).drop("role")
    seen = seen.withColumn("head", F.length(header()).cast("long"))
    seen = seen.withColumn("size", F.col("head") + F.col("size") + F.lit(len(CLOSE) + 1))
    within = Window.partitionBy("part", "conv", "perspective").orderBy("seq")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumn("at", F.row_number().over(within).cast("long")).withColumn(
        "offset", F.coalesce(F.sum("size").over(before), F.lit(0)))
    parts = seen.groupBy("part", "conv", "perspective").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    earlier = Window.partitionBy("conv", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("p"), F.col("conv").alias("c"), F.col("perspective").alias("v"),
                         F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"),
                         F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("size_before")).where("n_before > 0")
    same = (F.col("part") == F.col("p")) & F.col("conv").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("v"))
    placed = seen.join(parts, same, "left").select(
        "seq", "perspective", "chat_role", "name", "head", "size",
        (F.col("at") + F.coalesce("n_before", F.lit(0))).alias("position"),
        (F.col("offset") + F.coalesce("size_before", F.lit(0))).alias("char_start"))
    out = rows.select("seq", "conv", "turn", "text").join(placed, "seq")
    start, trained = F.col("char_start"), F.col("chat_role") == "assistant"
    return out.select(
        F.col("conv").alias(conv), "perspective", "position", F.col("turn").alias(turn), "chat_role", "name",
        F.concat(header(), plain(F.col("text")), F.lit(f"{CLOSE}\n")).alias("rendered"), "char_start",
        F.when(trained, start + F.col("head")).alias("mask_start"), F.when(trained, start + F.col("size") - 1).alias("mask_end"))
