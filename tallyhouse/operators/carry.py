"""Ordered state per key, computed in bounded pieces.

A window over a whole key would put a key that holds a third of all rows into
one task. Here a key's rows are cut into chunks of consecutive rows, and each
chunk is folded on its own to one state: whether it starts afresh, the latest
values, the union of bits. Such states fold associatively, so the states of
``FAN`` neighbouring chunks make one of the next level, and so on until a key
has one group; then what comes before a group is handed down to its members.
No task sees more than ``FAN`` states of a key. The outcome equals the plain
window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.sources.workspace import materialize

FAN = 1024


def running(frame: DataFrame, within: list[str], by: str, last: list[str], union: list[str]) -> DataFrame:
    """Running states of each ``within``: ``_reset`` becomes whether there was a reset so far."""
    upto = Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    frame = frame.withColumn("_resets", F.sum(F.col("_reset").cast("int")).over(upto))
    segment = Window.partitionBy(*within, "_resets").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    out = {n: F.last(n, ignorenulls=True).over(segment) for n in last}
    out |= {n: F.bit_or(n).over(segment) for n in union}
    return frame.withColumns(out).withColumn("_reset", F.col("_resets") > 0).drop("_resets")


def summaries(frame: DataFrame, group: list[str], by: str, states: list[str]) -> DataFrame:
    """The last running state of each group."""
    end = F.struct("_reset", *states)
    ends = frame.groupBy(*group).agg(F.max_by(end, F.col(by)).alias("_s"))
    return ends.select(*group, *(F.col(f"_s.{n}").alias(n) for n in ("_reset", *states)))


def after(incoming: dict[str, Column], own: dict[str, Column], reset: Column, last: list[str], union: list[str]) -> dict[str, Column]:
    """State behind a piece with its ``own`` state, given what comes in."""
    out = {n: F.when(reset, own[n]).otherwise(F.coalesce(own[n], incoming[n])) for n in last}
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return out | {n: F.when(reset, zero(own[n])).otherwise(zero(own[n]).bitwiseOR(zero(incoming[n]))) for n in union}


def before(ends: DataFrame, key: str, piece: str, last: list[str], union: list[str], fan: int | None = None) -> DataFrame:
    """For each (key, piece) the state that all earlier pieces leave: key, piece, and ``_in_`` and each state's name.

    ``ends``: a row for each (key, piece) with ``_reset`` and the states.
    """
    fan = fan or FAN
    states = [*last, *union]
    group = f"_g{piece}"
    local = materialize(running(ends.withColumn(group, F.call_function("div", F.col(piece), F.lit(fan))), [key, group], piece, last, union), "states")
    previous = Window.partitionBy(key, group).orderBy(piece)
    one_before = {f"_own_{n}": F.lag(n).over(previous) for n in ("_reset", *states)}
    rows = local.select(key, piece, group, *(c.alias(n) for n, c in one_before.items()))
    own, reset = {n: F.col(f"_own_{n}") for n in states}, F.coalesce("_own__reset", F.lit(False))
    groups = local.select(key, group).distinct()
    if not groups.groupBy(key).count().where("count > 1").limit(1).count():
        return rows.select(key, piece, *(own[n].alias(f"_in_{n}") for n in states))
    above = before(summaries(local, [key, group], piece, states), key, group, last, union, fan)
    joined = rows.join(above, [key, group])
    incoming = {n: F.col(f"_in_{n}") for n in states}
    result = after(incoming, own, reset, last, union)
    return joined.select(key, piece, *(result[n].alias(f"_in_{n}") for n in states))


def carry_last(
    df: DataFrame,
    key: str,
    order: str,
    chunk: Column,
    reset: Column,
    last: dict[str, Column],
    union: dict[str, Column] | None = None,
    fan: int | None = None,
) -> DataFrame:
    """Running state per key that starts afresh at each ``reset`` row.

    ``last``: latest non-NULL value since (and including) the reset row.
    ``union``: bitwise OR of the values since the reset row.
    ``chunk`` must grow with ``order`` and hold a bounded number of rows.
    """
    union = union or {}
    lasts, unions = [f"_l_{n}" for n in last], [f"_u_{n}" for n in union]
    named = dict(zip([*lasts, *unions], [*last.values(), *union.values()]))
    rows = df.withColumns({"_chunk": chunk, "_reset": F.coalesce(reset, F.lit(False)), **named})
    # Both the summaries and the result read this, so it is computed once.
    local = materialize(running(rows, [key, "_chunk"], order, lasts, unions), "folded")
    ends = summaries(local, [key, "_chunk"], order, [*lasts, *unions])
    joined = local.join(before(ends, key, "_chunk", lasts, unions, fan), [key, "_chunk"], "left")
    result = after({n: F.col(f"_in_{n}") for n in named}, {n: F.col(n) for n in named}, F.col("_reset"), lasts, unions)
    extra = [c for c in joined.columns if c.startswith(("_l_", "_u_", "_in_"))]
    return joined.withColumns({n[3:]: c for n, c in result.items()}).drop("_chunk", "_reset", *extra)
