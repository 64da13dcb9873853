"""Running totals over a whole table, without a window over all of its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.sources.workspace import materialize


def with_running(df: DataFrame, order: list[str], totals: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """Adds, under each name in ``totals``, the sum of its column over all rows before a row (0 for the first).

    Rows are dealt into ranges of ``order`` (``ranges`` of them, else as many as shuffles have partitions) and written;
    each range is added up; and a range starts from the sums of the ranges before it. Rows that agree in ``order`` are
    taken in any order, and however many there are, they need not share a range. Nulls come first; no column may be called
    ``_range``, ``_uid``, or ``_before_`` or ``_start_`` and a name.
    """
    order = [*order, "_uid"]
    df = df.withColumn("_uid", F.monotonically_increasing_id())
    dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    rows = materialize(dealt.withColumns({"_range": F.spark_partition_id(), **{f"_before_{n}": c for n, c in totals.items()}}), "ranges")
    # One row for each range, however many rows there are.
    sums = rows.groupBy("_range").agg(*(F.sum(f"_before_{n}").alias(n) for n in totals)).orderBy("_range").collect()
    offsets, so_far = [], [0] * len(totals)
    for row in sums:
        offsets.append((row["_range"], *so_far))
        so_far = [a + (row[n] or 0) for a, n in zip(so_far, totals)]
    schema = ", ".join(["_range int", *(f"`_start_{n}` {rows.select(F.sum(f'_before_{n}')).dtypes[0][1]}" for n in totals)])
    starts = F.broadcast(df.sparkSession.createDataFrame(offsets, schema))
    earlier = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = {n: F.col(f"_start_{n}") + F.coalesce(F.sum(f"_before_{n}").over(earlier), F.lit(0)) for n in totals}
    return rows.join(starts, "_range").withColumns(local).drop("_range", "_uid", *(f"{p}_{n}" for n in totals for p in ("_before", "_start")))
