"""Prefix scans over ordered pieces of a key, level by level.

A key may have any number of pieces. Pieces are folded in groups of neighbours, 2**BITS at most, groups in groups of
groups, until each key has one group; then what comes into a group is spread over its members, down to the pieces.
States are byte strings; folding must be associative.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.sources.workspace import materialize

BITS = 8
Fold = Callable[[list[bytes]], bytes]
Spread = Callable[[bytes | None, list[bytes]], list[bytes]]


def scan(pieces: DataFrame, fold: Fold, spread: Spread, bits: int = BITS) -> DataFrame:
    """``pieces``: key, at (long, orders the pieces of a key, no two alike) and state. ``fold`` makes one state of
    neighbours in order; ``spread`` says what comes into each of them, given what comes into the first group (None: the
    key's begin) or, for scans from the end, into the last. Returns key, at, incoming."""
    key = pieces.schema["key"].dataType.simpleString()
    folded_schema, incoming_schema = f"key {key}, at long, state binary", f"key {key}, at long, incoming binary"

    def group(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        return pa.table({"key": table["key"][:1], "at": [table["group"][0].as_py()],
                         "state": pa.array([fold(table["state"].to_pylist())], pa.binary())})

    def hand(incoming: bytes | None, table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        return pa.table({"key": table["key"], "at": table["at"],
                         "incoming": pa.array(spread(incoming, table["state"].to_pylist()), pa.binary())})

    def down(members: pa.Table, above: pa.Table) -> pa.Table:
        return hand(above["incoming"][0].as_py(), members)

    levels = [pieces.withColumn("group", F.shiftright("at", bits))]
    while levels[-1].groupBy("key").count().where(F.col("count") > 1 << bits).limit(1).count():
        up = levels[-1].groupBy("key", "group").applyInArrow(lambda t: group(t), folded_schema)
        levels.append(materialize(up.withColumn("group", F.shiftright("at", bits)), "scan"))
    incoming = levels[-1].groupBy("key").applyInArrow(lambda t: hand(None, t), incoming_schema)
    for members in levels[-2::-1]:
        above = incoming.select("key", F.col("at").alias("group"), "incoming")
        incoming = members.groupBy("key", "group").cogroup(above.groupBy("key", "group")).applyInArrow(
            lambda m, a: down(m, a), incoming_schema)
    return incoming
