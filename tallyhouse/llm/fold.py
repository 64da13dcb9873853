"""Many partial states to one, a bounded number at a time."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.sources.workspace import materialize

STATES = "part long, state binary"


def fold(states: DataFrame, combine: Callable[[bytes, bytes], bytes], label: str, fan: int = 16) -> bytes | None:
    """``states``: rows (part, state), parts numbered from 0. Neighbours are combined in order, ``fan`` at a time, in
    tasks; the driver gets one state, or None where there is none. Reruns give the same."""

    def together(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        parts = table["state"].to_pylist()
        state = parts[0]
        for other in parts[1:]:
            state = combine(state, other)
        return pa.table({"part": [table["part"][0].as_py()], "state": pa.array([state], pa.binary())})

    states = materialize(states, label)
    most = states.agg(F.max("part")).first()[0]
    width = 1
    while most is not None and width <= most:
        width *= fan
        states = states.groupBy(F.floor(F.col("part") / width)).applyInArrow(lambda t: together(t), STATES)
    row = states.first()
    return bytes(row["state"]) if row else None
