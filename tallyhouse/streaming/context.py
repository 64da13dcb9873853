"""Conversation context on an unbounded question log."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyhouse.operators.context import fold_mentions, mentions
from tallyhouse.streaming.state import keep_state_by_key

OUTPUT = "conv_id long, turn long, route string, category string, location string, words long"
CONTEXT = "category string, location string, words long, next long, parcel long, firsts array<long>, parcels array<long>"
MENTION = "route string, own_category string, own_location string, own_words long, by_wording boolean, by_length boolean"
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
MENTIONED = [c.split()[0] for c in MENTION.split(", ")]
#: Rows that wait, by column.
PARCEL = "turn array<long>, " + ", ".join(f"{c.split()[0]} array<{c.split()[1]}>" for c in MENTION.split(", "))


class Carry(StatefulProcessor):
    """One conversation: its context and next turn in a value; what a batch brings behind a gap waits as one parcel in a
    map until the gap is filled, and the value knows the first turn of each.

    The order of arrival does not matter. After ``idle_ms`` without news a timer lets the waiting turns go, in order, and
    drops the state. Each entry of the state is bounded by the rows of a batch.
    """

    def __init__(self, idle_ms: int | None, first_turn: int) -> None:
        self.idle_ms, self.first_turn = idle_ms, first_turn

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.context = handle.getValueState("context", CONTEXT)
        self.waiting = handle.getMapState("waiting", "first long, parcel long", PARCEL)

    def load(self) -> None:
        known = self.context.get() or (None, None, 0, self.first_turn, 0, [], [])
        self.category, self.location, self.words, self.next, self.parcel = known[:5]
        self.waits = sorted(zip(known[5], known[6]))

    def fold(self, row: tuple) -> tuple:
        turn, route, own_category, own_location, own_words, by_wording, by_length = row
        self.next = max(self.next, turn + 1)
        if route == "data":
            if not (by_wording or by_length):
                self.category, self.location, self.words = None, None, 0
            self.category = self.category if own_category is None else own_category
            self.location = self.location if own_location is None else own_location
            self.words |= int(own_words)
        return turn, route, self.category, self.location or None, self.words

    def take(self, to_end: bool = False) -> list[tuple]:
        """Rows of the parcels that begin at the next turn or before it; these are gone then."""
        out: list[tuple] = []
        while self.waits and (to_end or self.waits[0][0] <= self.next):
            place = self.waits.pop(0)
            out += zip(*self.waiting.getValue(place))
            self.waiting.removeKey(place)
        return out

    def rows(self, key: tuple, out: list[tuple]) -> Iterator[Row]:
        return (Row(**dict(zip(COLUMNS, (key[0], *r)))) for r in out)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self.load()
        left = [tuple(r[c] for c in ("turn", *MENTIONED)) for r in rows]
        out: list[tuple] = []
        while True:
            left = sorted([*left, *self.take()], key=lambda r: r[0])
            done = 0
            while done < len(left) and left[done][0] <= self.next:
                out.append(self.fold(left[done]))
                done += 1
            left = left[done:]
            if not done or not self.waits or self.waits[0][0] > self.next:
                break
        if left:
            place = (int(left[0][0]), int(self.parcel))
            self.waiting.updateValue(place, tuple(list(x) for x in zip(*left)))
            self.waits.append(place)
            self.parcel += 1
        firsts, parcels = ([w[k] for w in self.waits] for k in (0, 1))
        self.context.update((self.category, self.location, int(self.words), int(self.next), int(self.parcel), firsts, parcels))
        if self.idle_ms:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield from self.rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.load()
        out = [self.fold(r) for r in sorted(self.take(to_end=True), key=lambda r: r[0])]
        self.context.clear()
        yield from self.rows(key, out)

    def close(self) -> None:
        pass


def held_turns(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The turns that wait behind a gap after a bounded run of ``stream_context``, folded in order as if no more came.
    The checkpoint stays as it is: what comes later still fills the gap, and then the stream's own rows replace these.

    The fold is that of ``carry_context``, in pieces: a row of the context so far comes before a conversation's turns.
    """
    def state(name: str) -> DataFrame:
        return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)

    try:
        waiting, context = state("waiting"), state("context")
    except PySparkException as e:
        if e.getCondition() != "STDS_COMMITTED_BATCH_UNAVAILABLE":  # a run without input
            raise
        return spark.createDataFrame([], OUTPUT)
    each = F.arrays_zip(*(F.col(f"user_map_value.{c}").alias(c) for c in ("turn", *MENTIONED)))
    turns = waiting.select("key.conv_id", F.explode(each).alias("x"))
    turns = turns.select("conv_id", *(F.col("x").getField(c).alias(c) for c in ("turn", *MENTIONED)))
    so_far = context.select("key.conv_id", "value.*").where("size(firsts) > 0").select(
        "conv_id", (F.col("next") - 1).alias("turn"), F.lit("data").alias("route"), F.col("category").alias("own_category"),
        F.col("location").alias("own_location"), F.col("words").alias("own_words"), F.lit(False).alias("by_wording"), F.lit(False).alias("by_length"))
    rows = so_far.withColumn("given", F.lit(True)).unionByName(turns.withColumn("given", F.lit(False)))
    return fold_mentions(rows, keep=("given",)).where("NOT given").select(*COLUMNS)


def stream_context(questions: DataFrame, categories: dict[str, str], words: list[str],
                   idle_ms: int | None = None, first_turn: int = 0) -> DataFrame:
    """Streaming form of ``carry_context`` for turns numbered one by one from ``first_turn``.

    Set ``idle_ms`` for a query that runs for ever, so that conversations which
    ended are forgotten. A run over what is available now must leave it unset:
    a processing-time timer keeps asking for another batch. ``held_turns``
    gives what waits behind a gap when such a run has ended.

    The text is read by native expressions. Python only folds the small
    results of one conversation's new turns; ``maxFilesPerTrigger`` on the
    source bounds how many there are at a time.
    """
    keep_state_by_key(questions.sparkSession)
    read = mentions(questions, categories, words).select("conv_id", "turn", *MENTIONED)
    return read.groupBy("conv_id").transformWithState(
        Carry(idle_ms, first_turn), OUTPUT, "Append", "ProcessingTime" if idle_ms else "None")
