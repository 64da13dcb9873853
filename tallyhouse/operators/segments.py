"""Activity segments in a series of measurements per key.

A value is active when it exceeds ``max(base, factor * noise)``, where the
noise is a low quantile of the latest values. Active values closer than the
gap form a segment; segments longer than the maximum are cut, and those with
too little activity are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions import vocab
from tallyhouse.operators.carry import before, carry_last
from tallyhouse.operators.ordered import with_running
from tallyhouse.sources.workspace import materialize

CHUNK_ROWS = 4096
SECOND = 1_000_000


@dataclass(frozen=True)
class Rules:
    """Times in microseconds; the defaults are those for 50 ms audio frames."""

    base: float = vocab.SPEECH_THRESHOLD
    factor: float = vocab.NOISE_FACTOR
    quantile: float = vocab.NOISE_QUANTILE
    window: int = vocab.NOISE_WINDOW
    min_history: int = vocab.NOISE_MIN_FRAMES
    gap: int = 2_500_000
    min_active: int = 6       # frames, 0.3 s
    max_length: int = 30 * SECOND


def micros(ts: Column) -> Column:
    """Microseconds since 1970, independent of the session's time zone."""
    second = F.extract(F.lit("SECOND"), ts)
    minutes = F.unix_date(F.to_date(ts)).cast("long") * 1440 + F.hour(ts) * 60 + F.minute(ts)
    return minutes * 60 * SECOND + (second * SECOND).cast("long")


def mark_active(df: DataFrame, rules: Rules, key: str = "user_id", tie: str = "event_id") -> DataFrame:
    """Adds ``us``, ``_ord``, ``_chunk`` and ``active`` to ``key, ts, value`` rows.

    Rows are numbered over the whole table, by key and time (``_ord``), and cut
    into chunks of consecutive ones. The rolling quantile needs the rows just
    before; each chunk gets copies of the last rows of the chunk before it, so
    neither a key nor an hour of it has to be sorted in one task.
    """
    timed = df.withColumn("us", micros(F.col("ts")))
    ranked = with_running(timed, [key, "us", tie], {"_ord": F.lit(1).cast("long")})
    home = F.floor(F.col("_ord") / CHUNK_ROWS)
    at_end = F.pmod("_ord", F.lit(CHUNK_ROWS)) >= CHUNK_ROWS - (rules.window - 1)
    copies = F.when(at_end, F.array(home, home + 1)).otherwise(F.array(home))
    spread = ranked.withColumn("_home", home).withColumn("_chunk", F.explode(copies))
    recent = Window.partitionBy(key, "_chunk").orderBy("_ord").rowsBetween(-(rules.window - 1), 0)
    noise = F.percentile("value", F.lit(rules.quantile)).over(recent)
    adaptive = F.greatest(F.lit(rules.base), noise * rules.factor)
    threshold = F.when(F.count("value").over(recent) >= rules.min_history, adaptive).otherwise(F.lit(rules.base))
    return spread.withColumn("active", F.col("value") > threshold).where("_chunk = _home").drop("_home")


def activity_segments(df: DataFrame, rules: Rules, key: str = "user_id", tie: str = "event_id") -> DataFrame:
    """Segments: key, start and end (microseconds), active rows, peak value."""
    rows = materialize(mark_active(df, rules, key, tie).where("active").select(
        key, "_ord", "_chunk", "us", "value"), "active")
    local = F.lag("us").over(Window.partitionBy(key, "_chunk").orderBy("_ord"))
    ends = rows.groupBy(key, "_chunk").agg(F.max("us").alias("_last"), F.lit(False).alias("_reset"))
    linked = rows.withColumn("_prev", local).join(before(ends, key, "_chunk", ["_last"], []), [key, "_chunk"])
    previous = F.coalesce("_prev", "_in__last")
    starts = linked.withColumn("starts", previous.isNull() | (F.col("us") - previous > rules.gap))
    framed = carry_last(
        starts.withColumnRenamed("_chunk", "piece"), key, "_ord", F.col("piece"),
        reset=F.col("starts"), last={"segment_start": F.when(F.col("starts"), F.col("us"))})
    part = F.floor((F.col("us") - F.col("segment_start")) / rules.max_length)
    return framed.groupBy(key, "segment_start", part.alias("part")).agg(
        F.min("us").alias("start_us"), F.max("us").alias("end_us"),
        F.count("*").alias("n_active"), F.max("value").alias("peak"),
    ).where(F.col("n_active") >= rules.min_active).drop("segment_start", "part")
