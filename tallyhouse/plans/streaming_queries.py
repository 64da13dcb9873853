"""Registered queries: activity segments and streams."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.vocab import RAW_COLUMNS
from tallyhouse.operators.segments import SECOND, Rules, activity_segments, mark_active
from tallyhouse.plans import question_sql as s
from tallyhouse.plans.cleaning_queries import TYPED_SQL
from tallyhouse.plans.registry import query
from tallyhouse.plans.views import view
from tallyhouse.sources.tables import table
from tallyhouse.sources.workspace import new_folder
from tallyhouse.streaming.activity import stream_segments, stream_sessions
from tallyhouse.streaming.context import held_turns, stream_context
from tallyhouse.streaming.ingest import drain_to_parquet, drop_repeats, ingest, read_new_files

HOUR = 3600 * SECOND
# Events come hours apart, so the times are hours instead of seconds.
RULES = Rules(base=15.0, gap=12 * HOUR, min_active=2, max_length=72 * HOUR)
DELAY_HOURS = 1
FIXED = 40.0
T = TypeVar("T")


def read_stream(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table as a file stream."""
    schema = table(spark, root, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(f"{root}/{name}.parquet*")


def in_turns(slices: Iterable[DataFrame], write: Callable[[DataFrame], None], run: Callable[[], T]) -> T:
    """What ``run`` returns after the last slice. A slice is written by as many tasks as it has and is all that a run finds
    new, so it makes one batch; runs go on from the checkpoint of the run before."""
    for part in slices:
        write(part)
        found = run()
    return found


def disordered(spark: SparkSession, root: str, slices: int = 4) -> list[DataFrame]:
    """Events in slices, in which rows arrive up to ``DELAY_HOURS`` out of order."""
    late = F.unix_micros(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(DELAY_HOURS * HOUR))
    events = table(spark, root, "events").withColumn("arrives", late)
    edges = events.agg(*(F.percentile_approx("arrives", k / slices).alias(f"e{k}") for k in range(1, slices))).first()
    return [events.where((F.lit(low is None) | (F.col("arrives") > F.lit(low))) & (F.lit(high is None) | (F.col("arrives") <= F.lit(high)))).drop("arrives")
            for low, high in zip([None, *edges], [*edges, None])]


_NOISE = """SELECT *, epoch_us(ts) AS us, quantile_cont(value, 0.2) OVER w AS q, count(*) OVER w AS n
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"""
_ACTIVE = f"""noise AS ({_NOISE}), act AS (SELECT * FROM noise
  WHERE value > CASE WHEN n >= 10 THEN greatest(15.0e0, 2 * q) ELSE 15.0e0 END)"""


def _segments_sql(source: str) -> str:
    return f"""st AS (SELECT *, CASE WHEN us - lag(us) OVER u <= {12 * HOUR} THEN 0 ELSE 1 END AS starts FROM {source}
  WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
seg AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seg FROM st),
org AS (SELECT *, min(us) OVER (PARTITION BY user_id, seg) AS origin, max(us) OVER (PARTITION BY user_id, seg) AS seg_last,
    max(seg) OVER (PARTITION BY user_id) AS last_seg FROM seg)"""


_PIECES = f"""SELECT user_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n_active, max(value) AS peak,
    seg, seg_last, last_seg, cast(floor((us - origin) / {72 * HOUR}) AS bigint) AS part
  FROM org GROUP BY user_id, seg, seg_last, last_seg, part HAVING count(*) >= 2"""


@query("rolling_noise_level", f"WITH {_ACTIVE} SELECT user_id, event_id, us FROM act")
def _(spark, root):
    return mark_active(table(spark, root, "events"), RULES).where("active").select("user_id", "event_id", "us")


@query("activity_segments", f"""
WITH {_ACTIVE}, {_segments_sql('act')}
SELECT user_id, start_us, end_us, n_active, peak FROM ({_PIECES}) p""")
def _(spark, root):
    events = table(spark, root, "events").select("user_id", "event_id", "ts", "value")
    return activity_segments(events, RULES)


# Watermarks are kept in milliseconds.
_WATERMARK = f"((SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events) - {DELAY_HOURS * HOUR})"


# Rows behind the watermark are still held back at the end.
@query("stream_activity_segments", f"""
WITH {_ACTIVE}, due AS (SELECT * FROM act WHERE us < {_WATERMARK}), {_segments_sql('due')}, lastpart AS (SELECT *, max(part) OVER (PARTITION BY user_id, seg) AS max_part FROM ({_PIECES}) p)
SELECT user_id, start_us, end_us, n_active, peak FROM lastpart
WHERE seg < last_seg OR seg_last + {12 * HOUR} < {_WATERMARK}
   OR EXISTS (SELECT 1 FROM org o WHERE o.user_id = lastpart.user_id AND o.seg = lastpart.seg AND o.us > lastpart.end_us)""")
def _(spark, root):
    events, landing = disordered(spark, root), new_folder(spark, "disordered")
    target, state = new_folder(spark, "segments"), new_folder(spark, "segments-state")

    def run() -> DataFrame:
        stream = spark.readStream.schema(events[0].schema).parquet(landing)
        return drain_to_parquet(stream_segments(stream, RULES, f"{DELAY_HOURS} hours"), target, state)

    return in_turns(events, lambda part: part.write.mode("append").parquet(landing), run)


# Spark filters inactive rows before it tracks the watermark.
@query("stream_session_windows", f"""
WITH act AS (SELECT *, epoch_us(ts) AS us FROM events WHERE value > {FIXED}e0), {_segments_sql('act')}
SELECT user_id, min(us) AS start_us, max(us) + {12 * HOUR} AS end_us, count(*) AS n_active, max(value) AS peak
FROM org GROUP BY user_id, seg HAVING max(us) + {12 * HOUR} <= {_WATERMARK.replace("FROM events", "FROM act")}""")
def _(spark, root):
    found = stream_sessions(read_stream(spark, root, "events"), FIXED, "12 hours", f"{DELAY_HOURS} hours")
    return drain_to_parquet(found, new_folder(spark, "sessions"), new_folder(spark, "sessions-state"))


@query("stream_context", s.CONTEXT + " SELECT conv_id, turn, route, category, location, words FROM ctx")
def _(spark, root):
    asked, landing = view(spark, root, "questions"), new_folder(spark, "questions")
    target, state = new_folder(spark, "context"), new_folder(spark, "context-state")
    # Later turns arrive first.
    slices = [asked.where(F.least(F.col("turn") / 2, F.lit(2)).cast("int") == part) for part in (1, 0, 2)]

    def run() -> DataFrame:
        stream = spark.readStream.schema(asked.schema).parquet(landing)
        return drain_to_parquet(stream_context(stream, s.CATEGORIES, s.WORDS), target, state)

    found = in_turns(slices, lambda part: part.write.mode("append").parquet(landing), run)
    return found.unionByName(held_turns(spark, state))


_LEVEL = """CASE WHEN rating > 0 AND rating <= 4.0 THEN 'Poor' WHEN rating > 4.0 AND rating <= 4.3 THEN 'Average'
  WHEN rating > 4.3 AND rating <= 4.6 THEN 'Good' WHEN rating > 4.6 AND rating <= 5.1 THEN 'Excellent' END"""


# Three slices, a batch each; products come again in later ones.
FILES = 3


@query("stream_raw_ingest", f"""
WITH {TYPED_SQL}, f AS (SELECT t.*, r.scraped_at, r.row_id % {FILES} AS file FROM typed t JOIN raw_listings r ON r.row_id = t.row_id),
m AS (SELECT file, median(price) AS middle FROM f GROUP BY file),
c AS (SELECT asin, category, coalesce(price, middle) AS price, coalesce(rating, 4.5e0) AS rating,
  coalesce(review_count, 0e0) AS review_count, scraped_at, f.file FROM f JOIN m ON m.file = f.file)
SELECT asin, category, price, rating, review_count, scraped_at, {_LEVEL} AS satisfaction_level FROM c
QUALIFY row_number() OVER (PARTITION BY asin ORDER BY file, scraped_at) = 1""")
def _(spark, root):
    landing, target, archive, state = (new_folder(spark, x) for x in ("landing", "ingested", "archive", "ingest-state"))
    raw = view(spark, root, "raw_listings")
    slices = [raw.where(F.col("row_id") % FILES == file).select(*RAW_COLUMNS) for file in range(FILES)]
    in_turns(slices, lambda part: part.write.mode("append").option("header", True).option("escape", '"').csv(landing),
             lambda: ingest(read_new_files(spark, landing, archive=archive), target, state).awaitTermination())
    return spark.read.parquet(target).select(
        "asin", "category", "price", "rating", "review_count", "scraped_at", "satisfaction_level")


@query("stream_drop_repeats", "SELECT DISTINCT product_id FROM raw_listings")
def _(spark, root):
    landing = new_folder(spark, "landing")
    view(spark, root, "raw_listings").select(*RAW_COLUMNS).write.option("header", True).option("escape", '"').csv(landing)
    kept = drop_repeats(read_new_files(spark, landing), "30 days").select("product_id")
    return drain_to_parquet(kept, new_folder(spark, "kept"), new_folder(spark, "kept-state"))
