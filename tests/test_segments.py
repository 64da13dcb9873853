from __future__ import annotations

import datetime
import random

import numpy as np
import pytest

from tallyhouse.operators import carry
from tallyhouse.operators import segments as sg
from tallyhouse.sources.workspace import new_folder
from tallyhouse.streaming.activity import stream_segments
from tallyhouse.streaming.ingest import drain_to_parquet

RULES = sg.Rules(base=5.0, gap=10 * sg.SECOND, min_active=2, max_length=60 * sg.SECOND)
START = datetime.datetime(2024, 1, 1)


def events(seed=3):
    rng = random.Random(seed)
    out = []
    for user, n in ((1, 700), (2, 40), (3, 1)):
        at = 0.0
        for _ in range(n):
            at += rng.choice([0.5, 1, 2, 30 if rng.random() < 0.2 else 1])
            out.append((user, len(out), START + datetime.timedelta(seconds=at), rng.choice([1.0, 2.0, 8.0, 30.0])))
    return out


def by_hand(rows, rules):
    out = []
    for user in sorted({r[0] for r in rows}):
        recent, active = [], []
        for _, _, ts, value in sorted((r for r in rows if r[0] == user), key=lambda r: (r[2], r[1])):
            recent = (recent + [value])[-rules.window:]
            level = max(rules.base, 2 * np.percentile(recent, 20)) if len(recent) >= 10 else rules.base
            if value > level:
                active.append((int((ts - datetime.datetime(1970, 1, 1)).total_seconds() * 1e6), value))
        groups = []
        for us, value in active:
            if not groups or us - groups[-1][-1][0] > rules.gap:
                groups.append([])
            groups[-1].append((us, value))
        for g in groups:
            parts = {}
            for us, value in g:
                parts.setdefault((us - g[0][0]) // rules.max_length, []).append((us, value))
            for p in parts.values():
                if len(p) >= rules.min_active:
                    out.append((user, p[0][0], p[-1][0], len(p), max(v for _, v in p)))
    return sorted(out)


COLS = ["user_id", "start_us", "end_us", "n_active", "peak"]
SCHEMA = "user_id long, event_id long, ts timestamp_ntz, value double"


@pytest.mark.parametrize("chunk", [50, 64, 4096])
def test_equal_to_one_pass_per_key(spark, monkeypatch, chunk):
    monkeypatch.setattr(sg, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(carry, "FAN", 2 if chunk < 100 else carry.FAN)
    rows = events()
    got = sg.activity_segments(spark.createDataFrame(rows, SCHEMA), RULES).select(*COLS).collect()
    assert sorted(tuple(r) for r in got) == by_hand(rows, RULES)


@pytest.mark.parametrize("order", ["time", "any"])
def test_stream_in_batches(spark, order):
    rows = sorted(events(8), key=lambda r: r[2] if order == "time" else hash((r[1], 7)) % 1009)
    landing = new_folder(spark, "test-events")
    for lo in range(0, len(rows), 200):
        part = spark.createDataFrame(rows[lo:lo + 200], SCHEMA).coalesce(1)
        part.write.mode("append").parquet(landing)
    # A last event far ahead closes every segment.
    late = [(9, 9999, START + datetime.timedelta(days=1), 0.0)]
    spark.createDataFrame(late, SCHEMA).coalesce(1).write.mode("append").parquet(landing)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(landing)
    out = drain_to_parquet(stream_segments(stream, RULES, "1 minute" if order == "time" else "12 hours"), new_folder(spark, "test-seg"), new_folder(spark, "test-seg-state"))
    assert sorted(tuple(r) for r in out.select(*COLS).collect()) == by_hand(rows, RULES)


def test_stream_state_is_bounded(spark):
    """After a run, a key holds the rows that the watermark has not passed, and a window of values."""
    rows = sorted(events(8), key=lambda r: r[2])
    landing, state = new_folder(spark, "held-events"), new_folder(spark, "held-state")
    for lo in range(0, len(rows), 100):
        spark.createDataFrame(rows[lo:lo + 100], SCHEMA).coalesce(1).write.mode("append").parquet(landing)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(landing)
    drain_to_parquet(stream_segments(stream, RULES, "1 minute"), new_folder(spark, "held-seg"), state)

    def read(name):
        return spark.read.format("statestore").option("stateVarName", name).load(state)

    mark = max(r[2] for r in rows) - datetime.timedelta(minutes=1)
    waiting = {(r[0], r[1]) for r in rows if r[2] >= mark}
    held = read("held").selectExpr("key.user_id", "explode(user_map_value.ids) AS id").collect()
    assert {(r[0], r[1]) for r in held} == waiting and len(held) == len(waiting)
    sizes = {r[0]: r[1] for r in read("recent").groupBy("key.user_id").count().collect()}
    assert max(sizes.values()) <= RULES.window and sizes[1] == RULES.window
