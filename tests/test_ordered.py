"""Running totals, carried state and substring search in bounded pieces."""

from __future__ import annotations

import io
import random
from contextlib import redirect_stdout

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyhouse.operators import carry, grams
from tallyhouse.operators.context import category_named
from tallyhouse.operators.ordered import with_running
from tallyhouse.sources.pages import quota_groups


def plan_of(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_running_equals_one_window(spark, ranges):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None, "é"]), rng.choice([1, 2, None, 7]), rng.randrange(10)) for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, v long, n long").repartition(5)
    got = with_running(df, ["k", "v"], {"before": F.col("n"), "place": F.lit(1)}, ranges)
    assert "SinglePartition" not in plan_of(got)
    out = sorted(got.collect(), key=lambda r: r.place)
    assert [r.place for r in out] == list(range(500))
    total, last = 0, None
    for r in out:
        key = (r.k is not None, (r.k or "").encode(), r.v is not None, r.v or 0)
        assert r.before == total and (last is None or last <= key)
        total, last = total + r.n, key
    assert sorted((str(r.k), str(r.v), r.n) for r in out) == sorted((str(k), str(v), n) for k, v, n in rows)


def test_running_over_equal_and_no_rows(spark):
    same = spark.range(1000).select(F.lit("x").alias("k"))
    got = with_running(same, ["k"], {"place": F.lit(1)}, 8)
    assert sorted(r.place for r in got.collect()) == list(range(1000))
    assert with_running(same.where("k = 'y'"), ["k"], {"place": F.lit(1)}).count() == 0


def test_quota_over_a_million_groups(spark):
    """Every group has one row, so the first ``target`` groups in order stay."""
    n = 1_000_000
    rows = spark.range(n).select(F.concat(F.lit("g"), "id").alias("category"), (F.lit(n) - F.col("id")).alias("at"))
    kept = quota_groups(rows, "at", 300_000)
    assert "SinglePartition" not in plan_of(kept)
    found = kept.agg(F.count("*").alias("n"), F.min(F.substr("category", F.lit(2)).cast("long")).alias("least")).first()
    assert (found.n, found.least) == (300_000, n - 300_000)


@pytest.mark.parametrize("fan, chunk", [(2, 1), (2, 3), (3, 7), (1024, 4)])
def test_one_key_over_many_levels(spark, monkeypatch, fan, chunk):
    """64 chunks of one row with a fan of two are six levels; the outcome is that of one window."""
    rng = random.Random(fan * 10 + chunk)
    rows = [(k, i, rng.random() < 0.05, rng.choice([None, None, None, i]), rng.choice([0, 0, 1 << rng.randrange(8)]))
            for k in (1, 2) for i in (range(64) if k == 1 else range(-2, 5))]
    df = spark.createDataFrame(rows, "k long, i long, fresh boolean, v long, bits long")
    levels = []
    real = carry.before
    monkeypatch.setattr(carry, "before", lambda *a, **b: levels.append(1) or real(*a, **b))
    got = carry.carry_last(df, "k", "i", F.floor(F.col("i") / chunk), F.col("fresh"), {"latest": F.col("v")}, {"all": F.col("bits")}, fan)
    out = {(r.k, r.i): (r.latest, r["all"]) for r in got.collect()}
    if (fan, chunk) == (2, 1):
        assert len(levels) >= 3
    for k in (1, 2):
        latest, bits = None, 0
        for _, i, fresh, v, b in (r for r in rows if r[0] == k):
            latest, bits = (None, 0) if fresh else (latest, bits)
            latest, bits = latest if v is None else v, bits | b
            assert out[k, i] == (latest, bits)


def test_substring_join(spark):
    rng = random.Random(3)
    letters = "abcé'😀 "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(12))) for _ in range(300)] + ["aaaa", "", None]
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(6))) for _ in range(80)] + ["", None, "aaa", "zzz", "a"]
    t, w = spark.createDataFrame([(x,) for x in texts], "text string"), spark.createDataFrame([(x,) for x in words], "word string")
    want = {(x, y) for x in texts for y in words if x and y and y in x}
    for split in (1, 7, 4096):
        got = [tuple(r) for r in grams.containing(t, w, split).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_a_run_that_every_text_has(spark):
    """Words are looked up under rarer runs, and where there is none the texts are split by their hash."""
    texts = spark.range(3000).select(F.concat(F.lit("ring "), F.format_string("%05d", "id")).alias("text"))
    words = spark.createDataFrame([("ring 00017",), ("ing",), ("ring 1",)], "word string")
    got = grams.containing(texts, words, 100)
    counts = {r.word: r.n for r in got.groupBy("word").agg(F.count("*").alias("n")).collect()}
    assert counts == {"ring 00017": 1, "ing": 3000}
    split = texts.select(F.pmod(F.xxhash64("text"), F.lit(30)).alias("s")).groupBy("s").count().agg(F.max("count")).first()[0]
    assert split < 1000


def test_category_words(spark):
    products = spark.createDataFrame(
        [(5, "Home & Kitchen"), (2, "Pet Supplies"), (9, "Kitchen Tools"), (1, None), (7, "Home & Kitchen"), (3, "Toys  Games")],
        "row_id long, category string")
    texts = ["petty cash", "my kitchen", "tools", "games & toys", "nothing", "", None, "pet supplies", "homes", "kitchen pet"]
    asked = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)] + [(1, 0, "toolset")], "conv_id long, turn long, norm string")
    got = sorted((r.conv_id, r.category) for r in category_named(asked, products).collect())
    order = ["Pet Supplies", "Toys  Games", "Home & Kitchen", "Kitchen Tools"]
    want = [(i, c) for i, t in [*enumerate(texts), (1, "toolset")] if t is not None
            for c in [next((c for c in order if any(w in t for w in c.lower().split())), None)] if c]
    assert got == sorted(want)
