from __future__ import annotations

import os
import random
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyhouse.functions import questions as q
from tallyhouse.functions import vocab
from tallyhouse.operators import context as ctx
from tallyhouse.streaming.context import Carry, held_turns, stream_context
from tallyhouse.streaming.ingest import drain_to_parquet
from tallyhouse.sources.workspace import new_folder


def over(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]


def test_place_names(spark):
    given = ["Melbourne", "port'ta kaç", "pörtte pörtte pörtte", "siz neydi", "sydney'de var", "export", "körte"]
    want = ["melbourne", "perth kaç", "perth perth perth", "sydney", "sydney var", "export", "perth"]
    assert over(spark, given, q.normalize_text) == want


def test_words_are_whole_unless_asked(spark):
    assert over(spark, ["every revenue", "ev eşyası"], lambda t: q.map_category(t, vocab.CATEGORY_WORDS)) == [None, "Home & Kitchen"]
    assert over(spark, ["every"], lambda t: q.map_category(t, vocab.CATEGORY_WORDS, whole=False)) == ["Home & Kitchen"]
    assert over(spark, ["wireless headphones"], lambda t: q.found_in_order(t, vocab.PRODUCT_WORDS)) == [["headphones", "wireless"]]


def test_words_as_by_pattern(spark):
    """The words seen in one pass give what a search for each pattern gives, whatever stands between them."""
    rng = random.Random(11)
    variants = [v for some in vocab.PLACE_VARIANTS.values() for v in some]
    bits = [*vocab.CATEGORY_WORDS, *vocab.PRODUCT_WORDS, *variants, "every", "evet", "tvs", "e", "reader", "de", "siz", "port", "apple", "fire", "x"]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", " ", "'", "\n", ".", "-", "é", "", "\u2028", "  "]) for _ in range(rng.randrange(1, 9)))
             for _ in range(600)] + ["", None, "\n", "fire tv", "fire  tv", "e-reader\n", "sydney'de", "siz neydi siz ney"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    t = F.col("t")
    tests = {f"w{i}": (q.has_word(t, [w]), F.coalesce(F.rlike(t, F.lit(q.word_pattern([w]))), F.lit(False)))
             for i, w in enumerate([*vocab.PRODUCT_WORDS, *vocab.CATEGORY_WORDS])}
    tests["any"] = (q.has_word(t, vocab.PRODUCT_WORDS), F.coalesce(F.rlike(t, F.lit(q.word_pattern(vocab.PRODUCT_WORDS))), F.lit(False)))
    slow = F.lower(t)
    for place, some in vocab.PLACE_VARIANTS.items():
        for _ in range(2):
            slow = F.regexp_replace(slow, q.word_pattern(some), f"$1{place}$3")
    tests["norm"] = (q.normalize_text(t), slow)
    mask = sum((F.when(F.rlike(t, F.lit(q.word_pattern([w]))), 1 << i).otherwise(0).cast("long") for i, w in enumerate(vocab.PRODUCT_WORDS)), F.lit(0))
    tests["mask"] = (ctx.word_mask(t, vocab.PRODUCT_WORDS), mask)
    differ = df.select("t", *(F.array_compact(F.array(*[F.when(~a.eqNullSafe(b), F.lit(n)) for n, (a, b) in tests.items()])).alias("bad"),)).where("size(bad) > 0")
    assert differ.collect() == []
    with pytest.raises(ValueError):
        ctx.word_mask(t, [f"w{i}" for i in range(64)])


def test_bounds(spark):
    assert over(spark, ["rating > 4.5", "rating 4.2 üstü", "4 üzeri rating", "none"],
                lambda t: q.number(t, vocab.RATING_PATTERNS)) == [4.5, 4.2, 4.0, None]
    assert over(spark, ["price >= 20", "fiyat 30 dolar", "50 $ üzeri price"], lambda t: q.number(t, vocab.PRICE_PATTERNS)) == [20.0, 30.0, 50.0]
    assert over(spark, ["stok 100 üstü", "stock above 7"], lambda t: q.number(t, vocab.STOCK_PATTERNS)) == [100.0, 7.0]
    assert over(spark, ["5 tane", "top 7", "none"], q.extract_limit) == [5, 7, None]


def test_keywords_are_literal(spark):
    assert over(spark, ["usb-c (2m)", "usb c", None], lambda t: q.contains_any(t, ["(2m)", "a|b"])) == [True, False, False]


@pytest.mark.parametrize("variant,want", [
    ("realtime", "Bold it 5 dollars 3 not available"), ("simple", "Bold it 5$3 N/A"), ("browser", "Bold it 5$3 N/A")])
def test_markup(spark, variant, want):
    assert over(spark, ["**Bold** *it* 5$3 N/A"], lambda t: q.strip_markup(t, variant)) == [want]


# --- context against a turn-by-turn reading of the rules ---------------------

TEXTS = [
    "how many books in sydney", "in perth", "peki brisbane", "list all kindle", "show echo", "sadece laptop göster",
    "transfer 5 from sydney to perth", "where should i go", "kaç tane", "total tablet melbourne'da var mı bir de",
    "hello there", "which product is cheapest", "bunları göster", "list electronics mouse",
]
WORDS = ["kindle", "echo", "laptop", "tablet", "mouse"]


def by_hand(rows):
    state, out = {"category": None, "location": None, "words": set()}, []
    for r in rows:
        had = bool(state["category"] or state["location"] or state["words"])
        follow = r["by_wording"] or (r["by_length"] and had)
        if r["route"] == "data":
            old = state if follow else {"category": None, "location": None, "words": set()}
            own = set(ctx_words(r["own_words"]))
            place = r["own_location"]
            state = {
                "category": r["own_category"] or old["category"],
                "location": old["location"] if place is None else (place or None),
                "words": own | old["words"],
            }
        out.append((r["conv_id"], r["turn"], state["category"], state["location"], frozenset(state["words"]), follow))
    return out


def ctx_words(mask):
    return [w for i, w in enumerate(WORDS) if mask >> i & 1]


def questions(spark, seed=5):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(TEXTS)) for c in range(8) for t in range(40 if c == 0 else rng.randrange(1, 9))]
    return spark.createDataFrame(rows, "conv_id long, turn long, text string")


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_context_matches_turn_by_turn(spark, monkeypatch, chunk):
    monkeypatch.setattr(ctx, "CHUNK_TURNS", chunk)
    asked = questions(spark)
    told = ctx.mentions(asked, vocab.CATEGORY_WORDS, WORDS).orderBy("conv_id", "turn").collect()
    want = []
    for conv in sorted({r["conv_id"] for r in told}):
        want += by_hand([r for r in told if r["conv_id"] == conv])
    got = ctx.with_follow_up(ctx.carry_context(asked, vocab.CATEGORY_WORDS, WORDS)).orderBy("conv_id", "turn").collect()
    assert [(r["conv_id"], r["turn"], r["category"], r["location"], frozenset(ctx_words(r["words"])), r["is_follow_up"])
            for r in got] == want


@pytest.mark.parametrize("parts", [((0, 3), (3, 10), (10, 99)), ((10, 99), (1, 3), (3, 10), (0, 1))])
def test_stream_in_several_batches(spark, parts):
    asked = questions(spark, 9)
    landing = new_folder(spark, "test-questions")
    for lo, hi in parts:
        asked.where(f"turn >= {lo} AND turn < {hi}").coalesce(1).write.mode("append").parquet(landing)
    stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    out = drain_to_parquet(stream_context(stream, vocab.CATEGORY_WORDS, WORDS),
                           new_folder(spark, "test-context"), new_folder(spark, "test-state"))
    cols = ["conv_id", "turn", "route", "category", "location", "words"]
    want = ctx.carry_context(asked, vocab.CATEGORY_WORDS, WORDS).select(*cols)
    assert sorted(map(str, out.select(*cols).collect())) == sorted(map(str, want.collect()))


def test_stream_with_gaps(spark):
    """Conversations without their first turn or one within: no turn is lost, and a gap may be filled later."""
    asked = questions(spark, 9)
    late = "(conv_id % 3 = 0 AND turn = 0) OR (conv_id % 3 = 1 AND turn IN (2, 3))"
    landing, target, state = (new_folder(spark, x) for x in ("gap-questions", "gap-context", "gap-state"))
    cols = ["conv_id", "turn", "route", "category", "location", "words"]
    for part, given in ((f"NOT ({late})", asked.where(f"NOT ({late})")), (late, asked)):
        asked.where(part).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(asked.schema).parquet(landing)
        out = drain_to_parquet(stream_context(stream, vocab.CATEGORY_WORDS, WORDS), target, state).unionByName(held_turns(spark, state))
        want = ctx.carry_context(given, vocab.CATEGORY_WORDS, WORDS).select(*cols)
        assert sorted(map(str, out.select(*cols).collect())) == sorted(map(str, want.collect()))
    assert not held_turns(spark, state).count()


def test_stream_without_files(spark, tmp_path):
    asked = questions(spark, 1)
    state = new_folder(spark, "no-state")
    stream = spark.readStream.schema(asked.schema).parquet(str(tmp_path))
    out = drain_to_parquet(stream_context(stream, vocab.CATEGORY_WORDS, WORDS), new_folder(spark, "no-context"), state)
    assert out.unionByName(held_turns(spark, state)).count() == 0


def test_gap_released_by_timer(spark):
    """A query that runs for ever lets waiting turns go when nothing has come for a while, and forgets the conversation."""
    asked = questions(spark, 9).where("conv_id < 3 AND turn > 0")
    landing, target, state = (new_folder(spark, x) for x in ("timer-questions", "timer-context", "timer-state"))
    asked.coalesce(1).write.parquet(landing)
    stream = stream_context(spark.readStream.schema(asked.schema).parquet(landing), vocab.CATEGORY_WORDS, WORDS, idle_ms=2000)
    running = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", state).trigger(
        processingTime="1 second").start()
    want = ctx.carry_context(asked, vocab.CATEGORY_WORDS, WORDS)
    try:
        for _ in range(60):
            time.sleep(1)
            out = spark.read.schema(stream.schema).parquet(target) if os.path.isdir(target) else None
            if out is not None and out.count() == want.count():
                break
    finally:
        running.stop()
    cols = ["conv_id", "turn", "route", "category", "location", "words"]
    assert sorted(map(str, out.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))


def test_a_conversation_without_gaps_asks_the_state_twice():
    """Rows go in and out one by one, without a frame for each conversation; no turn waits, so only the context is kept."""
    calls = []

    class State:
        def get(self):
            calls.append("get")

        def update(self, value):
            calls.append("update")

    class Handle:
        def getValueState(self, *given):
            return State()

        def getMapState(self, *given):
            return None

    carry = Carry(None, 0)
    carry.init(Handle())
    rows = [Row(conv_id=7, turn=t, route="data", own_category="c" if t == 0 else None, own_location=None, own_words=1 << t,
                by_wording=t > 0, by_length=False) for t in (2, 0, 1)]
    found = list(carry.handleInputRows((7,), iter(rows), None))
    assert [(r.conv_id, r.turn, r.category, r.words) for r in found] == [(7, 0, "c", 1), (7, 1, "c", 3), (7, 2, "c", 7)]
    assert calls == ["get", "update"]
