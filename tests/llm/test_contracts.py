"""Each contract against its plain form, on a table with every awkward case; and on tables without rows."""

from __future__ import annotations

import math
from collections import Counter

import brute
import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyhouse.llm import blocks, debruijn, lm_scoring, queries


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, folder, name):
    df = queries.QUERIES[name](spark, folder["empty"])
    assert df.columns and df.count() == 0


def test_op1(spark, folder, texts):
    got = queries.op1_lm_scoring(spark, folder["full"]).collect()
    assert len(got) == len(texts)
    tokens = lambda t: [*brute.words(t, lower=True), None]
    train = Counter(w for i, t in texts if brute.fold(i, 5) != 1 for w in tokens(t))
    n, v = sum(train.values()), len(train)
    want = Counter()
    for i, t in texts:
        w = tokens(t)
        base = sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        want[i, brute.fold(i, 5) == 1, len(w), sum(train[x] > 0 for x in w), n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def few(spark, texts):
    rows = [(i, t) for i, t in texts if len(t or "") < 3000]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(2)


@pytest.mark.parametrize("order, fan, block_bytes", [(1, 1024, 1 << 22), (2, 1024, 1 << 22), (2, 3, 300), (3, 2, 700)])
def test_op1_score(spark, texts, order, fan, block_bytes):
    """Against dictionaries and EM without cells; blocks of a few texts, of which some hold held-out rows only, and
    several levels of groups."""
    rows, df = few(spark, texts)
    part = lm_scoring.fold("doc_id", 5)
    got = lm_scoring.lm_scores(df, part != 1, part == 0, order=order, fan=fan, block_bytes=block_bytes).collect()
    want = brute.lm_scores(rows, order, lambda i: brute.fold(i, 5) != 1, lambda i: brute.fold(i, 5) == 0)
    key = lambda x: (repr(x[0]), x[1])
    pairs = list(zip(sorted(((r.doc_id, r.score) for r in got), key=key), sorted(((i, s) for (i, _), s in zip(rows, want)), key=key)))
    assert len(got) == len(rows)
    for (i, a), (j, b) in pairs:
        assert i == j and math.isclose(a, b, rel_tol=2e-3, abs_tol=2e-3), (i, a, b)


@pytest.mark.parametrize("train, tune", [("doc_id >= 0", "false"), ("false", "false"), ("doc_id % 2 = 0", "doc_id % 4 = 0")])
def test_op1_without_tuning_or_training_rows(spark, texts, train, tune):
    rows, df = few(spark, texts)
    marks = {"false": lambda i: False, "doc_id >= 0": lambda i: i is not None,
             "doc_id % 2 = 0": lambda i: i is not None and i % 2 == 0, "doc_id % 4 = 0": lambda i: i is not None and i % 4 == 0}
    got = lm_scoring.lm_scores(df, F.expr(train), F.expr(tune), block_bytes=500, fan=2).collect()
    want = brute.lm_scores(rows, 2, marks[train], marks[tune])
    assert math.isclose(sum(r.score for r in got), sum(want), rel_tol=1e-3)
    assert len(got) == len(rows) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)


def test_blocks_grow_in_proportion(spark, texts):
    """Twice the blocks ask with at most twice the cells, on each level; many levels answer as one does."""
    _, df = few(spark, texts)
    df = df.unionByName(df).unionByName(df).coalesce(2)
    made, found = [], []
    for size in (1600, 800, 400):
        table = blocks.write_blocks(df.select("doc_id", "text"), "test", block_bytes=size)
        fan = 4
        marked_rows = table.df.withColumns({"train": F.lit(True), "kept": F.lit(True)})
        ask = lambda n: lambda t: lm_scoring.request(n, 1, t)
        asked = marked_rows.groupBy("block").applyInArrow(ask(table.ranges(fan)), blocks.CELLS)
        assert table.n > fan**2
        made.append(asked.count() / table.df.select("block").distinct().count())
        replies = blocks.lookup(asked, lm_scoring.TOTALS, table, fan).collect()
        marked = [blocks.unplanes(r.reply).reshape(-1, r.n)[0] for r in replies]
        found.append((sum(int((m & 1).sum()) for m in marked), sum(int((m >> 1)[m & 1 == 1].sum()) for m in marked)))
    words = Counter(w for i, t in texts if len(t or "") < 3000 for w in [*brute.words(t, lower=True), None])
    assert found == [(len(words), 3 * sum(words.values()))] * 3
    assert max(made) <= fan


def test_op5_against_a_plain_solve(spark, folder, texts):
    """The same features, solved by a library on all rows at once, and calibrated by pooling pairs until none is out of
    order; on the awkward table, with labels that repeat and contradict."""
    import numpy as np
    import pyarrow as pa

    from tallyhouse.llm import quality

    rng = np.random.default_rng(0)
    ids = [i for i, _ in texts if i is not None]
    marks = [(int(i), int(rng.random() < 0.5), 0) for i in ids for _ in range(2)] + [(None, 1, 0), (20, None, 0), (999, 1, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    docs = spark.read.parquet(folder["full"] + "/documents.parquet")
    part = F.pmod(F.col("doc_id"), F.lit(3))
    got = quality.scores(docs, labels, part < 2, part == 2, keep=("doc_id", "text"))
    x = quality.statistics(pa.array([t for _, t in texts], pa.large_string()))
    rows = {"fit": [], "calibrate": []}
    for i, y, _ in marks:
        for k, (j, _) in enumerate(texts):
            if i is not None and j == i and y is not None:
                rows["fit" if i % 3 < 2 else "calibrate"].append((k, y))
    at, y = np.array([k for k, _ in rows["fit"]]), np.array([y for _, y in rows["fit"]], float)
    kernel = quality.Kernel(x[at].mean(axis=0), x[at].std(axis=0))
    z = kernel(x)
    penalty = np.sqrt(quality.RIDGE * len(at) * np.diag([1.0] * quality.FEATURES + [0.0]) + 1e-9 * np.eye(quality.FEATURES + 1))
    weights = np.linalg.lstsq(np.vstack([z[at], penalty]), np.concatenate([y, np.zeros(len(penalty))]), rcond=None)[0]
    raw = z @ weights
    width = (quality.HIGH - quality.LOW) / (quality.BINS - 1)
    bins: dict = {}
    for k, y in rows["calibrate"]:
        b = math.floor((min(max(raw[k], quality.LOW), quality.HIGH) - quality.LOW) / width + 0.5)
        bins.setdefault(b, []).append(y)
    pools = [([b * width + quality.LOW] * len(v), v) for b, v in sorted(bins.items())]
    mean = lambda v: sum(v) / len(v)
    while (bad := next((i for i in range(len(pools) - 1) if mean(pools[i][1]) >= mean(pools[i + 1][1])), None)) is not None:
        pools[bad : bad + 2] = [(pools[bad][0] + pools[bad + 1][0], pools[bad][1] + pools[bad + 1][1])]
    want = np.interp(raw, [mean(p) for p, _ in pools], [mean(v) for _, v in pools])
    expected = Counter((repr(i), t, round(float(s), 2)) for (i, t), s in zip(texts, want))
    found = Counter((repr(r.doc_id), r.text, round(r.score, 2)) for r in got.collect())
    assert sum((found - expected).values()) <= 0.05 * len(texts)  # a score on a bin's edge may fall either way


def test_op3(spark, folder, texts):
    got = queries.op3_simhash(spark, folder["full"])
    ids = [(i, brute.fingerprint(t)) for i, t in texts]
    roots = brute.component_ids([(math.inf if i is None else i, fp) for i, fp in ids])
    want = sorted(((i, f"{fp:016x}", None if r == math.inf else r) for (i, fp), r in zip(ids, roots)), key=repr)
    assert rows_of(got) == want


def test_op6(spark, folder, texts, leak):
    items = [(1, leak), (2, "one two"), ("", "zeta"), (5, leak), (6, " ".join(leak.split()[2:16])), (7, "x1 of the and")]
    want = sorted(((i, *x) for (i, t), x in zip(texts, brute.decontaminate([t for _, t in texts], items))), key=repr)
    assert rows_of(queries.op6_decontamination(spark, folder["full"])) == want


def test_op8(spark, folder, texts):
    want = sorted(((i, *x) for (i, _), x in zip(texts, brute.substring_dedup([t for _, t in texts]))), key=repr)
    assert rows_of(queries.op8_substring_dedup(spark, folder["full"])) == want


def test_op8_spans_follow_unitigs(spark):
    """A passage that some documents share whole and others in part is one unitig of several paths, and one span where
    it is whole; small blocks and a small fan give the same rows."""
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(200)]
    own = lambda n: [word() for _ in range(n)]
    texts = [[*own(20), *passage, *own(20)] for _ in range(3)] + [[*own(9), *passage[:120], *own(9)], [*own(9), *passage[60:], *own(9)]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    table = blocks.write_blocks(df, "spans", block_bytes=2500)
    spans = debruijn.repeated_spans(table).join(table.df.select("block", "row", "doc_id"), ["block", "row"]).collect()
    assert {s.unitig for s in spans} and len({s.unitig for s in spans}) == 1
    assert sorted((s.doc_id, s.start, s.n_words) for s in spans) == [(0, 20, 200), (1, 20, 200), (2, 20, 200), (3, 9, 120), (4, 9, 140)]
    assert {s.n_paths for s in spans if s.doc_id < 3} == {3}
    got = rows_of(debruijn.dedup_substrings(df))
    assert got == sorted(((i, *x) for (i, _), x in zip(rows, brute.substring_dedup([t for _, t in rows]))), key=repr)


def test_op8_pieces_are_distinct_in_a_block():
    """Near copies that branch at every word: a block joins a row for each different path, which holds all its places."""
    import numpy as np
    import pyarrow as pa

    from tallyhouse.llm import words as W

    k, passage = 4, [f"w{i}" for i in range(30)]
    texts = [" ".join([*passage[:i], f"own{i}", *passage[i + 1 :]]) for i in range(20)] + ["same " * 9] * 2
    table = pa.table({"text": texts, "block": pa.array([7] * len(texts)), "row": pa.array(range(100, 100 + len(texts)))})
    t = W.split(table["text"])
    hashes = W.word_hashes(t)
    replies = []
    for kind, n in ((0, k), (1, k - 1)):
        keys, whole = debruijn.windows(hashes, t.doc, n)
        keys = np.unique(keys[whole])
        replies.append({"block": 7, "bucket": 0, "n": len(keys), "reply": blocks.planes(np.diff(keys, prepend=np.uint64(0))), "kind": kind})
    got = debruijn.cut(k, table, pa.Table.from_pylist(replies)).to_pylist()
    want = [w[i : i + k] for w in map(str.split, texts) for i in range(len(w) - k + 1)]
    assert len(got) == len({r["digest"] for r in got}) == len(set(map(tuple, want))) < len(want) / 2
    places = [(row, start + i) for r in got for row, start, n in zip(r["rows"], r["starts"], r["runs"]) for i in range(n)]
    assert sorted(places) == [(100 + d, i) for d, w in enumerate(map(str.split, texts)) for i in range(len(w) - k + 1)]
    assert all(r["copies"] == sum(r["runs"]) and r["edges"] == 1 for r in got)


def test_op8_workers_give_back_memory(monkeypatch):
    """What a block's work has freed returns to the system when the block is done, also when the work fails."""
    from tallyhouse.llm import words as W

    calls: list[int] = []
    monkeypatch.setattr(W, "give_back", lambda: calls.append(1))
    assert W.lean(lambda a, b: a + b, 1, 2) == 3 and len(calls) == 1
    with pytest.raises(ZeroDivisionError):
        W.lean(lambda: 1 // 0)
    assert list(W.frugal(lambda batches: batches)([])) == [] and len(calls) == 3


def test_op8_near_copies_in_few_files(spark):
    """Near copies in many blocks give the brute-force rows; buckets hold some blocks each, so a stage writes fewer files."""
    import random

    rng = random.Random(6)
    passage = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(120)]
    rows = [(i, " ".join(w if rng.random() < 0.98 else f"x{rng.random()}" for w in passage)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    table = blocks.write_blocks(df, "few", block_bytes=2500, together=4)
    files = {f.rsplit("_", 1)[1] for f in table.df.inputFiles()}
    assert len(files) <= -(-table.n // 4) < 6 < 15 < table.df.select("block").distinct().count()
    want = sorted(((i, *x) for (i, _), x in zip(rows, brute.substring_dedup([t for _, t in rows]))), key=repr)
    assert rows_of(debruijn.dedup_substrings(df)) == want
    spans = debruijn.repeated_spans(table).join(table.df.select("block", "row", "doc_id"), ["block", "row"]).collect()
    removed = {i: len({w for s in spans if s.doc_id == i for w in range(s.start, s.start + s.n_words)}) for i, _ in rows}
    assert removed == {i: n for i, _, n, *_ in want}


def test_op9(spark, folder, texts):
    got = queries.op9_quality_rules(spark, folder["full"])
    want = []
    for i, t in texts:
        c = brute.rule_counts(t)
        want.append((i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows_of(got.select(*columns)) == sorted(want, key=repr)
    assert not got.where("base_failed AND kept").count() and got.where("kept").count()


def test_op9_score(spark, folder, texts):
    """The hashed ratio against the same sums in plain Python."""
    from tallyhouse.llm import rules

    docs = spark.read.parquet(folder["full"] + "/documents.parquet")
    trusted = spark.read.parquet(folder["full"] + "/labels.parquet").where("quality = 1 AND toxic = 0")
    word = lambda w: xxhash.xxh64_intdigest(w.encode(), 42)
    pair = lambda a, b: xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42))
    bucket = lambda h: (h - (1 << 64) if h >> 63 else h) % rules.BUCKETS

    def buckets(t):
        h = [word(w) for w in brute.words(t)]
        return [bucket(x) for x in [*h, *(pair(a, b) for a, b in zip(h, h[1:]))]]

    good = {r[0] for r in trusted.collect()} - {None}
    every = Counter(b for _, t in texts for b in buckets(t))
    chosen = Counter(b for i, t in texts if i in good for b in buckets(t))
    part = lambda c, b: (c[b] + 1) / (sum(c.values()) + rules.BUCKETS)
    ratios = [math.log(part(chosen, b)) - math.log(part(every, b)) for b in range(rules.BUCKETS)]
    assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(rules.log_ratios(docs, trusted, "doc_id", "text"), ratios))
    small = docs.where("doc_id IN (3, 10, 22, 40)").select("doc_id", rules.word_ids(docs.text).alias("word_ids"))
    grams = {r.doc_id: r.grams for r in small.withColumn("pairs", rules.window_ids(2)).select("doc_id", rules.grams().alias("grams")).collect()}
    got = {r.doc_id: r.score for r in queries.op9_quality_rules(spark, folder["full"]).collect() if r.doc_id in grams}
    for i, g in grams.items():
        assert sorted(g) == sorted(buckets(dict(texts)[i]))
        n = len(brute.words(dict(texts)[i]))
        assert len(g) == n + max(0, n - 1)
        assert math.isclose(got[i], sum(ratios[b] for b in g) / (len(g) + rules.SHRINK), abs_tol=1e-12)


def test_op7(spark, folder):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{folder['full']}/conversations.parquet/*.parquet'")
    got = queries.op7_chat_rotation(spark, folder["full"])
    want = con.execute(f"select {', '.join(got.columns)} from ({queries.ORACLES['op7_chat_rotation']})").fetchall()
    assert rows_of(got) == sorted(want, key=repr)
    for (conv, view), text in {(r.conv_id, r.perspective): None for r in got.collect()}.items():
        parts = sorted((r for r in got.collect() if (r.conv_id, r.perspective) == (conv, view)), key=lambda r: r.position)
        text = "".join(r.rendered for r in parts)
        assert [r.position for r in parts] == list(range(1, len(parts) + 1))
        for r in parts:
            assert text[r.char_start : r.char_start + len(r.rendered)] == r.rendered
            assert (r.mask_start is None) == (r.chat_role != "assistant")
            if r.mask_start is not None:
                assert text[r.mask_start : r.mask_end].endswith("<|im_end|>") and text[: r.mask_start].endswith("<|im_start|>assistant\n")
        break
