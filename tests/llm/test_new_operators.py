"""Conversation repair, whitening and source mixing against brute force, libraries and planted cases."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import conversations, mixing, queries, whitening

SMALL = "/root/testdata/sf0.01"


def wild_talk(n: int = 60) -> list[tuple]:
    rng = random.Random(5)
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.choice((0, 1, 2, 5, 12, 40))):
            role = rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"))
            text = rng.choice((None, "", " \t", "Yes.", "Yes.", "no", f"Say {turn}!  ", f"so {turn}\x0b", "x" * 90 + rng.choice("abc."), "eh?\n"))
            rows.append((conv, rng.choice((turn, turn, turn + 3, None)), role, text))
    return rows + rows[:5] + [(1000, 0, "user", "Hi."), (1000, 1, "assistant", "Hello."), (1001, None, "system", "be kind!")]


TALK = "conv_id long, turn long, role string, text string"


def found(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def wanted(ids, rows):
    return {c: (*x[:-1], hashlib.sha256(x[-1].encode()).hexdigest()) for c, x in brute.repaired(ids, rows).items()}


@pytest.mark.parametrize("chunk_rows, bits", [(4096, 8), (7, 2), (1, 1)])
def test_op11_against_all_edits(spark, chunk_rows, bits):
    """In one chunk, in chunks of a few rows with several levels of pieces, and in chunks of one row."""
    rows = wild_talk(60 if chunk_rows > 1 else 12)
    df = spark.createDataFrame(rows, TALK).withColumn("chunk", F.lit("clash")).withColumn("row", F.lit("clash"))
    pieces = conversations.repair(conversations.damage(df), chunk_rows=chunk_rows, bits=bits)
    got = found(conversations.digests(pieces, df))
    ids = [r[0] for r in rows]
    assert got == wanted(ids, brute.damaged(rows))


def test_op11_one_conversation_over_many_chunks(spark):
    rng = random.Random(1)
    rows = [(7, i, rng.choice(("user", "assistant")), rng.choice(("ok.", f"a {i}.", f"b {i}"))) for i in range(3000)]
    df = spark.createDataFrame(rows, TALK).repartition(4)
    pieces = conversations.repair(df, chunk_rows=50, bits=2)
    got = found(conversations.digests(pieces, df))
    assert got == wanted([7], rows)
    assert pieces.count() >= 60


def test_op11_sql(spark, tmp_path):
    """The SQL form on awkward rows."""
    df = spark.createDataFrame(wild_talk(), TALK)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got = queries.op11_conversation_repair(spark, str(tmp_path))
    want = con.execute(f"select {', '.join(got.columns)} from ({queries.ORACLES['op11_conversation_repair']})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_rank_doubling_gives_the_least_audit():
    """Ranks of whole audits order the nodes as their audits do."""
    rng = np.random.default_rng(0)
    n = 200
    begins = rng.random(n) < 0.1
    begins[0] = True
    p = conversations.Pieces(rng.integers(-1, 3, n), rng.random(n) < 0.1, rng.random(n) < 0.2, begins)
    ends = np.full((len(p.start), 4, 4), conversations.FAR)
    ends[:, :, 0] = conversations.AT_END
    paths = conversations.Paths(p, p.suffixes(ends).min(axis=2), np.ones(len(p.start), bool))
    piece, letter, row, state = paths.walk(np.zeros(len(p.start), np.int64))
    for i in range(len(p.start)):
        assert (np.diff(row[piece == i][letter[piece == i] != 1]) == 1).all()


def table_of(spark, vectors):
    return spark.createDataFrame([(i, [float(c) for c in v] if v is not None else None) for i, v in enumerate(vectors)],
                                 "vec_id long, embedding array<float>").repartition(3)


def check_whitening(vectors, rows, components=16):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    y = (n * fit - total) / n
    values, vectors_ = np.linalg.eigh(y.T @ y / n)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    k = max((r.component for r in rows), default=0)
    assert k == min(components, int((values > 1e-12 * values.sum()).sum())) and len(rows) == k * len(x)
    w = ((n * x - total) / n) @ vectors_[:, :k] / np.sqrt(values[:k])
    got = np.zeros((len(x), k))
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == int(((n * x[r.vec_id] - total) ** 2).sum())
        assert math.isclose(r.explained, values[r.component - 1] / values.sum(), rel_tol=1e-9)
        assert r.identity_error < 1e-9
    signs = np.sign((got * w).sum(axis=0))
    gaps = np.abs(np.diff(values[: k + 1], append=0 if len(values) <= k else values[k])) / values[0]
    for j in range(k):
        if gaps[j] > 1e-3 and (j == 0 or gaps[j - 1] > 1e-3):
            assert np.abs(got[:, j] * signs[j] - w[:, j]).max() < 1e-8


@pytest.mark.parametrize("n, dims, slot_rows", [(300, 12, 2048), (500, 20, 17), (5, 8, 2), (40, 3, 1)])
def test_op12_against_a_library(spark, n, dims, slot_rows):
    """One slot, many slots and so several levels, fewer vectors than entries, slots of one vector; repeats in each."""
    rng = np.random.default_rng(n)
    base = rng.normal(size=(n, dims)) * np.linspace(1, 5, dims)
    vectors = [*base, *base[:3], *([base[0]] * n)]
    got = whitening.whitened(table_of(spark, vectors).withColumn("x", F.lit("clash")), slot_rows=slot_rows).collect()
    check_whitening(vectors, got)


def test_op12_given_table(spark):
    got = queries.op12_whitening(spark, SMALL)
    again = queries.op12_whitening(spark, SMALL)
    rows = got.collect()
    assert rows == again.collect() or sorted(rows) == sorted(again.collect())
    vectors = [r.embedding for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()]
    check_whitening(vectors, rows)


def test_op12_leaves_out(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, [1.0]), (None, [3.0, -1.0]),
            (8, [0.5, 0.5]), (8, [0.5, 0.5]), (9, [1e30, 0.0]), (10, [-inf, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whitened(df).collect()
    assert Counter(r.vec_id for r in got) == {1: 2, None: 2, 8: 4} and {r.n for r in got} == {3}
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whitened(same).count() == 0
    line = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [2.0, 2.0])], "vec_id long, embedding array<double>")
    assert sorted((r.component, round(abs(r.whitened), 9), round(r.explained, 9)) for r in whitening.whitened(line).collect()) == [
        (1, 0.0, 1.0), (1, round(math.sqrt(1.5), 9), 1.0), (1, round(math.sqrt(1.5), 9), 1.0)]


def test_secular_updates():
    """A spectrum built and joined by rank-one updates is the library's, equal and zero eigenvalues included."""
    rng = np.random.default_rng(3)
    cases = [rng.normal(size=(80, 9)), np.repeat(rng.normal(size=(3, 6)), 9, axis=0), np.ones((10, 4)), np.eye(12) * 3,
             rng.normal(size=(60, 8)) * np.logspace(0, -9, 8), rng.integers(0, 2, (90, 7)).astype(float)]
    for x in cases:
        parts = [whitening.Spectrum.empty(x.shape[1]) for _ in range(3)]
        for i, v in enumerate(x):
            parts[i * i % 3].add(v)
        parts[0].join(parts[1])
        parts[0].join(whitening.Spectrum.load(parts[2].dump(), x.shape[1]))
        s, y = parts[0], x - x.mean(axis=0)
        size = max(1e-30, np.abs(y.T @ y).max())
        assert np.allclose(s.mean, x.mean(axis=0)) and s.n == len(x)
        assert np.abs((s.basis * s.values) @ s.basis.T - y.T @ y).max() < 1e-13 * size * len(x)
        assert np.abs(s.basis.T @ s.basis - np.eye(x.shape[1])).max() < 1e-12


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 5, "c": 1, "d": 0, None: 40}, {"a": 7}, {None: 3, "b": 3}, {"a": 0, "b": 0},
    {f"s{i}": 2**i for i in range(30)}, {"é": 10, "z": 10, "\U0001f600": 1, "": 900}])
def test_op13_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = brute.targets(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in sizes)
    assert math.isclose(sum(got.values()), sum(sizes.values()), rel_tol=1e-9)


def test_op13(spark, folder, texts):
    got = queries.op13_source_mix(spark, folder["full"]).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(brute.words(t))) for i, t in texts)
    assert all(0 <= r.taken <= 3 * r.size for r in got)


def test_op13_mix(spark):
    """Each source near its target, reruns alike however rows are dealt, each document taken as often as its rate says."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    mixed = mixing.mix(docs.withColumn("size", F.lit("clash")).withColumn("draw", F.lit("clash")), keep=("doc_id", "source"))
    rows = mixed.collect()
    again = {r.doc_id: r.copies for r in mixing.mix(docs.repartition(7, "lang")).collect()}
    assert {r.doc_id: r.copies for r in rows} == again
    taken, target = Counter(), {}
    for r in rows:
        rate = r.target / r.source_size
        assert math.floor(rate) <= r.copies <= math.ceil(rate)
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
    assert all(abs(taken[s] - t) < 0.15 * t for s, t in target.items())
    assert mixing.emitted(mixed).count() == sum(r.copies for r in rows)


def test_op13_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder['full']}/documents.parquet/*.parquet'")
    got = queries.op13_source_mix(spark, folder["full"])
    want = con.execute(f"select {', '.join(got.columns)} from ({queries.ORACLES['op13_source_mix']})").fetchall()
    key = lambda r: (str(r[0]), r[1], r[4])
    for a, b in zip(sorted(map(tuple, got.collect()), key=key), sorted(want, key=key), strict=True):
        assert a[:3] == b[:3] and a[4] == b[4] and math.isclose(a[3], b[3], rel_tol=1e-12)
