from __future__ import annotations

import random

import pytest

from tallyhouse.operators import alternatives as alt


def rows(seed: int, n: int = 260):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        hot = rng.random() < 0.4
        out.append((i, f"p{i}", "hot" if hot else rng.choice("abc"),
                    rng.choice([1000, 1300, 1001, 700]) if rng.random() < 0.4 else rng.randrange(1, 300000),
                    rng.randrange(30, 51) / 10))
    out.append((n, "none", None, None, None))
    return out


def naive(data):
    similar, better = {}, {}
    for _, asin, cat, cents, rating in data:
        peers = [r for r in data if r[2] == cat and r[1] != asin and cat is not None]
        similar[asin] = [r[1] for r in sorted(peers) if r[3] * 10 >= cents * 7 and r[3] * 10 <= cents * 13][:5]
        above = sorted((r for r in peers if r[4] > rating + 0.3), key=lambda r: (-r[4], r[0]))
        better[asin] = [r[1] for r in above][:5]
    return similar, better


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_all_pairs(spark, seed):
    data = rows(seed)
    df = spark.createDataFrame(data, "row_id long, asin string, category string, price_cents long, rating double")
    similar, better = naive(data)
    got = {r["asin"]: r["similar"] for r in alt.similar_price(df).collect()}
    assert got == {a: v for a, v in similar.items() if a != "none"}
    assert {r["asin"]: r["better"] for r in alt.higher_rated(df).collect()} == better


def test_all_have_one_row_and_no_self(spark):
    df = spark.createDataFrame(rows(3), "row_id long, asin string, category string, price_cents long, rating double")
    out = alt.add_alternatives(df).collect()
    assert len(out) == df.count()
    for r in out:
        ids = [x for x in r["similar_price_alternatives"].split("|") if x]
        assert len(ids) <= 5 and r["asin"] not in ids


def test_join_takes_one_row_per_key(spark):
    left = spark.createDataFrame([("a",), ("b",)], "asin string")
    right = spark.createDataFrame([("a", 1, "x", ""), ("a", 2, "y", "")],
                                  "asin string, row_id int, similar_price_alternatives string, higher_rated_alternatives string")
    out = {r["asin"]: r["similar_price_alternatives"] for r in alt.join_alternatives(left, right).collect()}
    assert out == {"a": "x", "b": None}
