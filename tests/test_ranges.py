from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions.ranges import LEVEL_SHIFT, blocks_covering, blocks_of, levels_for


@pytest.mark.parametrize("bits,levels", [(1, 8), (2, 4), (4, 2)])
def test_cover_is_exact_and_disjoint(spark, bits, levels):
    rng = random.Random(bits)
    pairs = [(rng.randrange(256), rng.randrange(256)) for _ in range(150)] + [(0, 255), (3, 3), (0, 0), (255, 255)]
    df = spark.createDataFrame(pairs, "lo long, hi long")
    for lo, hi, blocks in df.select("lo", "hi", blocks_covering(F.col("lo"), F.col("hi"), levels, bits)).collect():
        seen = []
        for b in blocks:
            level, index = b >> LEVEL_SHIFT, b & ((1 << LEVEL_SHIFT) - 1)
            size = 1 << (bits * level)
            seen += range(index * size, (index + 1) * size)
        assert sorted(seen) == list(range(lo, hi + 1))
        assert len(blocks) <= 2 * ((1 << bits) - 1) * levels + 1


def test_value_meets_cover_once(spark):
    values = spark.range(64).select("id", F.explode(blocks_of(F.col("id"), 3, 2)).alias("b"))
    ranges = spark.createDataFrame([(5, 41), (0, 63), (7, 2)], "lo long, hi long")
    covers = ranges.withColumn("b", F.explode(blocks_covering(F.col("lo"), F.col("hi"), 3, 2)))
    got = {(r["lo"], r["hi"]): r["n"] for r in covers.join(values, "b").groupBy("lo", "hi").agg(F.count("*").alias("n")).collect()}
    assert got == {(5, 41): 37, (0, 63): 64}


def test_levels():
    assert [levels_for(n) for n in (1, 2, 3, 1024, 1025)] == [0, 1, 2, 10, 11]
