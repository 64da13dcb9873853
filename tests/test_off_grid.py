"""Values beside the fixtures' grid: odd decimals, empty and wild names, counts below one, unknown parts."""

from __future__ import annotations

import math
import os
import random
import statistics
import subprocess
import sys

from pyspark.sql import functions as F

from tallyhouse.functions import questions, vocab
from tallyhouse.functions.render import list_row, product_description
from tallyhouse.operators import planning, requests, stats
from tallyhouse.operators.cleaning import exact_median

PRODUCTS = ("row_id long, asin string, product_name string, category string, warehouse_location string, price double, "
            "price_cents long, rating double, stock_quantity long, minimum_stock_threshold long, daily_sales_avg double")
REQUEST = ("request_id long, category string, locations array<string>, keywords array<string>, rating_above double, "
           "price_above double, price_below double, stock_above double, stock_below double, n_rows long")


def catalog(spark):
    return spark.createDataFrame([
        (1, "a", "red lamp", "*", "Perth", 19.994, 1999, 4.504, 17, 5, 1.0),
        (2, "b", "blue * lamp", "Home", "Sydney", 20.0, 2000, 4.33, 7, 9, 1.0),
        (3, "c", None, "Home", "*", 5.005, 501, 4.04, 3, 1, 1.0),
        (4, "d", "desk", "Home", "Perth", None, None, None, 5, 1, None)], PRODUCTS)


def test_mean_rating_is_not_rounded_first(spark):
    rows = spark.createDataFrame([(4.25,), (4.33,), (4.04,)], "rating double")
    assert rows.agg(stats.mean_rating()).first()[0] == 4.21


def test_requests_compare_raw_values(spark):
    asked = [
        ("rating over 4.5", dict(rating_above=4.5), ["a"]), ("price over 19.99", dict(price_above=19.99), ["a", "b"]),
        ("price over 19.994", dict(price_above=19.994), ["b"]), ("price under 20", dict(price_below=20.0), ["a", "c"]),
        ("price under 19.994", dict(price_below=19.994), ["c"]), ("between", dict(price_above=5.0, price_below=5.01), ["c"]),
        ("nothing between", dict(price_above=20.0, price_below=5.0), []), ("stock over 6.5", dict(stock_above=6.5), ["a", "b"]),
        ("stock under 5", dict(stock_below=5.0), ["c"]), ("empty category", dict(category=""), ["a", "b", "c", "d"]),
        ("wild category", dict(category="*"), ["a"]), ("wild site", dict(locations=["*"]), ["c"]),
        ("wild word", dict(keywords=["*"]), ["b"]), ("minus one row", dict(n_rows=-1), ["a", "b", "c", "d"]),
        ("no rows", dict(n_rows=0), ["a", "b", "c", "d"]), ("one row", dict(n_rows=1), ["a"])]
    names = [x.split()[0] for x in REQUEST.split(", ")]
    rows = [tuple(i if n == "request_id" else spec.get(n) for n in names) for i, (_, spec, _) in enumerate(asked)]
    table = spark.createDataFrame(rows, REQUEST)
    first = {r.request_id: r.asins for r in requests.first_rows(catalog(spark), table).collect()}
    found = {r.request_id: (r.n_matches, r.total_units) for r in requests.match_requests(catalog(spark), table).collect()}
    units = {"a": 17, "b": 7, "c": 3, "d": 5}
    for i, (label, spec, want) in enumerate(asked):
        assert first[i] == want, label
        if "n_rows" not in spec:
            assert found[i] == (len(want), sum(units[x] for x in want)), label


def test_plans_take_empty_and_wild_names(spark):
    asked = spark.createDataFrame(
        [(1, "", [], "Perth"), (2, "*", [], "Perth"), (3, "Home", [], "*"), (4, "None", [], "Perth")],
        "request_id long, category string, keywords array<string>, excluded string")
    got = {r.request_id: r for r in planning.recommend_sites(catalog(spark), asked).collect()}
    assert (got[1].best_site, got[1].excluded_units) == ("Sydney", 22)
    assert (got[2].best_site, got[2].excluded_units) == (None, 17)
    assert (got[3].best_site, got[3].second_site, got[3].excluded_units) == ("Sydney", "Perth", 3)
    assert (got[4].best_site, got[4].suggested_transfer) == (None, None)
    left = {r.request_id: r.units for r in planning.excluded_stock(catalog(spark), asked).collect()}
    assert left == {1: 22, 2: 17, 3: 3, 4: 0}
    counted = spark.createDataFrame(
        [(1, "", None), (2, "*", []), (3, "Home", ["*", "*"])], "request_id long, category string, locations array<string>")
    assert {r.request_id: r.current for r in planning.count_rows(catalog(spark), counted).collect()} == {1: 4, 2: 1, 3: 1}


def test_texts_with_unknown_parts(spark):
    rows = catalog(spark).withColumn("restock_date", F.lit(None).cast("date"))
    got = {r.asin: (r.d, r.line) for r in rows.select("asin", product_description().alias("d"), list_row(F.lit(1)).alias("line")).collect()}
    assert got["c"][0] == "nan in Home category. Priced at $5.01 with 4.04/5 rating. Stock: 3 units at *. "
    assert got["d"] == ("desk in Home category. Priced at $nan with nan/5 rating. Stock: 5 units at Perth. ",
                        "1. desk | N/A | Stock:5 | N/A")
    assert got["b"][0].endswith("Restock scheduled for nan. ")


def test_white_space_in_questions(spark):
    rows = spark.createDataFrame([("price\t> 12.5",), ("if sydney\tis  out",), ("report for melbourne and sydney",)], "t string")
    t = F.col("t")
    got = rows.select(
        questions.number(t, vocab.PRICE_PATTERNS), questions.extract_exclusion(t), questions.multi_location(t),
        F.concat_ws(",", questions.extract_locations(t, vocab.BREAKDOWN_ORDER))).collect()
    assert [tuple(r) for r in got] == [
        (12.5, None, False, ""), (None, "Sydney", False, "Sydney"), (None, None, True, "Sydney,Melbourne")]


def test_median_between_sketch_bounds(spark):
    rng = random.Random(4)
    for n in (1, 2, 3, 4, 999, 20_000):
        values = [rng.choice((1.0, rng.uniform(0, 100))) for _ in range(n)]
        got = exact_median(spark.createDataFrame([(x,) for x in values] + [(None,)], "x double"), "x").first()[0]
        assert math.isclose(got, statistics.median(values)), n


def test_functions_reach_workers_from_another_folder(tmp_path):
    """Workers cannot import the package here: the driver finds it by a path that is not passed on."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from tallyhouse.session import build_session
from tallyhouse.operators.retrieval import nearest
import __spark_entry__
spark = build_session("elsewhere", "local[2]", spark__ui__enabled="false", spark__checkpoint__dir={str(tmp_path)!r})
print("ROWS", __spark_entry__.queries()["knn_topk"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS" in done.stdout, done.stderr[-2000:]
