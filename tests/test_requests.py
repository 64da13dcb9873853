from __future__ import annotations

import random

from pyspark.sql import functions as F

from tallyhouse.operators import answers, planning
from tallyhouse.operators import requests as rq

SCHEMA = ("request_id long, category string, locations array<string>, keywords array<string>, rating_above double, "
          "price_above double, price_below double, stock_above double, stock_below double, n_rows long")
PRODUCTS = ("row_id long, asin string, product_name string, category string, warehouse_location string, "
            "price double, rating double, stock_quantity long")
SITES = ["Melbourne", "Sydney", "Brisbane", "Perth"]


def products(n=300, seed=1):
    rng = random.Random(seed)
    names = ["Red Ring", "blue bolt", "TV", "x", "smart tv stand", None, "", "ring bolt"]
    return [(i, f"p{i}", rng.choice(names), "hot" if i % 3 else rng.choice(["a", "b", None]), rng.choice(SITES),
             rng.choice([None, round(rng.uniform(1, 50), 2)]), rng.choice([None, rng.randrange(30, 51) / 10]),
             rng.randrange(0, 40)) for i in range(n)]


def requests(n=120, seed=2):
    rng = random.Random(seed)

    def maybe(v):
        return v if rng.random() < 0.5 else None

    return [(i, maybe(rng.choice(["hot", "a", "zzz"])), rng.choice([[], ["Perth"], ["Sydney", "Perth", "Sydney"], None]),
             rng.choice([[], None, ["ring"], ["TV"], ["x", "bolt"], ["nothing"]]), maybe(rng.randrange(30, 51) / 10),
             maybe(round(rng.uniform(0, 40), 2)), maybe(round(rng.uniform(10, 60), 2)), maybe(float(rng.randrange(0, 30))),
             maybe(float(rng.randrange(5, 45))), maybe(rng.randrange(1, 6))) for i in range(n)]


def hits(request, rows):
    _, cat, sites, words, r_gt, p_gt, p_lt, s_gt, s_lt, _ = request
    out = []
    for row in rows:
        _, _, name, category, site, price, rating, stock = row
        ok = cat is None or category == cat
        ok = ok and (not sites or site in sites)
        ok = ok and (not words or any(w.lower() in (name or "").lower() for w in words))
        for value, low, high in ((rating, r_gt, None), (price, p_gt, p_lt), (stock, s_gt, s_lt)):
            ok = ok and (low is None or (value is not None and value > low))
            ok = ok and (high is None or (value is not None and value < high))
        if ok:
            out.append(row)
    return out


def test_match_and_lists_equal_brute_force(spark):
    p, r = products(), requests()
    pdf, rdf = spark.createDataFrame(p, PRODUCTS), spark.createDataFrame(r, SCHEMA)
    got = {x["request_id"]: (x["n_matches"], x["total_units"]) for x in rq.match_requests(pdf, rdf).collect()}
    assert got == {q[0]: (len(hits(q, p)), sum(x[7] for x in hits(q, p))) for q in r}
    lists = {x["request_id"]: x["asins"] for x in rq.first_rows(pdf, rdf).collect()}
    assert lists == {q[0]: [x[1] for x in hits(q, p)][: q[9] or 10] for q in r}


def test_one_long_list_does_not_lengthen_the_others(spark):
    p, r = products(900, 5), requests(60, 6)
    r = [(*q[:-1], 10**6 if q[0] == 7 else 300 if q[0] == 8 else q[-1]) for q in r]
    pdf, rdf = spark.createDataFrame(p, PRODUCTS), spark.createDataFrame(r, SCHEMA)
    lists = {x["request_id"]: x["asins"] for x in rq.first_rows(pdf, rdf).collect()}
    assert lists == {q[0]: [x[1] for x in hits(q, p)][: q[9] or 10] for q in r}
    m = rq.Matcher(pdf, rdf, "n_rows")
    short = rq.lists_of(m, m.cells(), m.signatures, 1)
    assert max(len(x["rows"]) for x in short.collect()) == 16
    sizes = {n: rq.length_class(F.lit(n)) for n in (1, 10, 16, 17, 256, 257, 10**6)}
    assert list(spark.range(1).select(*sizes.values()).first()) == [1, 1, 1, 2, 2, 3, 5]


def test_bounds_beyond_all_values(spark):
    """Bounds that no product has, equal bounds, and a bound on each side of one value."""
    p = [(i, f"p{i}", "n", "c", "Perth", float(i), 4.0, i) for i in range(20)] + [(20, "p20", "n", "c", "Perth", None, None, 5)]
    r = [(1, None, None, None, None, -5.0, None, None, None, None), (2, None, None, None, None, 100.0, None, None, None, None),
         (3, None, None, None, None, 4.5, 5.5, None, None, None), (4, None, None, None, None, 5.0, 5.0, None, None, None),
         (5, None, None, None, 4.0, None, None, None, None, None), (6, None, None, None, None, None, 0.0, 18.0, 20.0, None),
         (7, None, None, None, 3.9, 3.0, 1e300, -1.0, 7.0, None), (8, None, None, None, None, -0.0, None, None, None, None)]
    pdf, rdf = spark.createDataFrame(p, PRODUCTS), spark.createDataFrame(r, SCHEMA)
    got = {x["request_id"]: x["n_matches"] for x in rq.match_requests(pdf, rdf).collect()}
    assert got == {q[0]: len(hits(q, p)) for q in r}


def test_filter_map(spark):
    text = '{"intent":"count","locations":["Perth"],"category":null,"quantity":3,"filters":{"rating":">4.5","price":"< 50"},"product_keywords":["ipad"]}'
    df = spark.createDataFrame([(1, text), (2, "not json")], "request_id int, intent_json string")
    got = {r["request_id"]: r for r in rq.requests_from_intents(rq.parse_intents(df)).collect()}
    assert (got[1]["rating_above"], got[1]["price_below"], got[1]["price_above"]) == (4.5, 50.0, None)
    assert got[2]["category"] is None and got[2]["rating_above"] is None


def test_recommendation_without_exclusion(spark):
    pdf = spark.createDataFrame([
        (1, "a", "ring", "c", "Perth", 1.0, 4.0, 10), (2, "b", "ring", "c", "Sydney", 1.0, 4.0, 30),
        (3, "d", "bolt", "c", "Perth", 1.0, 4.0, 50)], PRODUCTS)
    rdf = spark.createDataFrame([(1, "c", ["ring"], None), (2, "c", [], "Perth"), (3, None, None, "Brisbane"), (4, "q", None, None)],
                                "request_id int, category string, keywords array<string>, excluded string")
    got = {r["request_id"]: r for r in planning.recommend_sites(pdf, rdf).collect()}
    assert (got[1]["best_site"], got[1]["second_site"], got[1]["suggested_transfer"]) == ("Sydney", "Perth", None)
    assert (got[2]["best_site"], got[2]["excluded_units"], got[2]["second_site"]) == ("Sydney", 60, None)
    assert (got[3]["best_site"], got[3]["suggested_transfer"]) == ("Perth", 30)
    assert got[4]["best_site"] is None


def test_transfers_balance_and_shortage(spark):
    pdf = spark.createDataFrame([(1, "a", "n", "c", "Perth", 1.0, 4.0, 10)], PRODUCTS)
    plan = spark.createDataFrame([
        ('{"is_transfer":true,"transfers":[{"from_city":"Perth","to_city":"Sydney","category":"c","quantity":15},'
         '{"from_city":"Perth","to_city":"Sydney","category":null,"quantity":5},'
         '{"from_city":"Sydney","to_city":"Perth","category":"c","quantity":0}]}',),
        ('{"is_transfer":false,"transfers":[]}',)], "transfer_json string")
    rows = planning.project_transfers(pdf, planning.parse_transfers(plan)).collect()
    got = {r["warehouse_location"]: (r["units_before"], r["units_after"], r["shortage"], r["missing_units"]) for r in rows}
    assert got == {"Perth": (10, -5, True, 5), "Sydney": (0, 15, False, 0)}
    assert sum(r["delta"] for r in rows) == 0


def test_adjustments(spark):
    pdf = spark.createDataFrame([(i, f"p{i}", "n", "c", "Perth", 1.0, 4.0, 10) for i in range(4)], PRODUCTS)
    rdf = spark.createDataFrame([
        (1, "subtract", 5, "c", ["Perth"]), (2, "subtract", 1, None, None), (3, "add", 2, "none", []),
        (4, "multiply", 2, "c", []), (5, "add", 0, "c", []), (6, None, 3, "c", []), (7, "add", 1, "c", ["Perth", "Sydney"])],
        "request_id int, operation string, quantity long, category string, locations array<string>")
    got = {r["request_id"]: (r["status"], r["after"], r["change_percent"]) for r in planning.project_adjustments(pdf, rdf).collect()}
    assert got == {1: ("not enough", None, None), 2: ("ok", 3, -25.0), 3: ("new inventory", 2, None),
                   4: ("unsupported", None, None), 5: ("incomplete", None, None), 6: ("incomplete", None, None),
                   7: ("ok", 5, 25.0)}


def test_intents_that_are_not_known(spark):
    pdf = spark.createDataFrame(products(20), PRODUCTS)
    asks = spark.createDataFrame(
        [(1, "hm", "dance"), (2, "hm", "unknown"), (3, "hm", None), (4, "hm", "product_query"), (5, "hm", "")], "request_id long, text string, intent string")
    none = F.lit(None)
    asks = asks.select("*", none.cast("string").alias("category"), F.array().cast("array<string>").alias("locations"), none.cast("string").alias("excluded"),
                       F.array().cast("array<string>").alias("keywords"), none.cast("string").alias("operation"), none.cast("long").alias("quantity"),
                       none.cast("array<struct<from_city: string, to_city: string, category: string, quantity: long>>").alias("transfers"))
    got = {r.request_id: (r.kind, (r.answer or "")[:2]) for r in answers.answer_asks(pdf, asks).collect()}
    assert got == {1: ("not understood", "⚠️"), 2: ("retrieval", ""), 3: ("retrieval", ""), 4: ("retrieval", ""), 5: ("not understood", "⚠️")}
