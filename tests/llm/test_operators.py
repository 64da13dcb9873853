"""Operators whose results SQL cannot give: libraries, held-out accuracy and planted cases."""

from __future__ import annotations

import os
import textwrap
import time
from types import SimpleNamespace

import brute
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from tallyhouse.llm import licenses, queries, sentencepiece_scan, simhash, token_counts

MODEL, RANKS = "/opt/tokenizers/piece_bpe_32k.model", "/opt/tokenizers/byte_bpe_50k.tiktoken"
SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("size", [40, 1 << 14])
def test_pieces_equal_the_library(spark, docs, texts, size):
    """Cuts fall anywhere, many texts have tens of chunks, some no space at all."""
    few = docs.where(F.coalesce(F.length("text"), F.lit(0)) < 20000) if size == 40 else docs
    got = sentencepiece_scan.decode(sentencepiece_scan.encode(few, MODEL, size=size), MODEL, into="back")
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = sorted(((i, lib.encode(t or ""), t or "") for i, t in texts if size > 40 or len(t or "") < 20000), key=repr)
    rows = got.collect()
    assert sorted(((r.doc_id, r.ids, r.back) for r in rows), key=repr) == want
    if size == 40:
        assert max(r.n_chunks for r in rows) > 20


def test_decoding_costs_little_beside_the_library():
    """Ids reach the library without an object for each on the way, which took over twice the time of decoding itself."""
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = np.random.default_rng(4)
    plain = [rng.integers(259, lib.get_piece_size(), 400).tolist() for _ in range(600)]
    rows = [None, [], *plain, [], None]
    took: list = []
    encoded = SimpleNamespace(schema=T.StructType().add("ids", T.ArrayType(T.IntegerType())), mapInArrow=lambda f, schema: took.append(f))
    sentencepiece_scan.decode(encoded, MODEL)
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32()))], ["ids"])

    def ours() -> list[str]:
        return [t for out in took[0](iter([batch])) for t in out.column("text").to_pylist()]

    def least(work) -> float:
        spent = []
        for _ in range(7):
            begin = time.process_time()
            work()
            spent.append(time.process_time() - begin)
        return min(spent)

    assert ours() == [lib.decode(x) if x else "" for x in rows]
    assert least(ours) < least(lambda: [lib.decode(x) for x in plain]) + least(lambda: batch.column("ids").to_pylist()) / 2


def test_max_plus_product_is_associative():
    rng = np.random.default_rng(0)
    a, b, c = ({i: {j: float(w) for j, w in enumerate(row) if w > -3} for i, row in enumerate(rng.integers(-5, 5, (4, 4)))} for _ in range(3))
    p = sentencepiece_scan.product
    assert p(p(a, b), c) == p(a, p(b, c))


def test_hot_signatures_link_like_all_pairs(spark):
    """The way for crowded signatures gives the components that comparing all pairs gives."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 12)
    fps = {int(b) ^ int(sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 4), replace=False))) for b in base for _ in range(25)}
    rows = [(i, fp) for i, fp in enumerate(sorted(fps))]
    want = brute.component_ids(rows)
    df = spark.createDataFrame([(fp,) for _, fp in rows], "fp long")
    for meet in (1, 3, 1000):
        roots = {r.node: r.root for r in simhash.components(simhash.links(df, meet=meet)).collect()}
        groups: dict = {}
        for i, fp in rows:
            groups.setdefault(roots.get(fp, fp), []).append(i)
        least = {i: min(g) for g in groups.values() for i in g}
        assert [least[i] for i, _ in rows] == want


def test_signatures_stay_off_the_driver(spark, monkeypatch):
    """A fingerprint has 64 signatures, of which Spark expects the size of one: it would send them all to the driver."""
    plans, real = {}, simhash.materialize

    def planned(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, label)

    monkeypatch.setattr(simhash, "materialize", planned)
    fps = real(spark.range(3000).selectExpr("CASE WHEN id < 2990 THEN xxhash64(id) ELSE xxhash64(id - 2990) ^ 5 END AS fp"), "fps")
    pairs = simhash.links(fps)
    plans["pairs"] = pairs._jdf.queryExecution().executedPlan().toString()
    assert {x for x in plans if "BroadcastExchange" in plans[x]} == set()
    assert {r.a ^ r.b for r in pairs.collect()} == {5} and pairs.count() == 10


def test_pipeline_keeps_signatures_off_the_driver(spark, monkeypatch):
    plans, real = {}, simhash.materialize

    def planned(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, label)

    monkeypatch.setattr(simhash, "materialize", planned)
    rows = [(i, f"{i % 30} und {i % 30} so weiter {i % 30} am Ende", "de", "s", 20) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "signatures").collect()]
    corpus_pipeline.clear(spark, "signatures")
    assert "BroadcastExchange" not in plans["signatures"] and "BroadcastExchange" in "".join(plans.values())
    assert left and max(left) < 30 and len(set(left)) == len(left)


def test_license_scan(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    planted = [(10**6 + i, f"Some words here.\n{t}\nand more text") for i, t in enumerate(x for f in licenses.TEMPLATES.values() for x in f)]
    names = [f for f, ts in licenses.TEMPLATES.items() for _ in ts]
    odd = [(-1, None), (-2, ""), (-3, "\n\n"), (-3, "\n\n"), (None, "Released under the MIT License.")]
    both = docs.unionByName(spark.createDataFrame(planted + odd, "doc_id long, text string"))
    found = licenses.scan(both.withColumn("found", F.lit("clash"))).collect()
    sure = {r.doc_id: {x.license for x in r.found if x.confirmed} for r in found}
    hit = [names[i] in sure[10**6 + i] for i in range(len(names))]
    assert np.mean(hit) > 0.9
    assert sure[None] == {"MIT"} and not sure[-1] and not sure[-2] and sum(r.doc_id == -3 for r in found) == 2
    text = {r.doc_id: r.text for r in docs.collect()}
    notices = [t for f in licenses.TEMPLATES.values() for t in f]
    for doc, families in sure.items():
        if doc is not None and 0 <= doc < 10**6:
            assert bool(families) == any(n in text[doc] for n in notices), doc


def planted_notices(spark, plant) -> tuple[list[set[str]], list[str]]:
    """Confirmed families of texts that ``plant`` makes of a template and the words of other texts, and the right ones."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    words = " ".join(r.text for r in docs.orderBy("doc_id").limit(100).collect()).split()
    notices = [(f, t) for f, ts in licenses.TEMPLATES.items() for t in ts[:3]]
    rows = [(10**6 + i, plant(t, words[1000 * (i % 10) :])) for i, (_, t) in enumerate(notices)]
    found = licenses.scan(docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))).where("doc_id >= 1000000").collect()
    return [{x.license for x in r.found if x.confirmed} for r in sorted(found)], [f for f, _ in notices]


@pytest.mark.parametrize("n", [25, 100, 1000])
def test_license_amid_a_long_line(spark, n):
    got, names = planted_notices(spark, lambda t, words: " ".join([*words[: n // 2], t, *words[n // 2 : n]]))
    assert np.mean([f in g for f, g in zip(names, got)]) > 0.95


def test_licenses_of_one_line(spark):
    """A line may have several."""
    got, names = planted_notices(spark, lambda t, words: " ".join([*words[:200], t, *words[200:400], "Released under the MIT License.", *words[400:500]]))
    assert np.mean([{f, "MIT"} <= g for f, g in zip(names, got)]) > 0.95


#: Notices worded as works word them, which are not among the templates, and the license they name; None: not in the set.
FOREIGN = [
    ("GPL-2.0", "Frob is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by\n"
                "the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "/* This file is part of Frob.\n * This program is free software; you can redistribute it and/or\n * modify it under the terms of the GNU General "
                "Public License\n * as published by the Free Software Foundation; either version 2\n * of the License, or (at your option) any later version. */"),
    ("GPL-3.0", "Frob is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
                "Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "Frob is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
                 "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "Frob is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
                 "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "Frob is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
                 "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", "Copyright 2024 The Frob Authors. Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions "
                     "and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
                     "the following disclaimer in the documentation and/or other materials provided with the distribution.\nTHIS SOFTWARE IS PROVIDED BY THE "
                     "COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
                     "met:\n* Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n* "
                     "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
                     "documentation and/or other materials provided with the distribution.\n* Neither the name of Frob Inc. nor the names of its contributors may "
                     "be used to endorse or promote products derived from this software without specific prior written permission."
                     "\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES"),
    ("ISC", "Copyright (c) 2020 Ann Lee <a@b.c>\nPermission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to do with it what they like."),
    ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0"),
    ("LGPL-2.1", "// SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
                   "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    (None, "Licensed under the Frob Community License, version 7; you may use this file if you are kind to animals."),
    (None, "This program is free software; you can redistribute it under the terms of the Sleepycat License as published by Oracle."),
    (None, "Frob may be copied under the terms of the CeCILL Free Software License Agreement, version 2.1, as published by CEA, CNRS and INRIA."),
    (None, "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License version 9 as published by no one."),
    (None, "Permission is hereby granted to the bearer to enter the building, subject to the rules posted at the gate."),
    (None, "The editors reserve all rights to shorten letters; opinions are those of their authors."),
]


def test_foreign_notices(spark):
    """Each comes out as itself or as nothing, never as another license."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    planted = spark.createDataFrame([(10**6 + i, f"Some words here.\n\n{t}\n\nand more text") for i, (_, t) in enumerate(FOREIGN)], "doc_id long, text string")
    rows = licenses.scan(docs.unionByName(planted)).where("doc_id >= 1000000").collect()
    got = {r.doc_id - 10**6: {x.license for x in r.found if x.confirmed} for r in rows}
    wrong = {i: (want, got[i]) for i, (want, _) in enumerate(FOREIGN) if not got[i] <= {want}}
    assert not wrong
    known = [i for i, (want, _) in enumerate(FOREIGN) if want]
    assert np.mean([got[i] == {FOREIGN[i][0]} for i in known]) > 0.85, [FOREIGN[i][0] for i in known if not got[i]]


def test_each_template_is_its_own_license():
    for spdx, said in licenses.TEMPLATES.items():
        for text in said:
            found = [m for f in licenses.NAMES for m in licenses.matches(licenses.terms(text), f) if m.license]
            assert [m.license for m in licenses.chosen(found)] == [spdx], text
    assert len(licenses.TEMPLATES) >= 40


COMMON = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="no license texts on this machine")
def test_whole_license_texts(spark):
    """Whole texts as an operating system carries them: what is named is the license itself."""
    want = {"GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "Apache-2.0": "Apache-2.0", "LGPL-2": "LGPL-2.0", "GPL-1": "GPL-1.0"}
    names = [n for n in want if os.path.exists(f"{COMMON}/{n}")]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    texts = spark.createDataFrame([(10**6 + i, open(f"{COMMON}/{n}").read()) for i, n in enumerate(names)], "doc_id long, text string")
    rows = licenses.scan(docs.unionByName(texts)).where("doc_id >= 1000000").collect()
    got = {names[r.doc_id - 10**6]: {x.license for x in r.found if x.confirmed} for r in rows}
    assert all(want[n] in got[n] for n in names), got


@pytest.mark.parametrize("mark", ["", " * ", "# ", "dnl "])
@pytest.mark.parametrize("width", [40, 76])
def test_wrapped_license(spark, width, mark):
    got, names = planted_notices(spark, lambda t, words: "\n".join(
        [" ".join(words[:30]), *(mark + x for x in textwrap.wrap(t, width)), " ".join(words[30:60])]))
    assert np.mean([f in g for f, g in zip(names, got)]) > 0.95


def test_license_paragraphs():
    """Lines without a word cut, with comment marks or not; other line breaks do not."""
    texts = ["a b\nc\n\nd", "", "x", "\n\nx\n \n# \n\ny\n", None, "# a\n#\n# b\ndnl\ndnl c", "rem\n", "/* a\r\n * b\r\n\r\n c */"]
    t, first = licenses.paragraphs(pa.array(texts))
    got = [(int(t.doc[a]), " ".join(licenses.words_between(t, a, b))) for a, b in zip(first[:-1], first[1:])]
    assert got == [(0, "a b c"), (0, "d"), (2, "x"), (3, "x"), (3, "y"), (5, "a"), (5, "b"), (5, "c"), (7, "a b"), (7, "c")]


def test_quality_on_held_out_rows(spark):
    got = queries.op5_quality_classifier(spark, SMALL)
    rows = got.join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = rows[rows.quality == 1].score, rows[rows.quality == 0].score
    assert (good.to_numpy()[:, None] > bad.to_numpy()[None]).mean() > 0.97
    assert (rows[rows.quality == 1].predicted == 1).mean() > 0.95
    assert got.count() == 1000 and not got.where("score IS NULL OR score < 0 OR score > 1").count()


def test_quality_learns_from_its_folds_alone(spark, tmp_path):
    """Turning all held-out labels round changes no score."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality"))).write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    a, b = (queries.op5_quality_classifier(spark, d).orderBy("doc_id").toPandas().score for d in ("/root/testdata/sf0.001", str(tmp_path)))
    assert np.allclose(a, b)


def test_counts_follow_edits(spark, docs):
    rows = docs.select("doc_id", "text").withColumn("edits", token_counts.edits_within("text", "doc_id", 6))
    got = token_counts.recount(token_counts.build_trees(rows, RANKS), RANKS).collect()
    counter = token_counts.Counter(open(RANKS, "rb").read())
    count = lambda t: len(counter.encoding.encode_ordinary(t))
    before = sorted((r.doc_id or -1, count(r.text or "")) for r in rows.collect())
    assert sorted((r.doc_id or -1, r.n_before) for r in got) == before
    for r in got:
        assert r.n_tokens == count(r.text) == sum(r.leaf_tokens) and sum(r.leaf_chars) == len(r.text)
    long = next(r for r in got if r.doc_id == 9)
    assert long.n_encoded < 0.1 * long.n_tokens


def test_edits_anywhere(spark):
    rows = spark.createDataFrame(
        [(1, None, [(5, 3, "new words")]), (2, "", [(0, -4, "a"), (None, None, None)]), (3, "abc def", None),
         (4, "a  b", [(2, 0, " " * 300), (10, 280, "")]), (5, "x " * 50, [(1000, 5, "it's"), (0, 10**6, "")])],
        "doc_id long, text string, edits array<struct<at: long, n_delete: long, insert: string>>")
    got = {r.doc_id: r for r in token_counts.recount(token_counts.build_trees(rows, RANKS), RANKS).collect()}
    counter = token_counts.Counter(open(RANKS, "rb").read())
    assert {i: r.text for i, r in got.items()} == {1: "new words", 2: "a", 3: "abc def", 4: "a " + " " * 20 + " b", 5: ""}
    assert all(r.n_tokens == len(counter.encoding.encode_ordinary(r.text)) for r in got.values())


def test_pipeline_stage_by_stage(spark, folder):
    """Each stage against the plain form on what the stage before it kept."""
    read = spark.read.parquet(folder["full"] + "/documents.parquet")
    columns = list(corpus_pipeline.COLUMNS)
    stages = dict(corpus_pipeline.STAGES)
    scored = corpus_pipeline.quality_classifier(spark, read, folder["full"])
    assert scored.columns == columns
    rows = read.select(*columns)
    kept = stages["SimHash near-dedup"](spark, rows, "")
    before = [(r.doc_id, r.text) for r in rows.collect()]
    roots = brute.component_ids([(10**9 if i is None else i, brute.fingerprint(t)) for i, t in before])
    assert sorted(r.doc_id if r.doc_id is not None else 10**9 for r in kept.collect()) == sorted(set(roots))
    cut = stages["substring dedup"](spark, rows, "")
    plain = brute.substring_dedup([t for _, t in before])
    assert cut.columns == columns and cut.count() == sum(n > gone or not gone for n, gone, _ in plain)
    changed = {r.text for r in cut.collect()}
    assert all(t in changed for (_, t), (_, gone, _) in zip(before, plain) if not gone and t)
    clean = stages["benchmark decontamination"](spark, rows, folder["full"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(folder["full"] + "/benchmark.parquet").collect()]
    bad = [x[4] for x in brute.decontaminate([t for _, t in before], items)]
    assert clean.columns == columns
    assert sorted((r.text or "" for r in clean.collect())) == sorted(t or "" for (_, t), b in zip(before, bad) if not b)
    last = stages["SentencePiece encoding and decoding"](spark, rows, "")
    assert last.count() == len(before) and not last.where("NOT round_trip").count()


@pytest.mark.parametrize("kind", ["full", "empty"])
def test_whole_pipeline(spark, folder, kind):
    out = corpus_pipeline.run(spark, folder[kind])
    assert "ids" in out.columns and (out.count() > 0) == (kind == "full")
