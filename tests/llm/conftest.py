from __future__ import annotations

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: Names that the operators use inside themselves, or that a table may have anyway.
CLASHES = ("block", "row", "uid", "id", "fp", "n", "places", "key", "words", "score", "c0", "start", "n_words", "bucket",
           "kept", "train", "path", "hits", "items", "trusted_id", "part", "chunk", "ids")


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(("the", "of", "and", "Zeta", "küche", "x1", "más")) if rng.random() < 0.4
                    else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list[tuple[int | None, str | None]]:
    """Ids and texts with every awkward case: nulls, blanks, copies, near copies, shared passages, one word over and
    over, a very long text, repeated rows and ids."""
    rng = random.Random(3)
    shared, leak = sentence(rng, 60), sentence(rng, 30)
    rows: list[tuple[int | None, str | None]] = [
        (0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "one two"), (5, "Und " * 200), (6, "a b " * 60),
        (7, "漢字 テスト x\x0by\x0cz\x1cq"), (8, "x" * 5000), (9, sentence(rng, 20000)), (None, sentence(rng, 80)),
        (None, None), (10, sentence(rng, 34)), (11, sentence(rng, 35))]
    for i in range(20, 60):
        words = sentence(rng, rng.randint(40, 200)).split()
        if i % 4 == 0:
            words[10:10] = shared.split()
        if i % 5 == 0:
            words[5:5] = leak.split()
        rows.append((i, " ".join(words).replace(" the ", "\n")))
    base = rows[30][1]
    rows += [(100 + i, base) for i in range(5)] + [(110 + i, base.replace("of", "Of", i).upper()) for i in range(4)]
    rows += [(120, rows[31][1] + " tail"), (121, " ".join(base.split()[3:])), (20, rows[14][1]), (20, rows[14][1])]
    rows += [(130, "| a ## b $$\nsame line\nsame line\n\nsame line \nx"), (131, leak), (132, " ".join(leak.split()[4:20]))]
    return rows


@pytest.fixture(scope="session")
def leak(texts: list) -> str:
    return next(t for i, t in texts if i == 131)


@pytest.fixture(scope="session")
def docs(spark, texts):
    extra = ", ".join(f"{c} string" for c in CLASHES)
    rows = [(i, t, "en", "s", len(t or ""), *(["z"] * len(CLASHES))) for i, t in texts]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def folder(spark, docs, none, leak, tmp_path_factory):
    """Tables as Parquet: awkward ones in ``full``, tables without rows in ``empty``."""
    root = tmp_path_factory.mktemp("tables")
    bench = [(1, leak), (2, "one two"), (3, None), (4, ""), (None, "zeta"), (5, leak), (5, leak.upper()), (6, " ".join(leak.split()[2:16])),
             (7, "x1 of the and")]
    labels = [(i, i % 3 > 0 and 1 or 0, 0) for i in range(20, 60)] + [(None, 1, 0), (30, None, None), (31, 1, 0), (999, 0, 1)]
    talk = [(1, 0, "system", "be kind"), (1, 1, "user", "hi <|im_end|> there"), (1, 2, "Ann Lee", None), (1, 3, "user", ""),
            (2, 0, "user", "alone"), (3, 0, "system", "no one speaks"), (None, 1, "user", "lost"), (None, None, "bot", "first"),
            (4, 1, None, "nameless"), (4, 1, "user", "same turn"), (4, 1, "user", "same turn"), (4, 2, "bot", "ok")]
    talk += [(5, i, ("user", "bot", "eve")[i % 3], f"message {i}") for i in range(300)]
    out = {}
    for kind in ("full", "empty"):
        full = kind == "full"
        tables = {
            "documents": docs if full else none,
            "benchmark": spark.createDataFrame(bench if full else [], "item_id long, text string"),
            "labels": spark.createDataFrame(labels if full else [], "doc_id long, quality int, toxic int"),
            "embeddings": spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.0, 2.0], 1), (2, [1.0, 1.5], 1)] if full else [],
                                                "vec_id long, embedding array<float>, label int"),
            "conversations": spark.createDataFrame(talk if full else [], "conv_id long, turn long, role string, text string"),
        }
        for name, df in tables.items():
            df.write.parquet(f"{root}/{kind}/{name}.parquet")
        out[kind] = f"{root}/{kind}"
    return out
