"""Quality scores: ridge regression on random Fourier features of document statistics, then isotonic calibration.

Each text is reduced to a few statistics. They are standardised by the labelled rows' means and deviations; cosines
of random projections approximate a Gaussian kernel on them. Every partition of labelled rows sums its share of the
normal equations, whose size does not depend on the data; the sums are solved on the driver. On labelled rows that
the fit has not seen, raw scores are counted in fixed bins, and pooling adjacent violators over the bins gives the
calibration, read off by interpolation.

Null and empty texts have all statistics 0 and are scored like any other. Rows without a label (or with a null one)
teach nothing; with no labels at all every score is 0.5. Repeated rows are scored each, repeated labels count each, also
where they contradict each other. A very long text is read alone; a row's text may have 2 GB, as Arrow sends it. Only
the columns ``keep`` are taken along, under other names inside, so that names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm import blocks as B
from tallyhouse.llm import words as W
from tallyhouse.sources.workspace import materialize

FEATURES = 256
RIDGE = 1e-4
WIDTH = 2.0
SEED = 7
BINS = 4096
LOW, HIGH = -0.5, 1.5
NAMES = ("log_words", "log_lines", "word_length", "word_length_spread", "upper", "digit", "symbol", "mark", "wide",
         "odd_ends", "distinct_words", "top_word", "same_next", "repeated_pairs", "repeated_lines")

UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
SYMBOL = W.separators(*b"#*$%&|<>@^~=+_\\/{}[]")
MARK = W.separators(*b".,;:!?\"'()-")
WIDE = np.zeros(256, bool)
WIDE[128:] = True


def per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])


def repeats(keys: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text the number of distinct keys and how often its commonest occurs."""
    own = W.mix(keys + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = B.order_of(own)
    at, _ = B.runs(own[order])
    times, of = np.diff(np.append(at, len(own))), doc[order[at]]
    top = np.zeros(n, np.int64)
    np.maximum.at(top, of, times)
    return np.bincount(of, minlength=n), top


def statistics(texts: pa.Array) -> np.ndarray:
    t = W.split(texts)
    n, docs = np.maximum(t.n_words(), 1), t.n_docs
    sizes = per_text(t.inside, t.offsets)
    chars = np.maximum(sizes, 1)
    length = (t.ends - t.starts).astype(float)
    hashes = W.word_hashes(t)
    mean = sizes / n
    spread = np.sqrt(np.maximum(np.bincount(t.doc, length**2, docs) / n - mean**2, 0))
    last = t.data[t.ends - 1] if len(t.ends) else np.zeros(0, np.uint8)
    distinct, top = repeats(hashes, t.doc, docs)
    same = t.doc[1:] == t.doc[:-1]
    next_same = np.bincount(t.doc[1:][same], hashes[1:][same] == hashes[:-1][same], docs)
    pairs = W.window_hashes(hashes, 2)[same]
    distinct_pairs, _ = repeats(pairs, t.doc[1:][same], docs)
    breaks = np.flatnonzero(t.data == 10)
    begins = np.unique(np.concatenate([t.offsets[:-1], breaks + 1]))
    begins = begins[begins < len(t.data)]
    ends = np.append(begins[1:], len(t.data))[: len(begins)]
    of = np.searchsorted(t.offsets[1:], begins, side="right")
    lines = W.byte_hashes(t.data, begins, ends, 5)
    n_lines = np.bincount(of, minlength=docs)
    distinct_lines, _ = repeats(lines, of, docs)
    share = lambda mask: per_text(mask[t.data] & t.inside, t.offsets) / chars
    ended = np.bincount(t.doc, SYMBOL[last] | (last == 33), docs) / n
    some = t.n_words() > 0
    columns = [np.log1p(t.n_words()), np.log1p(n_lines), mean, spread, share(UPPER), share(DIGIT), share(SYMBOL),
               share(MARK), share(WIDE), ended, distinct / n, top / n, next_same / n,
               np.where(some, 1 - (distinct_pairs + 1) / n, 0), 1 - distinct_lines / np.maximum(n_lines, 1)]
    return np.where(some[:, None], np.stack(columns, axis=1), 0.0)


def with_statistics(docs: DataFrame) -> DataFrame:
    kinds = [T.StructField(c, T.DoubleType()) for c in NAMES]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches):
            found = statistics(part.column("text"))
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c) for c in found.T)], [*part.schema.names, *NAMES])

    return docs.mapInArrow(W.frugal(add), T.StructType([*docs.schema.fields, *kinds]))


class Kernel:
    """Cosine features of standardised statistics, with a constant as the last feature."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, np.where(deviation > 1e-9, 1 / np.maximum(deviation, 1e-9), 0.0)
        self.weights = rng.normal(size=(len(mean), FEATURES)) / (WIDTH * np.sqrt(len(mean)))
        self.shift = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) * self.scale, -8, 8)
        z = np.sqrt(2 / FEATURES) * np.cos(x @ self.weights + self.shift)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)


def normal_equations(rows: DataFrame, kernel: Kernel) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums over all rows (the statistics and ``y``): a number of rows and values that the features fix."""
    size = FEATURES + 1

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((size, size + 1)), 0
        for part in parts:
            for at in range(0, len(part), 4096):
                chunk = part.iloc[at : at + 4096]
                z = kernel(chunk[list(NAMES)].to_numpy())
                total += z.T @ np.column_stack([z, chunk["y"].to_numpy()])
                n += len(chunk)
        yield pd.DataFrame({"i": np.arange(size), "n": n, "total": list(total)})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": part["i"][:1], "n": part["n"].sum(), "total": [np.sum(np.stack(part["total"]), axis=0)]})

    schema = "i long, n long, total array<double>"
    found = rows.mapInPandas(sums, schema).groupBy("i").applyInPandas(add, schema).orderBy("i").toPandas()
    total = np.stack(found["total"]) if len(found) else np.zeros((size, size + 1))
    return total[:, :-1], total[:, -1], int(found["n"].max()) if len(found) else 0


def isotonic(bins: np.ndarray, n: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; returns the blocks' mean places and their values."""
    blocks: list[list[float]] = []
    for x, w, y in zip(bins.tolist(), n.tolist(), good.tolist()):
        blocks.append([x * w, w, y])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def bin_of(raw: Column) -> Column:
    return F.floor((F.greatest(F.lit(LOW), F.least(F.lit(HIGH), raw)) - LOW) / (HIGH - LOW) * (BINS - 1) + 0.5)


def scores(docs: DataFrame, labels: DataFrame, fit: Column, calibrate: Column, id_column: str = "doc_id",
           text: str = "text", label: str = "quality", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``score``. ``labels`` has the id column and ``label``; of its rows those under ``fit``
    teach the regression and those under ``calibrate`` the calibration, no others are read."""
    inner = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"), *(F.col(c).alias(i) for c, i in zip(keep, inner)))
    found = materialize(with_statistics(rows).drop("text"), "statistics")
    columns = [F.col(i).alias(c) for c, i in zip(keep, inner)]
    marked = labels.select(F.col(id_column).alias("label_id"), F.col(label).cast("double").alias("y"),
                           F.coalesce(fit, F.lit(False)).alias("fit"), F.coalesce(calibrate, F.lit(False)).alias("calibrate"))
    marked = marked.where("y IS NOT NULL AND (fit OR calibrate)")
    known = materialize(found.join(marked, F.col("id") == F.col("label_id")).select("y", "fit", "calibrate", *NAMES), "labelled")
    taught = known.where("fit")
    moments = taught.agg(F.count("*"), *(f(c) for f in (F.mean, F.stddev_pop) for c in NAMES)).first()
    if not moments[0]:
        return found.select(*columns, F.lit(0.5).alias("score"))
    kernel = Kernel(np.array(moments[1 : 1 + len(NAMES)], float), np.array(moments[1 + len(NAMES) :], float))
    a, b, n = normal_equations(taught, kernel)
    weights = np.linalg.solve(a + RIDGE * n * np.diag([1.0] * FEATURES + [0.0]) + 1e-9 * np.eye(FEATURES + 1), b)

    def raw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.drop(columns=list(NAMES)).assign(raw=kernel(part[list(NAMES)].to_numpy()) @ weights)

    checked = known.where("calibrate").select("y", *NAMES).mapInPandas(raw, "y double, raw double")
    counts = checked.groupBy(bin_of(F.col("raw")).alias("bin")).agg(F.count("*").alias("n"), F.sum("y").alias("good"))
    counts = counts.orderBy("bin").toPandas()
    if not len(counts):
        places, values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    else:
        places, values = isotonic(counts["bin"].to_numpy() / (BINS - 1) * (HIGH - LOW) + LOW, counts["n"].to_numpy(), counts["good"].to_numpy())

    @F.pandas_udf("double")
    def calibrated(x: pd.DataFrame) -> pd.Series:
        return pd.Series(np.clip(np.interp(kernel(x[list(NAMES)].to_numpy()) @ weights, places, values), 0, 1))

    return found.withColumn("score", calibrated(F.struct(*NAMES))).select(*columns, "score")
