"""Benchmark decontamination: which words of a text lie in a passage of ``size`` words that a benchmark item has.

A prefix-filtered set join. A window is ``size`` consecutive words of an item (a shorter item is one window); its
tokens are its three-word shingles. The corpus frequencies of all benchmark shingles order them by rarity. As a
window must be contained whole, its rarest shingle is a prefix that a text needs to have, so only those are joined.
Length and positional bounds drop places where no window fits, and the words around a place are compared with the
item's words to find the longest run in common; runs of a window's length or more are hits.

Texts are searched through a bitmap of the wanted shingles, whose size has a fixed bound; it only saves work, as the
equality join follows. Null and empty texts have no words, and an item without words has no window. A null item_id
is ''. Items with one id are one item. Repeated rows of texts are judged each. A very long text is searched alone; a
row's text may have 2 GB, as Arrow sends it. Only the columns ``keep`` are taken along, under other names inside, so
that names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm import words as W
from tallyhouse.sources.workspace import materialize

SIZE = 13
SHINGLE = 3
LEAST_BITS, MOST_BITS = 16, 26
SHINGLES = "item string, text_no long, n long, pos long, key long, left long, around string"
PLACES = "array<struct<key: long, pos: long, left: long, around: string>>"


def split(texts: pa.Array) -> W.Texts:
    return W.split(texts, W.BY_PUNCTUATION, lower=True)


def shingle_keys(t: W.Texts, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all ``length``-word shingles, and whether they lie in one text."""
    keys = W.window_hashes(W.word_hashes(t), length, seed=100 + length)
    return keys, t.doc[length - 1 :] == t.doc[: len(keys)]


def around(t: W.Texts, blob: bytes, first: np.ndarray, at: np.ndarray, length: int, size: int) -> Iterator[tuple]:
    """For each place: the number of words before it that are kept, and those words, its own and those after it."""
    doc = t.doc[at]
    low = np.maximum(at - (size - length), first[doc])
    high = np.minimum(at + size, first[doc + 1])
    starts, ends = t.starts.tolist(), t.ends.tolist()
    for p, a, b in zip(at.tolist(), low.tolist(), high.tolist()):
        yield p - a, b" ".join([blob[starts[i] : ends[i]] for i in range(a, b)]).decode()


def item_shingles(size: int, shingle: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of the items; an item of fewer words than a shingle has is one shingle. ``text_no`` numbers rows."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 40
    for part in W.slices(batches):
        t = split(part.column("text"))
        n, first, blob = t.n_words(), t.first_word(), t.data.tobytes()
        for length in range(1, shingle + 1):
            keys, whole = shingle_keys(t, length)
            at = np.flatnonzero(whole & (np.minimum(n, shingle)[t.doc[: len(keys)]] == length))
            if len(at):
                doc = t.doc[at]
                left, texts = zip(*around(t, blob, first, at, length, size))
                yield pa.RecordBatch.from_arrays(
                    [part.column("item").take(pa.array(doc)), pa.array(number + doc), pa.array(n[doc].astype(np.int64)),
                     pa.array(at - first[doc]), pa.array(keys[at].view(np.int64)), pa.array(left, pa.int64()),
                     pa.array(texts, pa.string())], ["item", "text_no", "n", "pos", "key", "left", "around"])
        number += t.n_docs


def bitmap(keys: DataFrame) -> tuple[int, np.ndarray]:
    """A bit for each key, by the key's upper bits. Its size follows the number of keys up to a fixed bound, and so
    does what the driver gathers: a number for each 64 bits in use."""
    bits = min(max(LEAST_BITS, int(32 * keys.count()).bit_length()), MOST_BITS)
    at = F.shiftrightunsigned("key", 64 - bits)
    rows = keys.select(F.shiftrightunsigned(at, 6).alias("word"), F.expr(
        f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - bits}) & 63 as int))").alias("bit"))
    got = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    packed = np.zeros(1 << (bits - 6), np.uint64)
    packed[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return bits, packed


def wanted(keys: np.ndarray, bits: int, packed: np.ndarray) -> np.ndarray:
    at = keys >> np.uint64(64 - bits)
    return (packed[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def frequencies(lengths: list[int], bits: int, packed: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in W.slices(batches):
        t = split(part.column("text"))
        for length in lengths:
            keys, whole = shingle_keys(t, length)
            found, n = np.unique(keys[whole & wanted(keys, bits, packed)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["key", "n"])


def places(size: int, lengths: list[int], bits: int, packed: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every text with its number of words and the places of wanted shingles."""
    from pyspark import TaskContext

    uid = TaskContext.get().partitionId() << 40
    for part in W.slices(batches):
        t = split(part.column("text"))
        first, blob = t.first_word(), t.data.tobytes()
        found: list[list[dict]] = [[] for _ in range(t.n_docs)]
        for length in lengths:
            keys, whole = shingle_keys(t, length)
            at = np.flatnonzero(whole & wanted(keys, bits, packed))
            docs = t.doc[at].tolist()
            for d, p, key, (left, text) in zip(docs, at.tolist(), keys[at].view(np.int64).tolist(),
                                               around(t, blob, first, at, length, size)):
                found[d].append({"key": key, "pos": p - int(first[d]), "left": left, "around": text})
        kind = pa.list_(pa.struct([("key", pa.int64()), ("pos", pa.int64()), ("left", pa.int64()), ("around", pa.string())]))
        numbers = pa.array(np.arange(uid, uid + t.n_docs))
        uid += t.n_docs
        yield pa.RecordBatch.from_arrays(
            [*(part.column(c) for c in part.schema.names), numbers, pa.array(t.n_words().astype(np.int64)), pa.array(found, kind)],
            [*part.schema.names, "uid", "n_words", "places"])


def shared_runs(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Longest runs of equal words around a joined place; kept if an item's window fits."""
    for batch in batches:
        out = []
        for uid, item, pos, left, text, item_left, item_text, n in zip(*(batch.column(c).to_pylist() for c in (
                "uid", "item", "pos", "left", "around", "item_left", "item_around", "n"))):
            mine, theirs = text.split(" "), item_text.split(" ")
            a, b = left, item_left
            while a and b and mine[a - 1] == theirs[b - 1]:
                a, b = a - 1, b - 1
            i, j = left, item_left
            while i < len(mine) and j < len(theirs) and mine[i] == theirs[j]:
                i, j = i + 1, j + 1
            if i > left and i - a >= min(size, n):
                out.append((uid, item, pos - left + a, pos - left + i))
        columns = list(zip(*out)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()),
             pa.array(columns[3], pa.int64())], ["uid", "item", "a", "b"])


#: Number of places in the union of the intervals ``hits``, sorted by their beginning.
COVERED = """aggregate(hits, named_struct('n', 0L, 'to', 0L), (s, h) -> named_struct(
    'n', s.n + greatest(0L, h.b - greatest(h.a, s.to)), 'to', greatest(s.to, h.b)), s -> s.n)"""


def contamination(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", size: int = SIZE, shingle: int = SHINGLE,
                  with_text: bool = False) -> DataFrame:
    """The columns ``keep`` (and the text), n_words, n_hit, n_items, items (sorted ids as text) for each row."""
    bench = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text"))
    shingles = materialize(bench.mapInArrow(lambda b: item_shingles(size, shingle, b), SHINGLES), "item_shingles")
    lengths = sorted(r[0] for r in shingles.select(F.least("n", F.lit(shingle))).distinct().collect())
    bits, packed = bitmap(shingles.select("key").distinct())
    inner = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(i) for c, i in zip(keep, inner)), F.col(text).alias("text"))
    counts = rows.select("text").mapInArrow(W.frugal(lambda b: frequencies(lengths, bits, packed, b)), "key long, n long")
    counts = counts.groupBy("key").agg(F.sum("n").alias("frequency"))
    ranked = shingles.join(counts, "key", "left").withColumn("frequency", F.coalesce("frequency", F.lit(0)))
    window, token = F.least("n", F.lit(size)), F.least("n", F.lit(shingle))
    starts = ranked.withColumn("start", F.explode(F.sequence(
        F.greatest(F.lit(0), F.col("pos") + token - window), F.least(F.col("pos"), F.col("n") - window))))
    best = starts.groupBy("text_no", "start").agg(F.min(F.struct("frequency", "key", "pos")).alias("best"))
    spans = best.groupBy("text_no", F.col("best.key").alias("key"), F.col("best.pos").alias("pos")).agg(
        F.min("start").alias("low"), F.max("start").alias("high"))
    prefix = materialize(shingles.join(spans, ["text_no", "key", "pos"]).select(
        "item", "n", "key", F.col("pos").alias("item_pos"), F.col("left").alias("item_left"),
        F.col("around").alias("item_around"), "low", "high").distinct(), "prefix_shingles")
    bits, packed = bitmap(prefix.select("key").distinct())
    kinds = dict(rows.dtypes)
    schema = "".join(f"{c} {kinds[c]}, " for c in (*inner, "text")) + f"uid long, n_words long, places {PLACES}"
    seen = rows.mapInArrow(W.frugal(lambda b: places(size, lengths, bits, packed, b)), schema)
    seen = materialize(seen if with_text else seen.drop("text"), "places")
    found = seen.where(F.size("places") > 0).select("uid", "n_words", F.inline("places"))
    window = F.least("n", F.lit(size))
    joined = found.join(prefix, "key").where(
        (F.col("pos") >= F.col("item_pos") - F.col("high"))
        & (F.col("pos") - F.col("item_pos") + F.col("low") + window <= F.col("n_words")))
    runs = joined.mapInArrow(lambda b: shared_runs(size, b), "uid long, item string, a long, b long").distinct()
    hits = runs.groupBy("uid").agg(
        F.sort_array(F.collect_set(F.struct("a", "b"))).alias("hits"), F.sort_array(F.collect_set("item")).alias("items"))
    hits = hits.select("uid", F.expr(COVERED).alias("n_hit"), "items")
    out = seen.drop("places").join(hits, "uid", "left")
    return out.select(*(F.col(i).alias(c) for c, i in zip(keep, inner)), *([F.col("text").alias(text)] * with_text), "n_words",
                      F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contaminated() -> Column:
    """A twentieth of the words or more lie in benchmark passages."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
