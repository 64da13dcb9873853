"""Corpus-wide lookups without a shuffled row per word.

Documents are written once as a table bucketed by ``block``, a few megabytes of text each, so that later joins on
``block`` move no text. A block asks about its distinct 64-bit keys: sorted, cut by key range into one cell per
``bucket``, and shuffled by bucket as packed arrays. A bucket merges the cells of its askers and answers each in
the same order, so answers need no keys. A key is at most once in a block, hence no key is hot, however frequent.

A bucket merges at most about ``FAN`` cells, and a block writes at most ``FAN``. With more blocks than that, the blocks
are dealt into groups; a group's merged cells ask on, cut into finer ranges, and its answers are handed back to its
blocks. So cells grow in proportion to the corpus, a group's memory does not grow, and a thousand times the blocks take
one more level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm import words as W
from tallyhouse.sources.workspace import materialize, save_bucketed

BLOCK_BYTES = 4 << 20
FAN = 1024
MOST_FILES = 8192
CELLS = "block long, bucket long, n long, keys binary, counts binary"
REPLIES = "block long, bucket long, n long, reply binary"


@dataclass
class Blocks:
    """``n``: about how many blocks there are."""

    df: DataFrame
    n: int

    def ranges(self, fan: int = FAN) -> int:
        """Into how many key ranges a block cuts what it asks."""
        return min(self.n, fan)


@dataclass(frozen=True)
class Question:
    """``merge(counts, at)`` reduces columns of counts to one column for each key, whose entries begin at ``at``; as
    groups merge what groups have merged, it must be associative. ``reply(keys, counts)`` turns merged columns into
    answers, uint64 rows of which the first asker alone gets the lowest bits, or into a mask of the keys to keep."""

    merge: Callable[[np.ndarray, np.ndarray], np.ndarray]
    reply: Callable[[np.ndarray, np.ndarray], np.ndarray]


def write_blocks(docs: DataFrame, label: str, text: str = "text", block_bytes: int = BLOCK_BYTES,
                 together: int = 1) -> Blocks:
    """Write ``docs`` with columns ``block`` and ``row`` (together unique); a block is part of one input partition and
    holds about ``block_bytes`` of text, or one longer text. A bucket of the table has about ``together`` blocks: fewer
    tasks on the table, each of which writes fewer files for the blocks that it works through one by one."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    schema = T.StructType([*docs.schema.fields, T.StructField("block", T.LongType()), T.StructField("row", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, rows = TaskContext.get().partitionId() << 24, 0, 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
            if not len(sizes):
                continue
            part = (held + np.cumsum(sizes) - sizes) // block_bytes
            held += int(sizes.sum())
            row = pa.array(np.arange(rows, rows + len(sizes)))
            rows += len(sizes)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(block + part), row], [*batch.schema.names, "block", "row"])

    return Blocks(save_bucketed(docs.mapInArrow(W.frugal(number), schema), label, min(-(-n // together), MOST_FILES), "block"), n)


def planes(values: np.ndarray) -> bytes:
    """uint64 numbers as one width byte and then all lowest bytes, all second bytes, up to the highest one in use."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplanes(data: bytes) -> np.ndarray:
    packed = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((packed.shape[1], 8), np.uint8)
    out[:, : data[0]] = packed.T
    return out.view(np.uint64).ravel()


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def cells(block: int, keys: np.ndarray, counts: np.ndarray, n: int) -> pa.Table:
    """``keys``: sorted and distinct. ``counts``: uint64, a column for each key."""
    edges = np.searchsorted(bucket_of(keys, n), np.arange(n + 1, dtype=np.uint64))
    rows = [(b, s, e) for b, (s, e) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if e > s]
    return pa.table({
        "block": pa.array([block] * len(rows), pa.int64()),
        "bucket": pa.array([b for b, _, _ in rows], pa.int64()),
        "n": pa.array([e - s for _, s, e in rows], pa.int64()),
        "keys": pa.array([planes(np.diff(keys[s:e], prepend=np.uint64(0))) for _, s, e in rows], pa.binary()),
        "counts": pa.array([planes(np.ascontiguousarray(counts[:, s:e]).ravel()) for _, s, e in rows], pa.binary()),
    })


def unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and counts of all cells, and how many keys each has."""
    sizes = table["n"].to_numpy()
    keys = np.concatenate([np.cumsum(unplanes(x), dtype=np.uint64) for x in table["keys"].to_pylist()])
    counts = [unplanes(x).reshape(-1, s) for x, s in zip(table["counts"].to_pylist(), sizes)]
    return keys, np.concatenate(counts, axis=1), sizes


def deal(table: pa.Table, keys: np.ndarray, sizes: np.ndarray, order: np.ndarray, answers: np.ndarray) -> pa.Table:
    """Each cell's part of the answers to the distinct keys; ``order`` sorts the cells' keys."""
    at, key = runs(keys[order])
    ends = np.cumsum(sizes)
    if answers.dtype == bool:
        kept = np.empty(len(keys), bool)
        kept[order] = answers[key]
        parts = [k[m] for k, m in zip(np.split(keys, ends[:-1]), np.split(kept, ends[:-1]))]
        n, packed = [len(p) for p in parts], [planes(np.diff(p, prepend=np.uint64(0))) for p in parts]
    else:
        spread = answers[:, key]
        later = np.ones(len(key), bool)
        later[at] = False
        spread[:, later] &= ~np.uint64(1)
        out = np.empty_like(spread)
        out[:, order] = spread
        n = sizes
        packed = [planes(np.ascontiguousarray(out[:, e - s : e]).ravel()) for s, e in zip(sizes.tolist(), ends.tolist())]
    rows = pa.table({"block": table["block"], "bucket": table["bucket"], "n": pa.array(n, pa.int64()),
                     "reply": pa.array(packed, pa.binary())})
    return rows.filter(pc.greater(rows["n"], 0))


def lookup(requests: DataFrame, question: Question, blocks: Blocks, fan: int = FAN) -> DataFrame:
    """Answers for each block and bucket; where the question's reply is a mask, the keys that it keeps."""
    slots = -(-blocks.n // fan)
    return solve(requests.withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots))), question, blocks.ranges(fan), slots, fan)


def solve(requests: DataFrame, q: Question, ranges: int, slots: int, fan: int) -> DataFrame:
    """``slot`` numbers the groups of askers from 0 to ``slots`` - 1."""

    def merged(table: pa.Table) -> tuple[np.ndarray, ...]:
        keys, counts, sizes = unpack(table)
        order = order_of(keys)
        at, _ = runs(keys[order])
        return keys, sizes, order, at, q.merge(counts[:, order], at)

    def settle(table: pa.Table) -> pa.Table:
        keys, sizes, order, at, counts = merged(table)
        return deal(table, keys, sizes, order, q.reply(keys[order][at], counts))

    def ask_on(table: pa.Table) -> pa.Table:
        keys, _, order, at, counts = merged(table)
        return cells(table["bucket"][0].as_py() * slots + table["slot"][0].as_py(), keys[order][at], counts, ranges * fan)

    def hand_back(table: pa.Table, answers: pa.Table) -> pa.Table:
        keys, sizes, order, at, counts = merged(table)
        distinct_keys = keys[order][at]
        mask = q.reply(distinct_keys[:0], counts[:, :0]).dtype == bool
        got = among(distinct_keys, kept_keys(answers)) if mask else replies(answers)
        return deal(table, keys, sizes, order, got)

    if slots == 1:
        return requests.groupBy("bucket").applyInArrow(lambda t: settle(t), REPLIES)
    requests = materialize(requests, "cells")
    onward = requests.groupBy("bucket", "slot").applyInArrow(lambda t: ask_on(t), CELLS)
    onward = onward.withColumn("slot", F.floor(F.pmod("block", F.lit(slots)) / fan))
    answers = solve(onward, q, ranges * fan, -(-slots // fan), fan).withColumnRenamed("block", "asker")
    askers = requests.withColumn("asker", F.col("bucket") * slots + F.col("slot"))
    return askers.groupBy("asker").cogroup(answers.groupBy("asker")).applyInArrow(lambda t, a: hand_back(t, a), REPLIES)


def kept_keys(table: pa.Table) -> np.ndarray:
    """The keys that ``select`` kept of one block, sorted."""
    parts = [np.cumsum(unplanes(x), dtype=np.uint64) for x in table.sort_by("bucket")["reply"].to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which values are among the sorted ``keys``."""
    if not len(keys):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return keys[at] == values


def order_of(keys: np.ndarray) -> np.ndarray:
    """As a stable argsort: sorts the keys' upper bits with the places in the lower ones, which is several times
    faster, and falls back where two keys differ in the lower bits alone."""
    bits = np.uint64(max(1, int(len(keys)).bit_length()))
    packed = np.sort((keys >> bits << bits) | np.arange(len(keys), dtype=np.uint64))
    order = (packed & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    ahead = keys[order]
    return order if not (ahead[1:] < ahead[:-1]).any() else np.argsort(keys, kind="stable")


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: where each distinct key begins, and for each entry the number of its key."""
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(first), np.cumsum(first) - 1


def replies(table: pa.Table) -> np.ndarray:
    """The answers for one block, in the order of its sorted keys: an array of rows of answers."""
    table = table.sort_by("bucket")
    parts = [unplanes(x).reshape(-1, s) for x, s in zip(table["reply"].to_pylist(), table["n"].to_pylist())]
    return np.concatenate(parts, axis=1) if parts else np.zeros((0, 0), np.uint64)


def distinct(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    order = order_of(keys)
    keys = keys[order]
    at, _ = runs(keys)
    sums = [np.add.reduceat(c[order], at) if len(at) else c[:0] for c in counts]
    return keys[at], np.array(sums, np.uint64).reshape(len(counts), len(at))
