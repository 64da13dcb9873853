"""Deleted interpolation: an n-gram language model whose mixture weights depend on how often the context was seen.

``P(w | h) = sum over m of a_m(b) c(h_m w) / c(h_m) + a_0(b) / (V + 1)``, with h_m the m-1 words before w for m from the
order down to 1 (c(w) / N). ``b`` is the bucket of the context: the longest h_m that was seen, and the power of two of
its count. Counts come from the training documents. For the weights, the tuning part of the training documents is
deleted from the counts, and expectation-maximisation runs on its tokens; the final model uses all training documents.

Counting and lookup go through ``blocks``: the distinct n-grams of a block travel once, the answers travel back.
For the weights the tokens are summed to cells of (bucket, log2 of all estimates in quarter steps), whose number
is bounded by the range of a double, so the driver holds a bounded table however large the corpus is.

Null and empty texts hold the end token alone. A very long text is a block of its own; up to 2 GB of text fit in one row
of Arrow. Repeated rows count and are scored each. A null id is text ''. Without training rows every token gets the
uniform part; without tuning rows all parts weigh the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm import blocks as B
from tallyhouse.llm import words as W
from tallyhouse.sources.workspace import materialize

ORDER = 2
#: Lowest bits of a key: how many words it has before its last one.
LOW = np.uint64(3)
BUCKETS = 24
STEP = 4
ROUNDS = 50
FLOOR = 1e-6
BEGIN, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def fold(id_column: str, n: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))), F.lit(n)).cast("int")


def tokens(texts: pa.ChunkedArray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams of each length that end in each token, a row for each length; and the tokens' texts."""
    t = W.split(texts, lower=True)
    per = t.n_words() + 1
    ends = np.cumsum(per) - 1
    doc = np.repeat(np.arange(t.n_docs), per)
    token = np.full(len(doc), END, np.uint64)
    token[np.arange(len(t.starts)) + t.doc] = W.word_hashes(t)
    grams, before = [token], token
    for _ in range(1, order):
        before = np.roll(before, 1)
        before[ends - per + 1] = BEGIN
        grams.append(W.mix(before * np.uint64(0xA24BAED4963EE407) + grams[-1]))
    return np.stack([g & ~LOW | np.uint64(m) for m, g in enumerate(grams)]), doc


def request(n: int, order: int, table: pa.Table) -> pa.Table:
    """Distinct keys of a block with how often they occur in training and in kept (not deleted) texts."""
    grams, doc = tokens(table["text"], order)
    train, kept = (np.tile(table[c].to_numpy().astype(np.uint64)[doc], order) for c in ("train", "kept"))
    keys, counts = B.distinct(grams.ravel(), train, kept)
    return B.cells(table["block"][0].as_py(), keys, counts, n)


#: Sums over all blocks; the lowest bit marks one answer for each single token, so that tokens can be counted.
TOTALS = B.Question(
    lambda counts, at: np.add.reduceat(counts, at, axis=1),
    lambda keys, counts: counts << np.uint64(1) | (keys & LOW == 0).astype(np.uint64))


def sizes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens and types in training and in kept texts, from the marked answers."""
    for batch in batches:
        for data, n in zip(batch.column("reply").to_pylist(), batch.column("n").to_pylist()):
            reply = B.unplanes(data).reshape(-1, n)
            marked = reply[:, reply[0] & np.uint64(1) == 1] >> np.uint64(1)
            sums = [*marked.sum(axis=1).tolist(), *(marked > 0).sum(axis=1).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in sums], ["n", "n_kept", "types", "types_kept"])


def looked_up(table: pa.Table, answers: pa.Table, order: int, row: int, n: int, docs: int) -> tuple[np.ndarray, ...]:
    """For each token its estimate from each n-gram length, the bucket of its context, its count and its text."""
    grams, doc = tokens(table["text"], order)
    keys = grams.ravel()
    at = B.order_of(keys)
    count = np.empty(len(keys), np.int64)
    count[at] = (B.replies(answers)[row] >> np.uint64(1)).astype(np.int64)[B.runs(keys[at])[1]]
    count = count.reshape(order, -1)
    first = np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    estimates, bucket = [count[0] / max(n, 1)], np.zeros(len(doc), np.int64)
    for m in range(1, order):
        context = np.where(first, docs, np.roll(count[m - 1], 1))
        estimates.append(count[m] / np.maximum(context, 1))
        size = np.minimum(np.frexp(context.astype(float))[1], BUCKETS - 1)
        bucket = np.where(context > 0, (m - 1) * BUCKETS + size, bucket)
    return np.stack(estimates), bucket, count[0], doc


def cell_schema(order: int) -> str:
    return "bucket int, n double" + "".join(f", q{m} int, s{m} double" for m in range(order))


def tuning_cells(n_kept: int, docs_kept: int, order: int, table: pa.Table, answers: pa.Table) -> pa.Table:
    """The deleted texts' tokens, summed by bucket and rounded estimates."""
    estimates, bucket, _, doc = looked_up(table, answers, order, 1, n_kept, docs_kept)
    tune = (table["train"].to_numpy().astype(bool) & ~table["kept"].to_numpy().astype(bool))[doc]
    f, bucket = estimates[:, tune], bucket[tune]
    q = np.where(f > 0, np.round(STEP * np.log2(np.maximum(f, 1e-300))), 1).astype(np.int64)
    codes = np.concatenate([bucket[None], q])
    order_at = np.lexsort(codes)
    new = np.ones(len(order_at), bool)
    new[1:] = (np.diff(codes[:, order_at], axis=1) != 0).any(axis=0)
    at = np.flatnonzero(new)
    add = lambda x: np.add.reduceat(x[order_at], at) if len(at) else np.zeros(0)
    out = {"bucket": bucket[order_at][at].astype(np.int32), "n": add(np.ones(len(bucket)))}
    for m in range(order):
        out |= {f"q{m}": q[m][order_at][at].astype(np.int32), f"s{m}": add(f[m])}
    return pa.table(out)


def weights(cells: list, types: float, order: int) -> np.ndarray:
    """Expectation-maximisation for each bucket; a bucket without tokens gets the weights of all together."""
    size = BUCKETS * max(1, order - 1)
    if not cells:
        return np.full((size, order + 1), 1 / (order + 1))
    b, n = (np.array([c[k] for c in cells]) for k in ("bucket", "n"))
    f = np.stack([np.full(len(n), 1 / (types + 1)), *(np.array([c[f"s{m}"] for c in cells]) / n for m in range(order))], axis=1)

    def fit(groups: np.ndarray, size: int) -> np.ndarray:
        a = np.full((size, order + 1), 1 / (order + 1))
        for _ in range(ROUNDS):
            part = a[groups] * f
            part *= (n / part.sum(axis=1))[:, None]
            new = np.stack([np.bincount(groups, part[:, k], size) for k in range(order + 1)], axis=1)
            total = new.sum(axis=1, keepdims=True)
            a = np.where(total > 0, new / np.maximum(total, 1e-300), a)
        return a

    a = fit(b, size)
    seen = np.bincount(b, minlength=size) > 0
    a[~seen] = fit(np.zeros_like(b), 1)[0]
    a = np.maximum(a, FLOOR)
    return a / a.sum(axis=1, keepdims=True)


def scores(model: dict, order: int, table: pa.Table, answers: pa.Table) -> pa.Table:
    n, v = model["n"], model["types"]
    f, bucket, c1, doc = looked_up(table, answers, order, 0, n, model["docs"])
    a = model["weights"][bucket]
    p = a[:, 0] / (v + 1) + (a[:, 1:].T * f).sum(axis=0)
    docs = table.num_rows
    add = lambda x: np.bincount(doc, x, docs)
    return pa.table({
        "id": table["id"], "n_tokens": add(None).astype(np.int64), "n_known": add(c1 > 0).astype(np.int64),
        "train_tokens": np.full(docs, int(n), np.int64),
        "base_score": add(np.log10((c1 + 0.5) / (n + 0.5 * (v + 1)))).astype(float), "score": add(np.log10(p)).astype(float)})


def lm_scores(docs: DataFrame, train: Column, tune: Column, id_column: str = "doc_id", text: str = "text",
              order: int = ORDER, block_bytes: int = B.BLOCK_BYTES, fan: int = B.FAN) -> DataFrame:
    """Log10 probability of every text. ``train`` marks the rows to learn from, ``tune`` those of them on which the
    weights are learned; ``order`` (1 to 4) is the length of the longest n-grams. Returns the id column, n_tokens,
    n_known, train_tokens, base_score (add-half unigrams) and score; other columns of ``docs`` are left out, so their
    names cannot clash."""
    if not 1 <= order <= 4:
        raise ValueError("order must be 1 to 4")
    mark = lambda c: F.coalesce(c, F.lit(False))
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"), mark(train).alias("train"),
                       (mark(train) & ~mark(tune)).alias("kept"))
    table = B.write_blocks(rows, "lm_texts", block_bytes=block_bytes)
    kind = docs.schema[id_column].dataType.simpleString()
    n = table.ranges(fan)
    requests = table.df.groupBy("block").applyInArrow(lambda t: request(n, order, t), B.CELLS)
    answers = materialize(B.lookup(requests, TOTALS, table, fan), "lm_counts")
    tokens_of, docs_of = ("n", "n_kept", "types", "types_kept"), ("train", "kept")
    sizes = answers.mapInArrow(sizes_of, ", ".join(f"{c} long" for c in tokens_of)).agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in tokens_of)).first()
    n_docs = table.df.agg(*(F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c) for c in docs_of)).first()
    texts = table.df.groupBy("block").cogroup(answers.groupBy("block"))
    kept_n, kept_docs = sizes["n_kept"], n_docs["kept"]
    cells = texts.applyInArrow(lambda t, a: tuning_cells(kept_n, kept_docs, order, t, a), cell_schema(order))
    cells = cells.groupBy("bucket", *(f"q{m}" for m in range(order))).agg(
        F.sum("n").alias("n"), *(F.sum(f"s{m}").alias(f"s{m}") for m in range(order))).collect()
    a = weights(cells, sizes["types_kept"], order)
    if not sizes["n"]:
        a[:] = [1] + [0] * order
    model = {"weights": a, "n": sizes["n"], "types": sizes["types"], "docs": n_docs["train"]}
    schema = f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.applyInArrow(lambda t, a: scores(model, order, t, a), schema).withColumnRenamed("id", id_column)
