"""Substring dedup by a De Bruijn graph over word k-mers: finds every span of k words that occurs twice or more.

An edge is a k-mer of words, its ends are the (k-1)-mers it begins and ends with.

1. Seeds: the least hash of the short word groups inside a k-mer. Equal k-mers have equal seeds, so a k-mer whose
   seed occurs once cannot repeat. This leaves few keys to count and loses nothing.
2. Edges: the k-mers with a repeated seed are counted over the corpus; those that occur once go.
3. Nodes: where all sources agree on the repeated edge before and the one after, the node does not branch. At the
   other nodes the runs of repeated edges of a document are cut, so every path lies whole in each of its sources.
4. Compaction: paths joined end to start at nodes with one way in and out become unitigs, by joins that double
   the length of what they have joined each time.
5. Verification: a path's occurrences, given by document row and word number, must agree in a digest of the words
   themselves; hashes alone decide nothing.
6. Spans: verified paths that follow each other in a document and in a unitig are one span, which is removed.

Steps 1 to 3 go through ``blocks``: distinct keys of a block, never a row per word, so a passage that a third of the
documents share is one key a block. Steps 4 to 6 likewise join one row for each different path of a block, which holds
its places there, however many documents of the block have it. Null and empty texts have no words. Repeated rows are texts of their own: their
spans repeat. Overlaps count: windows are judged on the input, not on what is left.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm import blocks as B
from tallyhouse.llm import words as W
from tallyhouse.sources.workspace import materialize

K = 35
SEED_WORDS = 8
BLOCK_BYTES = 2 << 20
#: Blocks that a task works through, one after the other.
TOGETHER = 4
PIECES = ("block long, path long, digest binary, edges long, copies long, first long, last long, "
          "rows array<long>, starts array<long>, runs array<long>")
SPANS = "block long, row long, unitig long, start long, n_words long, n_paths long, n_copies long"


def windows(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each ``k`` consecutive words, and whether they lie in one text."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    return W.window_hashes(hashes, k, seed=k), doc[k - 1 :] == doc[: len(doc) - k + 1]


def seeds(hashes: np.ndarray, doc: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The seed of each window, whether the window is whole, and the seeds of all places that are some window's."""
    group, _ = windows(hashes, doc, m)
    _, whole = windows(hashes, doc, k)
    if not whole.any():
        return np.zeros(len(whole), np.uint64), whole, np.zeros(0, np.uint64)
    span = k - m + 1
    least = W.sliding(group, span, np.minimum)
    pad = np.zeros(span - 1, np.uint64)
    best = W.sliding(np.concatenate([pad, np.where(whole, least, 0), pad]), span, np.maximum)
    return least, whole, group[(best == group) & (best > 0)]


def ask_seeds(n: int, k: int, m: int, table: pa.Table) -> pa.Table:
    t = W.split(table["text"])
    places = seeds(W.word_hashes(t), t.doc, k, m)[2]
    keys, counts = B.distinct(places, np.ones(len(places), np.uint64))
    return B.cells(table["block"][0].as_py(), keys, counts, n)


TWICE = B.Question(lambda counts, at: np.add.reduceat(counts, at, axis=1), lambda keys, counts: counts[0] >= 2)


def ask_edges(n: int, k: int, m: int, table: pa.Table, answers: pa.Table) -> pa.Table:
    t = W.split(table["text"])
    hashes = W.word_hashes(t)
    seed, whole, _ = seeds(hashes, t.doc, k, m)
    edge, _ = windows(hashes, t.doc, k)
    edge = edge[whole & B.among(seed, B.kept_keys(answers))]
    keys, counts = B.distinct(edge, np.ones(len(edge), np.uint64))
    return B.cells(table["block"][0].as_py(), keys, counts, n)


def walk(k: int, t: W.Texts, answers: pa.Table) -> tuple[np.ndarray, ...]:
    """Edges, which of them repeat, nodes, and for each node its way through: a number made of the repeated edges
    before and after it, 0 where one of them is missing or a second way passes in this block."""
    hashes = W.word_hashes(t)
    edge, whole = windows(hashes, t.doc, k)
    node, _ = windows(hashes, t.doc, k - 1)
    repeats = whole & B.among(edge, B.kept_keys(answers))
    before, after = np.zeros(len(node), bool), np.zeros(len(node), bool)
    before[1:], after[: len(edge)] = repeats, repeats
    way = np.zeros(len(node), np.uint64)
    inner = np.flatnonzero(before & after)
    way[inner] = (W.mix(edge[inner - 1] * np.uint64(0x9E3779B97F4A7C15) + edge[inner]) >> np.uint64(16)) | np.uint64(1)
    return edge, repeats, node, way, before | after


def one_way(counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The way that all agree on, or 0."""
    low, high = np.minimum.reduceat(counts, at, axis=1), np.maximum.reduceat(counts, at, axis=1)
    return np.where(low == high, low, 0).astype(np.uint64)


BRANCHING = B.Question(one_way, lambda keys, counts: counts[0] == 0)


def ask_nodes(n: int, k: int, table: pa.Table, answers: pa.Table) -> pa.Table:
    _, _, node, way, used = walk(k, W.split(table["text"]), answers)
    order = B.order_of(node[used])
    node, way = node[used][order], way[used][order]
    at, _ = B.runs(node)
    ways = one_way(way[None], at) if len(at) else way[None]
    return B.cells(table["block"][0].as_py(), node[at], ways, n)


def cut(k: int, table: pa.Table, answers: pa.Table) -> pa.Table:
    """The pieces of all documents of a block. ``answers`` has the repeated edges (kind 0) and the cut nodes (1).

    Equal pieces are one row with their places: the document's row, the word number, and how many of them follow each
    other there (one word many times). ``copies`` is the sum of these runs.
    """
    t = W.split(table["text"])
    kind = answers["kind"].to_numpy()
    edge, repeats, node, _, _ = walk(k, t, answers.filter(pa.array(kind == 0)))
    cuts = B.among(node, B.kept_keys(answers.filter(pa.array(kind == 1))))
    begins = repeats & cuts[: len(edge)]
    start = np.flatnonzero(begins)
    number = np.cumsum(begins) - 1
    length = np.bincount(number[repeats], minlength=len(start)) if len(start) else np.zeros(0, np.int64)
    path = edge[start]
    same = np.zeros(len(start), bool)
    same[1:] = (path[1:] == path[:-1]) & (length[1:] == 1) & (length[:-1] == 1) & (start[1:] == start[:-1] + 1)
    head = np.flatnonzero(~same)
    copies = np.diff(np.append(head, len(start)))
    start, length, path = start[head], length[head], path[head]
    data, begin = W.joined(t)
    ends = begin + t.ends - t.starts
    blob = memoryview(data.tobytes())
    digests = [hashlib.blake2b(blob[a:b], digest_size=16).digest()
               for a, b in zip(begin[start].tolist(), ends[start + length + k - 2].tolist())]
    doc = t.doc[start]
    halves = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    order = np.lexsort((halves[:, 1], halves[:, 0], path))
    new = np.ones(len(order), bool)
    new[1:] = (path[order][1:] != path[order][:-1]) | (halves[order][1:] != halves[order][:-1]).any(axis=1)
    at = np.flatnonzero(new)
    one = order[at]
    offsets = pa.array(np.append(at, len(order)), pa.int32())
    places = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x[order], pa.int64()))
    signed = lambda x: x.view(np.int64)
    return pa.table({
        "block": np.full(len(one), table["block"][0].as_py(), np.int64), "path": signed(path[one]),
        "digest": pa.array([digests[i] for i in one.tolist()], pa.binary()), "edges": length[one].astype(np.int64),
        "copies": np.add.reduceat(copies[order], at).astype(np.int64) if len(at) else np.zeros(0, np.int64),
        "first": signed(node[start[one]]), "last": signed(node[start[one] + length[one]]),
        "rows": places(table["row"].to_numpy()[doc]), "starts": places(start - t.first_word()[doc]), "runs": places(copies)})


def unitigs(paths: DataFrame) -> DataFrame:
    """Joins paths end to start wherever one path alone ends and one alone begins; returns path, digest, unitig.

    The number of rounds is the logarithm of the longest chain. A ring gets its least path as its name.
    """
    lone = lambda node, name: paths.groupBy(F.col(node).alias("node")).agg(
        F.count("*").alias("n"), F.min("path").alias(name)).where("n = 1").drop("n")
    links = lone("first", "path").join(lone("last", "to"), "node").where("path != to").select("path", "to")
    state = paths.select("path").distinct().join(links, "path", "left").select(
        "path", F.coalesce("to", "path").alias("head"), F.least("path", F.coalesce("to", "path")).alias("least"),
        F.col("to").isNull().alias("done"))
    state = materialize(state, "unitig")
    rounds = max(1, int(state.count()).bit_length())
    for _ in range(rounds):
        if not state.where("not done").limit(1).count():
            break
        ahead = state.select(F.col("path").alias("head"), F.col("head").alias("next"), F.col("least").alias("next_least"),
                             F.col("done").alias("next_done"))
        going = state.where("not done").join(ahead, "head").select(
            "path", F.col("next").alias("head"), F.least("least", "next_least").alias("least"),
            F.col("next_done").alias("done"))
        state = materialize(state.where("done").unionByName(going), "unitig")
    return state.select("path", F.when(F.col("done"), F.col("head")).otherwise(F.col("least")).alias("unitig"))


def repeated_paths(table: B.Blocks, k: int, m: int) -> DataFrame:
    """The paths that occur twice or more: a row for each of them and block that has it, with its places there, its
    unitig, and n_copies, how often it occurs over all documents."""
    n, m = table.ranges(), min(m, k)
    texts = table.df.groupBy("block")
    seed = B.lookup(texts.applyInArrow(lambda t: W.lean(ask_seeds, n, k, m, t), B.CELLS), TWICE, table)
    edges = table.df.groupBy("block").cogroup(seed.groupBy("block")).applyInArrow(
        lambda t, a: W.lean(ask_edges, n, k, m, t, a), B.CELLS)
    edges = materialize(B.lookup(edges, TWICE, table), "repeated_edges")
    nodes = table.df.groupBy("block").cogroup(edges.groupBy("block")).applyInArrow(
        lambda t, a: W.lean(ask_nodes, n, k, t, a), B.CELLS)
    nodes = B.lookup(nodes, BRANCHING, table)
    known = edges.withColumn("kind", F.lit(0)).unionByName(nodes.withColumn("kind", F.lit(1)))
    pieces = materialize(table.df.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        lambda t, a: W.lean(cut, k, t, a), PIECES), "pieces")
    paths = pieces.groupBy("path", "digest").agg(
        F.sum("copies").alias("n_copies"), F.first("first").alias("first"), F.first("last").alias("last")
    ).where("n_copies >= 2")
    paths = materialize(paths, "paths")
    named = paths.select("path", "digest", "n_copies").join(unitigs(paths), "path")
    return pieces.join(named, ["path", "digest"]).select("block", "edges", "unitig", "n_copies", "rows", "starts", "runs")


def spans_of(k: int, paths: pa.Table) -> pa.Table:
    """The spans of a block by its repeated paths."""
    sizes = pc.list_value_length(paths["rows"]).to_numpy()
    flat = lambda name: pc.list_flatten(paths[name]).to_numpy()
    spread = lambda name: np.repeat(paths[name].to_numpy(), sizes)
    row, start = flat("rows"), flat("starts")
    ahead = start + spread("edges") + flat("runs") - 1
    order = np.lexsort((start, row))
    row, start, ahead = row[order], start[order], ahead[order]
    unitig, copies = spread("unitig")[order], spread("n_copies")[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (unitig[1:] != unitig[:-1]) | (ahead[:-1] != start[1:])
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(row))
    return pa.table({
        "block": np.full(len(at), paths["block"][0].as_py() if len(at) else 0, np.int64), "row": row[at],
        "unitig": unitig[at], "start": start[at], "n_words": ahead[ends - 1] - start[at] + (k - 1) if len(at) else start,
        "n_paths": ends - at if len(at) else start, "n_copies": np.minimum.reduceat(copies, at) if len(at) else copies})


def repeated_spans(table: B.Blocks, k: int = K, m: int = SEED_WORDS) -> DataFrame:
    """Spans of ``k`` words or more whose every window occurs elsewhere: block, row, start (word number), n_words,
    unitig, n_paths of it, and n_copies, how often the rarest of them occurs over all documents. A span is all that a
    document has of a unitig in one stretch; spans of different unitigs overlap by less than a window."""
    return repeated_paths(table, k, m).groupBy("block").applyInArrow(lambda t: spans_of(k, t), SPANS)


def removal(table: pa.Table, spans: pa.Table, with_text: bool) -> pa.Table:
    """Texts without the words of their spans, joined by single spaces."""
    t = W.split(table["text"])
    first = t.first_word()
    rows = table["row"].to_numpy()
    place = np.argsort(rows)
    doc = place[np.searchsorted(rows[place], spans["row"].to_numpy())] if spans.num_rows else np.zeros(0, np.int64)
    begin = first[doc] + spans["start"].to_numpy() if spans.num_rows else doc
    change = np.zeros(len(t.starts) + 1, np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + spans["n_words"].to_numpy() if spans.num_rows else begin, -1)
    kept = np.cumsum(change)[:-1] == 0
    data, _ = W.joined(t)
    sizes = t.ends - t.starts + 1
    data = data[np.repeat(kept, sizes)].tobytes()
    ends = np.cumsum(np.append(0, np.bincount(t.doc, kept * sizes, t.n_docs).astype(np.int64)))
    texts = [data[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    n = t.n_words()
    out = {"n_words": n.astype(np.int64),
           "n_removed": n - np.bincount(t.doc, kept, t.n_docs).astype(np.int64),
           "kept_sha256": [hashlib.sha256(x).hexdigest() for x in texts]}
    if with_text:
        out["kept"] = pa.array(texts, pa.binary()).cast(pa.string())
    for name in table.column_names:
        if name not in ("block", "row"):
            out[f"in_{name}"] = table[name]
    return pa.table(out)


def dedup_substrings(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), k: int = K,
                     with_text: bool = False) -> DataFrame:
    """One row for each row of ``docs``: the columns ``keep``, n_words, n_removed, kept_sha256 and, if asked for,
    ``kept``, the text that is left. Other columns are not read, so their names cannot clash."""
    inner = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(i) for c, i in zip(keep, inner)), F.col(text).alias("text"))
    table = B.write_blocks(rows, "substring_texts", block_bytes=BLOCK_BYTES, together=TOGETHER)
    paths = repeated_paths(table, k, SEED_WORDS)
    kinds = dict(rows.dtypes)
    schema = "n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    schema += "".join(f", in_{c} {kinds[c]}" for c in (*inner, "text"))
    out = table.df.groupBy("block").cogroup(paths.groupBy("block")).applyInArrow(
        lambda t, p: W.lean(lambda: removal(t, spans_of(k, p), with_text)), schema)
    return out.select(*(F.col(f"in_{i}").alias(c) for c, i in zip(keep, inner)), "n_words", "n_removed", "kept_sha256",
                      *(["kept"] * with_text), *([F.col("in_text").alias(text)] * with_text))
