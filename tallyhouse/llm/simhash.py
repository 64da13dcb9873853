"""SimHash near copies: 64-bit fingerprints, linked where two bits or fewer differ, and their components.

Fingerprints: a bit is 1 if more than half of the text's shingle hashes (XXH64, seed 42) have it.

Linking works on distinct fingerprints. A fingerprint is cut into two halves; of two fingerprints that differ in at
most two bits, one half differs in at most one. Each half is indexed once for each of its bits with that bit as a
wildcard, so such halves meet under one signature: an equality join, and a verification of all 64 bits.

A signature under which many distinct fingerprints meet would compare them all with each other. Those fingerprints
go another exact way instead: every fingerprint and its 64 one-bit neighbours are points; two that differ in at most
two bits share a point, a point has at most 65 fingerprints, and all of a point lie within two bits of each other.

Components are found by joins that hook every label to the least neighbour's and then halve the paths, each round
written to the shared folder. A null text is an empty text, with fingerprint zero; those link like any other. Rows
with a null id take part, and a component's id is its least id that is not null. Repeated rows are returned each. A very
long text is read alone; a row's text may have 2 GB, as Arrow sends it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm import words as W
from tallyhouse.sources.workspace import materialize

SHINGLE = 3
BITS = 2
MEET = 32


def fingerprints_of(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    t = W.split(texts, lower=True)
    data, begins = W.joined(t)
    ends = begins + t.ends - t.starts
    n = t.n_words()
    first = t.first_word()[:-1]
    per = np.where(n == 0, 0, np.maximum(n - shingle + 1, 1))
    edge = np.cumsum(per)
    doc = np.repeat(np.arange(t.n_docs), per)
    at = first[doc] + np.arange(len(doc)) - (edge - per)[doc]
    last = np.minimum(at + shingle - 1, first[doc] + n[doc] - 1)
    blob, digest = data.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(blob[a:b], 42) for a, b in zip(begins[at].tolist(), ends[last].tolist())),
                         np.uint64, len(at))
    out = np.zeros(t.n_docs, np.uint64)
    some = np.flatnonzero(per)
    if len(some):
        for bit in range(64):
            ones = np.add.reduceat((hashes >> np.uint64(bit) & np.uint64(1)).astype(np.int32), (edge - per)[some])
            out[some] |= (2 * ones > per[some]).astype(np.uint64) << np.uint64(bit)
    return out


def with_fingerprints(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """``docs`` with fp, a long that holds the fingerprint's 64 bits, and uid, a number for each row."""
    kinds = [T.StructField(c, T.LongType()) for c in ("fp", "uid")]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        for part in W.slices(batches, text):
            fp = pa.array(fingerprints_of(part.column(text), shingle).view(np.int64))
            numbers = pa.array(np.arange(uid, uid + part.num_rows))
            uid += part.num_rows
            yield pa.RecordBatch.from_arrays([*part.columns, fp, numbers], [*part.schema.names, "fp", "uid"])

    return docs.mapInArrow(W.frugal(add), T.StructType([*docs.schema.fields, *kinds]))


def signatures(fps: DataFrame) -> DataFrame:
    """sig, fp: both halves under each of their 32 wildcards; sig holds the wildcard's number and the other 31 bits."""
    half = lambda low: F.expr(f"fp & {0xFFFFFFFF}" if low else "shiftrightunsigned(fp, 32)")
    one = lambda low: F.expr(
        f"transform(sequence(0, 31), i -> shiftleft(cast(i + {0 if low else 32} as bigint), 32) | "
        "(half & ~shiftleft(1L, i)))")
    both = [fps.withColumn("half", half(low)).select("fp", F.explode(one(low)).alias("sig")) for low in (True, False)]
    return both[0].unionByName(both[1])


def links(fps: DataFrame, bits: int = BITS, meet: int = MEET) -> DataFrame:
    """Pairs a, b that connect all distinct fingerprints (column ``fp``) that differ in at most two bits.

    Under a signature with up to ``meet`` fingerprints every pair is verified; the others' points link each of
    their fingerprints to the least one, which joins the same sets with fewer rows.
    """
    if bits != 2:
        raise ValueError("two segments with one wildcard each serve two differing bits")
    signed = signatures(fps)
    sizes = signed.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1")
    # Spark takes rows that were exploded for as large as the column they come from, and packed files for as large as
    # the rows in them; neither side may go to the driver for that.
    signed = materialize(signed.join(sizes.hint("merge"), "sig"), "signatures")
    few = signed.where(F.col("n") <= meet).select("sig", "fp")
    pairs = (few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b").hint("merge"), "sig")
             .where("a < b and bit_count(a ^ b) <= 2").select("a", "b"))
    many = signed.where(F.col("n") > meet).select("fp").distinct()
    points = many.select("fp", F.explode(F.expr(
        "array_append(transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)), fp)")).alias("point"))
    stars = points.groupBy("point").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where("size(all) > 1")
    stars = stars.select("a", F.explode("all").alias("b")).where("a != b")
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each node's component, for the nodes of ``edges`` (a, b).

    Each round every node takes the least label among its own, its neighbours' and that label's own label; the
    number of rounds grows with the logarithm of the longest path in practice, and ends when no label changes.
    """
    both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.col("a"), F.min("b")).alias("root")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("other")), "b")
        seen = seen.groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        hooked = labels.join(seen, "node", "left").select("node", F.col("root").alias("old"),
                                                          F.least("root", F.coalesce("other", "root")).alias("root"))
        # the old root learns of the lower label too, so whole trees are hooked at once
        told = hooked.where("root != old").groupBy(F.col("old").alias("node")).agg(F.min("root").alias("low"))
        hooked = hooked.join(told, "node", "left").select("node", "old", F.least("root", F.coalesce("low", "root")).alias("root"))
        hooked = materialize(hooked, "labels")
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = materialize(hooked.join(up, "root", "left").select(
            "node", F.least("root", F.coalesce("up", "root")).alias("root"), "old"), "labels")
        labels = new.select("node", "root")
        if not new.where("root != old").limit(1).count():
            return labels


def members(classes: DataFrame, bits: int) -> DataFrame:
    """fp, root for all distinct fingerprints: those with one root are a component."""
    roots = components(links(classes.select("fp"), bits))
    return classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                bits: int = BITS) -> DataFrame:
    """The id column, fingerprint (16 hex digits) and component_id, a row for each row of ``docs``. Other columns
    are not read, so their names cannot clash."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    prints = materialize(with_fingerprints(rows, "text", shingle).drop("text", "uid"), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    found = members(classes, bits)
    ids = found.groupBy("root").agg(F.min("least").alias("component_id"))
    named = found.join(ids, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, keep: tuple[str, ...], id_column: str = "doc_id", text: str = "text",
                shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """The columns ``keep`` of one row of each component: that with the least id, null ids last; of rows with one id
    the first as they are read."""
    inner = {c: f"c{i}" for i, c in enumerate(keep)}
    rows = docs.select(*(F.col(c).alias(i) for c, i in inner.items()))
    prints = materialize(with_fingerprints(rows, inner[text], shingle), "fingerprints")
    first = F.min(F.struct(F.col(inner[id_column]).isNull().alias("absent"), F.col(inner[id_column]).alias("id"), "uid"))
    classes = materialize(prints.groupBy("fp").agg(first.alias("least")), "classes")
    stay = members(classes, bits).groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.uid").alias("uid"))
    return prints.join(stay, "uid", "left_semi").select(*(F.col(i).alias(c) for c, i in inner.items()))
