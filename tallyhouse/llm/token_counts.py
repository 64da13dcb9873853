"""Token counts that follow edits: a tree of pre-token groups per document.

Byte-pair merges never cross a pre-token, so a text's token count is a sum over its pre-tokens. Each document keeps a
segment tree: a leaf for every ``LEAF`` pre-tokens with its characters and tokens, and sums above. An edit descends
to its leaf, cuts pre-tokens anew from there until a cut falls on an old leaf's end behind the edit, counts only
those, and adds the difference to the sums on the way up. ``CONTEXT`` characters before the edit are cut anew too,
as a pre-token's end looks that far ahead.

Edits of a document are made in order, each at a place of the text as the edits before it left it: ``at`` is moved
into the text, a null or negative length deletes nothing, a null insertion inserts nothing. Null and empty texts
have no tokens and can be edited. Rows are kept, repeated ones too. Columns of ``docs`` that are called as the ones
added are replaced. A very long text is worked on alone; a row's text may have 2 GB, as Arrow sends it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm import words as W
from tallyhouse.llm.kept import kept
from tallyhouse.sources.workspace import materialize

#: Fixed value: the published pattern that cuts text into pre-tokens for the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 32
CONTEXT = 2
KNOWN = 1 << 18


class Counter:
    """Tokens of a pre-token, by a byte-level vocabulary given as the bytes of its rank file."""

    def __init__(self, ranks: bytes) -> None:
        import regex
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.cut = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def count(self, pieces: list[str]) -> list[int]:
        known = self.known
        out = [known.get(p) for p in pieces]
        if None in out:
            if len(known) > KNOWN:
                known.clear()
            for i, p in enumerate(pieces):
                if out[i] is None:
                    out[i] = known[p] = len(self.encoding.encode_ordinary(p))
        return out


@kept(2)
def counter_of(ranks: bytes) -> Counter:
    return Counter(ranks)


def leaves(counter: Counter, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tokens of each leaf."""
    pieces = counter.cut.findall(text)
    at = np.arange(0, len(pieces), LEAF)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes, tokens = np.array(list(map(len, pieces))), np.array(counter.count(pieces))
    return np.add.reduceat(sizes, at), np.add.reduceat(tokens, at)


class Tree:
    """Sums of characters and tokens over a document's leaves; node i has children 2i and 2i+1."""

    def __init__(self, counter: Counter, text: str, chars: list[int], tokens: list[int]) -> None:
        self.counter, self.text, self.encoded = counter, text, 0
        self.plant(chars, tokens)

    def plant(self, chars: list[int], tokens: list[int]) -> None:
        self.width = 1 << max(0, len(chars) - 1).bit_length()
        self.sums = []
        for values in (chars, tokens):
            node = [0] * self.width + [*values] + [0] * (self.width - len(values))
            for i in range(self.width - 1, 0, -1):
                node[i] = node[2 * i] + node[2 * i + 1]
            self.sums.append(node)

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character, and the leaf's beginning."""
        chars, node, begin = self.sums[0], 1, 0
        while node < self.width:
            node *= 2
            if place - begin >= chars[node] and chars[node + 1]:
                begin += chars[node]
                node += 1
        return node - self.width, begin

    def put(self, leaf: int, values: tuple[int, int]) -> None:
        for node, value in zip(self.sums, values):
            i = leaf + self.width
            change = value - node[i]
            while i and change:
                node[i] += change
                i //= 2

    def edit(self, at: int, delete: int, insert: str) -> None:
        size = len(self.text)
        at = min(max(at, 0), size)
        stop = min(at + max(delete, 0), size)
        self.text = text = self.text[:at] + insert + self.text[stop:]
        grown = len(insert) - (stop - at)
        first, begin = self.find(max(0, at - CONTEXT))
        last, end = self.find(stop)
        end += self.sums[0][last + self.width]
        pieces, place = [], begin
        chars = self.sums[0]
        for match in self.counter.cut.finditer(text, begin):
            if place >= end + grown and place >= at + len(insert):
                break
            pieces.append(match.group())
            place = match.end()
            while place > end + grown and last + 1 < self.width:
                last += 1
                end += chars[last + self.width]
        self.encoded += len(pieces)
        counts = self.counter.count(pieces)
        share = -(-len(pieces) // (last - first + 1)) or 1
        if share > 8 * LEAF:
            self.plant(*(x.tolist() for x in leaves(self.counter, text)))
            self.encoded += len(pieces)
            return
        for k, leaf in enumerate(range(first, last + 1)):
            part = slice(k * share, (k + 1) * share)
            self.put(leaf, (sum(map(len, pieces[part])), sum(counts[part])))

    @property
    def tokens(self) -> int:
        return self.sums[1][1]


def build_trees(docs: DataFrame, ranks_file: str, text: str = "text") -> DataFrame:
    """``docs`` with leaf_chars and leaf_tokens. The file is read once and its bytes are sent."""
    with open(ranks_file, "rb") as f:
        ranks = f.read()
    kinds = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("leaf_chars", "leaf_tokens")]
    docs = docs.drop("leaf_chars", "leaf_tokens")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(ranks)
        for part in W.slices(batches, text, W.SLICE_BYTES):
            found = [leaves(counter, x or "") for x in part.column(text).to_pylist()]
            lists = [pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*part.columns, *lists], [*part.schema.names, "leaf_chars", "leaf_tokens"])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, *kinds]))


def recount(trees: DataFrame, ranks_file: str, edits: str = "edits", text: str = "text") -> DataFrame:
    """``trees`` after its column ``edits`` (array of at, n_delete, insert) is carried out: the text and the leaves are
    new, and n_before, n_tokens and n_encoded are added: the counts, and the pre-tokens that were cut anew."""
    with open(ranks_file, "rb") as f:
        ranks = f.read()
    kinds = [T.StructField(c, T.LongType()) for c in ("n_before", "n_tokens", "n_encoded")]
    trees = trees.drop("n_before", "n_tokens", "n_encoded")
    new = (text, "leaf_chars", "leaf_tokens")

    def carry_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(ranks)
        for part in W.slices(batches, text, W.SLICE_BYTES):
            rows = []
            for x, chars, tokens, todo in zip(*(part.column(c).to_pylist() for c in (*new, edits))):
                tree = Tree(counter, x or "", chars, tokens)
                before = tree.tokens
                for e in todo or ():
                    tree.edit(e["at"] or 0, e["n_delete"] or 0, e["insert"] or "")
                rows.append((tree.text, tree.sums[0][tree.width :], tree.sums[1][tree.width :], before, tree.tokens, tree.encoded))
            changed = dict(zip((*new, "n_before", "n_tokens", "n_encoded"), zip(*rows)))
            fields = {c: part.column(c) for c in part.schema.names} | {
                c: pa.array(v, part.schema.field(c).type if c in new else pa.int64()) for c, v in changed.items()}
            yield pa.RecordBatch.from_arrays(list(fields.values()), list(fields))

    return trees.mapInArrow(carry_out, T.StructType([*trees.schema.fields, *kinds]))


def edits_within(text: str = "text", id_column: str = "doc_id", n: int = 3) -> Column:
    """Edits drawn from a row's own text by hashes: at a place, some characters give way to some from elsewhere."""
    size = F.coalesce(F.length(text), F.lit(0))

    def draw(k: Column, salt: int, below: Column) -> Column:
        return F.pmod(F.xxhash64(F.col(id_column), size, k, F.lit(salt)), below.cast("long"))

    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.struct(
        draw(k, 1, size + 1).alias("at"), draw(k, 2, F.lit(40)).alias("n_delete"),
        F.coalesce(F.substring(F.col(text), (draw(k, 3, size + 1) + 1).cast("int"), draw(k, 4, F.lit(60)).cast("int")), F.lit("")).alias("insert")))


def edited_counts(docs: DataFrame, ranks_file: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Trees of all texts, written once, and the counts after each row's own edits."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    trees = materialize(build_trees(rows, ranks_file), "token_trees")
    done = recount(trees.withColumn("edits", edits_within("text", "id")), ranks_file)
    return done.select(F.col("id").alias(id_column), "n_before", "n_tokens", "n_encoded", F.size("edits").cast("long").alias("n_edits"),
                       F.length("text").cast("long").alias("n_chars"))
