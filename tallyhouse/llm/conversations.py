"""Conversation structure repair: the cheapest edits that make the roles of each conversation ``(s?(ua)+)?``.

A row is kept (0), given the other role (1) or deleted (2); an empty row may be put in anywhere (5). Blank and repeated
rows must go; a truncated row that stays costs 5 more. Of the cheapest audits, strings of the edits' initials, the least
one counts. What is open of the pattern is one of four states, so a row is a min-plus matrix of four by four.

1. Rows are sorted by conversation and turn over ranges, and cut into chunks of bounded rows and bytes. A
   row that says what an earlier one said is found by a minimum over (conversation, digest), whatever their number.
2. Cost: suffix products of the matrices inside a chunk, by doubling; a conversation that goes over a chunk's edge gets
   the costs behind the edge from a scan over its pieces (``scan``), level by level.
3. Audit: arcs whose costs add up are the optimal ones. Nodes are ranked by the first letter of their least audit, then by
   the first two, four, eight and so on: a rank and the rank of the node that the doubled pointer gives make the next
   rank. At each node the arc with the least letter and then the least rank is taken, and the doubled pointers give all
   nodes of the path at once. A second scan says in which state a piece begins.

No task holds more than a chunk, but for the one that streams a conversation of many chunks through its digest.

Null roles and texts are one space, so the texts are blank; a null conversation id or turn is a value of its own, null
turns come first. Rows that agree in everything are repeats; rows of one turn are taken by role, the first 64 characters
of the text and its SHA-256. A row whose role is empty cannot be kept. Very long texts are chunks of their own. Other
columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm.scan import scan
from tallyhouse.sources.workspace import materialize, save_bucketed

CHUNK_ROWS = 4096
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
LEAST_BUCKETS, MOST_BUCKETS = 16, 8192
#: Bits of a place that hold the row in its chunk.
ROW_BITS = 20
HEAD = 64
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing yet, after s, after u, after a. From each, the role that may be put in leads to:
NEXT = np.array([2, 2, 3, 2])
#: Where a kept row of role s, u, a leads from each state (-1: nowhere).
KEPT = np.array([[1, 2, -1], [-1, 2, -1], [-1, -1, 3], [-1, 2, -1]])
NAMES = {2: "user", 3: "assistant"}
FAR = 1 << 40
AT_END = np.array([0, 2 * INSERT, INSERT, 0])
LETTERS = "DIKR"
COUNTS = ("blank", "duplicate", "truncated", "illegal", "n_turns")
SEAMS = ("first_role", "last_role", "first_turn", "last_turn")
PIECE = "chunk long, start long, part boolean, audit string, roles array<string>, texts array<string>, cost long, " + ", ".join(
    f"{c} long" for c in (*COUNTS, *SEAMS))


def inserts() -> np.ndarray:
    """Cost from each state to each by rows put in."""
    out = np.full((4, 4), FAR)
    for q in range(4):
        out[q, NEXT[NEXT[q]]] = 2 * INSERT
        out[q, NEXT[q]] = INSERT
        out[q, q] = 0
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus products of stacks of matrices."""
    return np.minimum((a[:, :, :, None] + b[:, None, :, :]).min(axis=2), FAR)


def row_matrices(role: np.ndarray, must_go: np.ndarray, truncated: np.ndarray) -> np.ndarray:
    """Costs of a row between the states before it, rows put in included, and after it."""
    out = np.full((len(role), 4, 4), FAR)
    stay = np.where(must_go, FAR, np.where(truncated, TRUNCATED, 0))
    for q in range(4):
        out[:, q, NEXT[q]] = np.minimum(out[:, q, NEXT[q]], stay + REROLE)
        for r in range(3):
            if KEPT[q, r] >= 0:
                out[:, q, KEPT[q, r]] = np.where(role == r, np.minimum(out[:, q, KEPT[q, r]], stay + KEEP), out[:, q, KEPT[q, r]])
        out[:, q, q] = np.minimum(out[:, q, q], DELETE)
    return product(np.broadcast_to(inserts(), out.shape), out)


class Pieces:
    """The rows of a chunk, cut where a conversation begins. Levels are the places before each row and, for each piece,
    the place behind its last one; level ``row + piece``."""

    def __init__(self, role: np.ndarray, must_go: np.ndarray, truncated: np.ndarray, begins: np.ndarray) -> None:
        self.role, self.must_go, self.truncated = role, must_go, truncated
        self.start = np.flatnonzero(begins)
        self.stop = np.append(self.start[1:], len(role))
        self.number = np.cumsum(begins) - 1
        self.level = np.arange(len(role)) + self.number
        self.last = self.stop + np.arange(len(self.start))
        self.n = len(role) + len(self.start)

    def suffixes(self, ends: np.ndarray) -> np.ndarray:
        """Product of all matrices from each level to its piece's end; ``ends``: a matrix for each piece's last level."""
        out = np.empty((self.n, 4, 4), np.int64)
        out[self.level], out[self.last] = row_matrices(self.role, self.must_go, self.truncated), ends
        last = np.empty(self.n, np.int64)
        last[self.level], last[self.last] = self.last[self.number], self.last
        reach = np.arange(self.n)  # the last level that the product has in it
        while (open_at := np.flatnonzero(reach < last)).size:
            ahead = reach[open_at] + 1
            out[open_at] = product(out[open_at], out[ahead])
            reach[open_at] = reach[ahead]
        return out


class Paths:
    """The least of the cheapest paths, given the cost to go at each level and state; ``final`` says which pieces end
    their conversation. Arcs of the least audits and the pointers along them, doubled; node = 4 * level + state."""

    def __init__(self, p: Pieces, to_go: np.ndarray, final: np.ndarray) -> None:
        self.p = p
        ends = np.zeros(p.n, bool)
        ends[p.last] = True
        may_insert = ~ends
        may_insert[p.last] = final
        row = np.zeros(p.n, np.int64)
        row[p.level] = np.arange(len(p.role))
        self.row = row
        stay = np.where(p.must_go, FAR, np.where(p.truncated, TRUNCATED, 0))[row]
        below = np.append(to_go[1:], to_go[-1:], axis=0)
        level = np.arange(p.n)
        arcs = np.full((p.n, 4, 4), -1)  # by letter: the node it leads to, if it is on a cheapest path
        for q in range(4):
            cost, e = to_go[:, q], NEXT[q]
            arcs[~ends & (cost == DELETE + below[:, q]), q, 0] = q
            arcs[may_insert & (cost == INSERT + to_go[:, e]), q, 1] = e
            for r in range(3):
                if (k := KEPT[q, r]) >= 0:
                    arcs[~ends & (p.role[row] == r) & (cost == KEEP + stay + below[:, k]), q, 2] = k
            arcs[~ends & (cost == REROLE + stay + below[:, e]), q, 3] = e
        node = np.where(arcs >= 0, 4 * (level[:, None, None] + np.array([1, 0, 1, 1])) + arcs, -1).reshape(-1, 4)
        self.choose(node)

    def choose(self, node: np.ndarray) -> None:
        nodes = np.arange(len(node))
        has = (node >= 0).any(axis=1)
        letter = np.where(has, (node >= 0).argmax(axis=1), -1)
        step = np.where(has, node[nodes, letter], nodes)
        rank = letter + 1
        while (step != (further := step[step])).any():
            _, rank = np.unique(rank * (len(node) + 1) + rank[step], return_inverse=True)
            step = further
        # Of the arcs of a node: least letter, then least rank of what follows.
        order = np.where(node >= 0, np.arange(4) * (len(node) + 1) + rank[node], 5 * (len(node) + 1))
        self.letter = np.where(has, order.argmin(axis=1), -1)
        self.steps = [np.where(has, node[nodes, self.letter], nodes)]
        while (self.steps[-1] != (further := self.steps[-1][self.steps[-1]])).any():
            self.steps.append(further)

    def ends(self, state: np.ndarray) -> np.ndarray:
        """State behind each piece whose first level has ``state``."""
        return self.steps[-1][4 * (self.p.start + np.arange(len(self.p.start))) + state] % 4

    def walk(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all edits in order: piece, letter, row and the state that they lead to."""
        at = 4 * (self.p.start + np.arange(len(self.p.start))) + state
        length, here = np.zeros(len(at), np.int64), at
        for k in range(len(self.steps) - 1, -1, -1):
            there = self.steps[k][here]
            going = self.letter[there] >= 0
            length += going.astype(np.int64) << k
            here = np.where(going, there, here)
        length += self.letter[at] >= 0
        piece = np.repeat(np.arange(len(at)), length)
        number = np.arange(len(piece)) - np.repeat(np.cumsum(length) - length, length)
        nodes = at[piece]
        for k, step in enumerate(self.steps):
            nodes = np.where(number >> k & 1, step[nodes], nodes)
        return piece, self.letter[nodes], self.row[nodes // 4], self.steps[0][nodes] % 4


def damage(talk: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with faults, drawn by crc32 of ``conv:turn``: of twenty, 0 is dropped, 1 loses its text, 2 its ``.!?``, 3 comes
    twice, 4 gets the role user."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(said(conv), F.lit(":"), said(turn))), F.lit(20))
    rows = talk.select(
        F.col(conv).alias(conv), F.col(turn).alias(turn), F.when(fault == 4, "user").otherwise(said(role)).alias(role),
        F.when(fault == 1, "").when(fault == 2, F.translate(said(text), ".!?", "")).otherwise(said(text)).alias(text),
        F.explode(F.when(fault == 0, F.array()).when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"))
    return rows.drop("_copy")


def in_chunks(rows: DataFrame, chunk_rows: int, chunk_bytes: int) -> DataFrame:
    """Sorted rows with ``chunk`` (rises with the order), ``row`` in it, and ``begins``: another conversation than the
    row before, or the first row of a chunk."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, held, size, before = TaskContext.get().partitionId() << 24, 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv")
            codes = np.asarray(conv.dictionary_encode(null_encoding="encode").indices)
            begins = np.append(True, codes[1:] != codes[:-1])
            begins[0] = before is None or before[0] != conv[0].as_py()
            before = (conv[-1].as_py(),)
            sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).tolist()
            chunks, at = np.empty(len(codes), np.int64), np.empty(len(codes), np.int64)
            for i, s in enumerate(sizes):
                if held and (held >= chunk_rows or size + s > chunk_bytes):
                    chunk, held, size = chunk + 1, 0, 0
                chunks[i], at[i] = chunk, held
                held, size = held + 1, size + s
            begins |= at == 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunks), pa.array(at), pa.array(begins)],
                                             [*batch.schema.names, "chunk", "row", "begins"])

    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = ("conv", "turn", "role", "_head", "_sha", "_uid")  # of bounded size, as ranges are found from a sample of it
    keyed = rows.withColumns({"_head": F.substring("text", 1, HEAD), "_sha": F.sha2("text", 256), "_uid": F.monotonically_increasing_id()})
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([*rows.schema.fields, T.StructField("chunk", T.LongType()), T.StructField("row", T.LongType()),
                           T.StructField("begins", T.BooleanType())])
    n = min(MOST_BUCKETS, max(LEAST_BUCKETS, total // BUCKET_BYTES))
    return save_bucketed(ranged.drop("_head", "_sha", "_uid").mapInArrow(number, schema), "conversation_chunks", n, "chunk")


def flags(role: Column, text: Column) -> dict[str, Column]:
    trimmed = F.rtrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return {
        "initial": F.coalesce(F.array_position(F.array(*map(F.lit, "sua")), F.substring(role, 1, 1)) - 1, F.lit(-1)).cast("long"),
        "is_blank": trimmed == "",
        "is_cut": ~F.right(trimmed, F.lit(1)).isin(".", "!", "?"),
    }


class Chunk:
    """A chunk's pieces with their faults, from its rows and the rows that say something first."""

    def __init__(self, table: pa.Table, firsts: np.ndarray) -> None:
        self.table = table = table.sort_by("row")
        column = lambda c: table[c].to_numpy(zero_copy_only=False)
        n = table.num_rows
        self.chunk = table["chunk"][0].as_py()
        self.blank = column("is_blank").astype(bool)
        first = np.zeros(n, bool)
        first[firsts] = True
        self.repeat = ~self.blank & ~first
        self.cut = ~self.blank & ~self.repeat & column("is_cut").astype(bool)
        self.role = column("initial")
        self.pieces = Pieces(self.role, self.blank | self.repeat, self.cut, column("begins").astype(bool))
        #: The first and the last piece may go on in another chunk.
        self.edge = np.zeros(len(self.pieces.start), bool)
        self.edge[[0, -1]] = True

    def summary(self) -> dict[str, np.ndarray]:
        p = self.pieces
        add = lambda x: np.add.reduceat(x.astype(np.int64), p.start)
        inner = np.ones(len(self.role), bool)
        inner[p.start] = False
        before = np.roll(self.role, 1)
        turn = self.table["turn"]
        known = pc.is_valid(turn).to_numpy()
        turn = pc.fill_null(turn, 0).to_numpy().astype(np.int64)
        new = known & (~inner | (turn != np.roll(turn, 1)) | ~np.roll(known, 1))
        low = np.minimum.reduceat(np.where(known, turn, np.iinfo(np.int64).max), p.start)
        high = np.maximum.reduceat(np.where(known, turn, np.iinfo(np.int64).min), p.start)
        return {"blank": add(self.blank), "duplicate": add(self.repeat), "truncated": add(self.cut),
                "illegal": add(inner & illegal(before, self.role)), "n_turns": add(new),
                "first_role": self.role[p.start], "last_role": self.role[p.stop - 1], "first_turn": low, "last_turn": high}


def illegal(before: np.ndarray, role: np.ndarray) -> np.ndarray:
    return ~(((before == 0) & (role == 1)) | ((before == 1) & (role == 2)) | ((before == 2) & (role == 1)))


def longs(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, np.int64).tobytes()


def unlongs(x: bytes | None, *shape: int) -> np.ndarray:
    return np.frombuffer(x, np.int64).reshape(shape)


def costs_of_edges(table: pa.Table, firsts: pa.Table) -> pa.Table:
    """Matrices of the pieces at a chunk's edges."""
    c = Chunk(table, firsts["row"].to_numpy())
    same = np.where(np.eye(4, dtype=bool), 0, FAR)
    whole = c.pieces.suffixes(np.broadcast_to(same, (len(c.pieces.start), 4, 4)))
    start = c.pieces.start[c.edge]
    return pa.table({
        "key": c.table["conv"].take(pa.array(start)), "at": np.full(len(start), c.chunk << 1) + (start > 0), "chunk": np.full(len(start), c.chunk),
        "start": start, "state": pa.array([longs(m) for m in whole[c.pieces.level[start]]], pa.binary())})


def fold_costs(states: list[bytes]) -> bytes:
    out = unlongs(states[0], 1, 4, 4)
    for s in states[1:]:
        out = product(out, unlongs(s, 1, 4, 4))
    return longs(out)


def spread_costs(behind: bytes | None, states: list[bytes]) -> list[bytes]:
    """Cost to go behind each piece, and whether that is the conversation's end."""
    cost, final, out = (AT_END, 1, []) if behind is None else (unlongs(behind, 5)[:4], unlongs(behind, 5)[4], [])
    for s in reversed(states):
        out.append(longs(np.append(cost, final)))
        cost, final = np.minimum((unlongs(s, 4, 4) + cost).min(axis=1), FAR), 0
    return out[::-1]


def solved(c: Chunk, known: pa.Table) -> Paths:
    """Least paths of a chunk; ``known``: start and incoming (cost to go and end mark) of the pieces at its edges."""
    p = c.pieces
    behind = np.tile(np.append(AT_END, 1), (len(p.start), 1))
    at = np.searchsorted(p.start, known["start"].to_numpy())
    for i, x in zip(at.tolist(), known["incoming"].to_pylist()):
        behind[i] = unlongs(x, 5)
    ends = np.full((len(p.start), 4, 4), FAR)
    ends[:, :, 0] = behind[:, :4]
    return Paths(p, p.suffixes(ends).min(axis=2), behind[:, 4] == 1)


def of_kind(table: pa.Table, kind: int) -> pa.Table:
    return table.filter(pc.equal(table["kind"], kind))


def states_of_edges(table: pa.Table, known: pa.Table) -> pa.Table:
    """For each state at the begin of a piece at a chunk's edge, the state behind it."""
    c = Chunk(table, of_kind(known, 0)["row"].to_numpy())
    paths = solved(c, of_kind(known, 1).rename_columns(["chunk", "kind", "start", "incoming"]))
    start = c.pieces.start[c.edge]
    ends = np.stack([paths.ends(np.full(len(c.pieces.start), q))[c.edge] for q in range(4)], axis=1)
    return pa.table({
        "key": c.table["conv"].take(pa.array(start)), "at": np.full(len(start), c.chunk << 1) + (start > 0), "chunk": np.full(len(start), c.chunk),
        "start": start, "state": pa.array([longs(m) for m in ends], pa.binary())})


def fold_states(states: list[bytes]) -> bytes:
    out = np.arange(4)
    for s in states:
        out = unlongs(s, 4)[out]
    return longs(out)


def spread_states(before: bytes | None, states: list[bytes]) -> list[bytes]:
    state, out = np.array([0]) if before is None else unlongs(before, 1), []
    for s in states:
        out.append(longs(state))
        state = unlongs(s, 4)[state]
    return out


def edited(table: pa.Table, known: pa.Table) -> pa.Table:
    """Audit, repaired rows, cost and counts of each piece."""
    c = Chunk(table, of_kind(known, 0)["row"].to_numpy())
    paths = solved(c, of_kind(known, 1).rename_columns(["chunk", "kind", "start", "incoming"]))
    p = c.pieces
    state = np.zeros(len(p.start), np.int64)
    begun = of_kind(known, 2)
    for start, x in zip(begun["row"].to_pylist(), begun["incoming"].to_pylist()):
        state[np.searchsorted(p.start, start)] = unlongs(x, 1)[0]
    piece, letter, row, target = paths.walk(state)
    spent = np.array([DELETE, INSERT, KEEP, REROLE])[letter] + np.where((letter >= 2) & c.cut[row], TRUNCATED, 0)
    edges = np.searchsorted(piece, np.arange(len(p.start) + 1))
    letters = "".join(LETTERS[i] for i in letter)
    stays = letter > 0
    roles, texts = c.table["role"], c.table["text"]
    kept_roles, kept_texts = roles.take(pa.array(row[stays])).to_pylist(), texts.take(pa.array(row[stays])).to_pylist()
    for i, (x, q) in enumerate(zip(letter[stays].tolist(), target[stays].tolist())):
        if x != 2:
            kept_roles[i] = NAMES[q]
        if x == 1:
            kept_texts[i] = ""
    offsets = pa.array(np.append(0, np.cumsum(stays))[edges], pa.int32())
    return pa.table({
        "conv": c.table["conv"].take(pa.array(p.start)), "chunk": np.full(len(p.start), c.chunk), "start": p.start, "part": c.edge,
        "audit": [letters[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())],
        "roles": pa.ListArray.from_arrays(offsets, pa.array(kept_roles, pa.string())),
        "texts": pa.ListArray.from_arrays(offsets, pa.array(kept_texts, pa.string())),
        "cost": np.bincount(piece, spent, len(p.start)).astype(np.int64), **c.summary()})


def repair(talk: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES, bits: int = 8) -> DataFrame:
    """Pieces of repaired conversations: the conversation's id as ``conv``, chunk and start (in this order they make up
    the conversation), audit, the repaired roles and texts, and the piece's cost and counts. A conversation inside one
    chunk is one piece."""
    if not 0 < chunk_rows <= 1 << ROW_BITS:
        raise ValueError("chunk_rows is out of range")
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = in_chunks(talk.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), said(role).alias("role"), said(text).alias("text")),
                     chunk_rows, chunk_bytes).withColumns(flags(F.col("role"), F.col("text")))
    kind = rows.schema["conv"].dataType.simpleString()
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    firsts = materialize(rows.where(~F.col("is_blank")).groupBy("conv", F.unhex(digest).alias("digest")).agg(
        F.min(F.shiftleft("chunk", ROW_BITS) + F.col("row")).alias("place")).select(
            F.shiftright("place", ROW_BITS).alias("chunk"), F.col("place").bitwiseAND((1 << ROW_BITS) - 1).alias("row")), "first_said")
    light = rows.drop("text", "role").groupBy("chunk")
    edge = f"key {kind}, at long, chunk long, start long, state binary"
    costs = materialize(light.cogroup(firsts.groupBy("chunk")).applyInArrow(lambda t, f: costs_of_edges(t, f), edge), "edge_costs")

    def placed(pieces: DataFrame, incoming: DataFrame, number: int) -> DataFrame:
        """What comes into each piece, by chunk and start."""
        back = incoming.select(F.shiftright("at", 1).alias("chunk"), F.col("at").bitwiseAND(1).alias("second"), "incoming")
        places = pieces.select("chunk", "start", (F.col("start") > 0).cast("long").alias("second"))
        return places.join(back, ["chunk", "second"]).select("chunk", F.lit(number).alias("kind"), F.col("start").alias("row"), "incoming")

    said_first = firsts.select("chunk", F.lit(0).alias("kind"), "row", F.lit(None).cast("binary").alias("incoming"))
    behind = materialize(placed(costs, scan(costs.select("key", "at", "state"), fold_costs, spread_costs, bits), 1), "behind")
    known = said_first.unionByName(behind)
    states = materialize(light.cogroup(known.groupBy("chunk")).applyInArrow(lambda t, k: states_of_edges(t, k), edge), "edge_states")
    begun = placed(states, scan(states.select("key", "at", "state"), fold_states, spread_states, bits), 2)
    return rows.groupBy("chunk").cogroup(known.unionByName(begun).groupBy("chunk")).applyInArrow(
        lambda t, k: edited(t, k), f"conv {kind}, {PIECE}")


class Running:
    """One conversation's row, built from its pieces in order."""

    def __init__(self, conv) -> None:
        self.conv, self.audit, self.sha, self.any, self.row = conv, [], hashlib.sha256(), False, None

    def take(self, r: dict) -> None:
        self.audit.append(r["audit"])
        for role, text in zip(r["roles"], r["texts"]):
            self.sha.update((f"\n{role}:{text}" if self.any else f"{role}:{text}").encode())
            self.any = True
        if self.row is None:
            self.row = {c: r[c] for c in ("cost", *COUNTS, *SEAMS)}
            return
        row = self.row
        known = r["n_turns"] > 0
        seam = int(illegal(np.array([row["last_role"]]), np.array([r["first_role"]]))[0])
        shared = known and row["n_turns"] > 0 and r["first_turn"] == row["last_turn"]
        for c in ("cost", *COUNTS):
            row[c] += r[c]
        row["illegal"] += seam
        row["n_turns"] -= shared
        row["last_role"] = r["last_role"]
        row["first_turn"], row["last_turn"] = min(row["first_turn"], r["first_turn"]), max(row["last_turn"], r["last_turn"])

    def out(self) -> tuple:
        row = self.row
        gaps = row["last_turn"] - row["first_turn"] + 1 - row["n_turns"] if row["n_turns"] else 0
        return (self.conv, gaps, *(row[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")), "".join(self.audit), self.sha.hexdigest())


DIGEST = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def digests(pieces: DataFrame, all_ids: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row for each conversation of ``all_ids``: gaps, counts of faults, cost, audit and the SHA-256 of the repaired
    rows. Pieces at chunk edges are streamed in order; conversations without rows get zeros and empty texts."""
    kind = pieces.schema["conv"].dataType.simpleString()
    names = ["conv", *(c.split()[0] for c in DIGEST.split(", "))]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        pack = lambda rows: pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], conv_type), *(pa.array([r[i] for r in rows]) for i in range(1, len(names)))], names)
        for batch in batches:
            conv_type = batch.schema.field("conv").type
            for r in batch.to_pylist():
                if now is None or now.conv != r["conv"]:
                    if now:
                        done.append(now.out())
                    now = Running(r["conv"])
                now.take(r)
            if done:
                yield pack(done)
                done = []
        if now:
            yield pack([now.out()])

    schema = f"conv {kind}, {DIGEST}"
    pieces = materialize(pieces, "repaired")
    whole = pieces.where("NOT part").mapInArrow(stream, schema)
    ordered = pieces.where("part").repartition("conv").sortWithinPartitions("conv", "chunk", "start")
    found = whole.unionByName(ordered.mapInArrow(stream, schema))
    ids = all_ids.select(F.col(conv).alias("id")).distinct()
    zero = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return ids.join(found, F.col("id").eqNullSafe(F.col("conv")), "left").select(
        F.col("id").alias(conv), *(F.coalesce(c, F.lit(zero.get(c, 0))).alias(c) for c in names[1:]))
