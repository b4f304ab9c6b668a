"""Conversations repaired to alternating turns at least cost, by block tables over cost vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mixloom.session import materialize

# White space of a blank text, ends of a whole one, and the costs of the edits.
BLANKS = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1

# Symbols of a block, and rows of a piece: a stretch of the sorted rows that one task repairs.
BLOCK = 3
PIECE_ROWS = 100_000

# States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
# The state after a turn that fits, added or given another role.
FITTING = (USER, USER, ASSISTANT, USER)
ACCEPTING = (START, ASSISTANT)
# By first letter of the role: the states it may be kept in, and the state after it.
KEPT = {0: {START: SYSTEM}, 1: {START: USER, SYSTEM: USER, ASSISTANT: USER}, 2: {USER: ASSISTANT}, 3: {}}
# A symbol is twice the letter's number (s, u, a, other), one more if truncated; or this one.
MUST_GO = 8
SYMBOLS = 9
# Letters that may follow each other.
LEGAL = {(0, 1), (1, 2), (2, 1)}
ROLES = {USER: "user", ASSISTANT: "assistant"}


def _with_inserts(cost: list[int]) -> list[int]:
    for _ in range(3):
        cost = [min(cost[q], INSERT + cost[FITTING[q]]) for q in range(4)]
    return cost


class Blocks:
    """Least costs to go from every state, normalised, and how symbols and blocks of symbols change them.

    ``vectors`` are all that can occur; ``step`` and ``gain`` give the vector left of a
    symbol, and what was subtracted, from the one right of it; ``edits`` and ``leave``
    the first cheapest edits (in ASCII order) and the state they lead to. ``block_``
    tables do the same for ``size`` symbols, numbered in base nine from the left.
    """

    def __init__(self, size: int):
        self.size = size
        final = _with_inserts([0 if q in ACCEPTING else 10**6 for q in range(4)])
        self.vectors, numbers = [tuple(final)], {tuple(final): 0}
        step, gain, edits, leave = [], [], [], []
        for vector in self.vectors:
            rows = [self._before(vector, symbol) for symbol in range(SYMBOLS)]
            for cost, _, _ in rows:
                normal = tuple(c - min(cost) for c in cost)
                if normal not in numbers:
                    numbers[normal] = len(self.vectors)
                    self.vectors.append(normal)
            step.append([numbers[tuple(c - min(cost) for c in cost)] for cost, _, _ in rows])
            gain.append([min(cost) for cost, _, _ in rows])
            edits.append([e for _, e, _ in rows])
            leave.append([q for _, _, q in rows])
        self.step, self.gain = np.array(step), np.array(gain)
        self.edits, self.leave = edits, np.array(leave)
        blocks = np.array(list(product(range(SYMBOLS), repeat=size)))
        every = np.arange(len(self.vectors))[:, None]
        right = np.broadcast_to(every, (len(every), len(blocks)))
        rights, total = [], np.zeros(right.shape, dtype=np.int64)
        for column in range(size - 1, -1, -1):
            rights.insert(0, right)
            total = total + self.gain[right, blocks[:, column]]
            right = self.step[right, blocks[:, column]]
        state = np.broadcast_to(np.arange(4), (*right.shape, 4))
        for column in range(size):
            state = self.leave[rights[column][..., None], blocks[:, column][None, :, None], state]
        self.block_step, self.block_gain, self.block_leave = right, total, state

    @staticmethod
    def _before(right: tuple[int, ...], symbol: int) -> tuple[list[int], list[str], list[int]]:
        letter, late = divmod(symbol, 2)

        def choices(q: int) -> list[tuple[str, int, int]]:
            found = [("D", DELETE + right[q], q)]
            if symbol != MUST_GO:
                if q in KEPT[letter]:
                    found.append(("K", late * TRUNCATED + right[KEPT[letter][q]], KEPT[letter][q]))
                found.append(("R", REROLE + late * TRUNCATED + right[FITTING[q]], FITTING[q]))
            return found

        cost = _with_inserts([min(c for _, c, _ in choices(q)) for q in range(4)])
        edits, leave = [], []
        for q in range(4):
            made = ""
            while True:
                options = [(e, after) for e, c, after in choices(q) if c == cost[q]]
                if INSERT + cost[FITTING[q]] == cost[q]:
                    options.append(("I", FITTING[q]))
                edit, after = min(options)
                made, q = made + edit, after
                if edit != "I":
                    break
            edits.append(made)
            leave.append(q)
        return cost, edits, leave

    def codes(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols before the first whole block, and the numbers of the blocks."""
        head = len(symbols) % self.size
        powers = SYMBOLS ** np.arange(self.size - 1, -1, -1)
        return symbols[:head], symbols[head:].reshape(-1, self.size) @ powers

    def function(self, symbols: np.ndarray) -> tuple[list[int], list[int]]:
        """A stretch for every vector right of it: the vector left of it, and the state left from each state."""
        head, codes = self.codes(symbols)
        right = np.arange(len(self.vectors))
        singles, blocks = [], []
        for code in codes[::-1]:
            blocks.append(right)
            right = self.block_step[right, code]
        for symbol in head[::-1]:
            singles.append(right)
            right = self.step[right, symbol]
        state = np.broadcast_to(np.arange(4), (len(right), 4))
        for symbol, before in zip(head, singles[::-1]):
            state = self.leave[before[:, None], symbol, state]
        for code, before in zip(codes, blocks[::-1]):
            state = self.block_leave[before[:, None], code, state]
        return right.tolist(), state.ravel().tolist()

    def trace(self, symbols: np.ndarray, right: int, state: int) -> tuple[list[str], list[int]]:
        """The edits of every row and the states before and after them.

        Known are the vector right of the stretch and the state left of it.

        Blocks are passed from the last to the first by lookup; then each, from the
        first on, is expanded backward and its edits are read off forward, so the first
        edit that differs decides between edits of one cost.
        """
        head, codes = self.codes(symbols)
        rights = []
        for code in codes[::-1].tolist():
            rights.append(right)
            right = int(self.block_step[right, code])
        parts = [symbols[len(head) + i * self.size:][: self.size].tolist() for i in range(len(codes))]
        if len(head):
            parts.insert(0, head.tolist())
            rights.append(right)
        made, states = [], [state]
        for part, right in zip(parts, rights[::-1]):
            inner = [right]
            for symbol in part[:0:-1]:
                inner.append(int(self.step[inner[-1], symbol]))
            for symbol, vector in zip(part, inner[::-1]):
                made.append(self.edits[vector][symbol][state])
                state = int(self.leave[vector, symbol, state])
                states.append(state)
        return made, states


@cache
def tables(size: int) -> Blocks:
    return Blocks(size)


@cache
def _roles(edits: str, state: int) -> tuple[list[str], str | None]:
    """Roles inserted before a row, and the role it is given, if another."""
    inserted = []
    for _ in range(edits.count("I")):
        state = FITTING[state]
        inserted.append(ROLES[state])
    return inserted, ROLES[FITTING[state]] if edits.endswith("R") else None


def _closing(state: int) -> list[str]:
    """Roles inserted after the last row."""
    inserted = []
    while state not in ACCEPTING:
        state = FITTING[state]
        inserted.append(ROLES[state])
    return inserted


def _runs(names: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(names[1:] != names[:-1]) + 1
    return list(zip([0, *edges.tolist()], [*edges.tolist(), len(names)]))


def _edge_rows(size: int):
    def edges(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_at")
        symbols, letters = rows["symbol"].to_numpy(), rows["letter"].to_numpy()
        runs = _runs(rows["name"].to_numpy())
        found = []
        for start, end in {runs[0], runs[-1]}:
            left, leave = tables(size).function(symbols[start:end])
            found.append((rows["name"].iloc[start], int(rows["_piece"].iloc[0]), left, leave, int(letters[end - 1])))
        return pd.DataFrame(found, columns=["name", "_piece", "left", "leave", "last_letter"])

    return edges


def _linked(chunks: pd.DataFrame) -> pd.DataFrame:
    """What stands right and left of every stretch of one conversation."""
    chunks = chunks.sort_values("_piece")
    right, rights = 0, []
    for left in chunks["left"][::-1]:
        rights.append(right)
        right = int(left[right])
    state, letter, found = START, -1, []
    for (_, row), vector in zip(chunks.iterrows(), rights[::-1]):
        found.append((row["name"], row["_piece"], vector, state, letter, len(found) == len(chunks) - 1))
        state, letter = int(row["leave"][vector * 4 + state]), row["last_letter"]
    return pd.DataFrame(found, columns=["name", "_piece", "right_vector", "state", "letter_before", "is_last"])


def _traced(size: int):
    def trace(rows: pd.DataFrame, borders: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_at")
        symbols, letters = rows["symbol"].to_numpy(), rows["letter"].to_numpy()
        names = rows["name"].to_numpy()
        known = {b.name_: b for b in borders.rename(columns={"name": "name_"}).itertuples()}
        edits, inserted, given, closing, illegal = [], [], [], [], []
        for start, end in _runs(names):
            border = known.get(names[start])
            right, state = (border.right_vector, border.state) if border else (0, START)
            before = border.letter_before if border else -1
            made, states = tables(size).trace(symbols[start:end], right, state)
            edits += made
            for edit, state in zip(made, states):
                roles, role = _roles(edit, state)
                inserted.append(roles)
                given.append(role)
            closing += [[]] * (end - start - 1) + [_closing(states[-1]) if not border or border.is_last else []]
            pairs = zip([before, *letters[start:end - 1].tolist()], letters[start:end].tolist())
            illegal += [a >= 0 and (a, b) not in LEGAL for a, b in pairs]
        return pd.DataFrame({
            "_piece": rows["_piece"], "_at": rows["_at"], "made": edits, "inserted": inserted, "given": given,
            "closing": closing, "illegal": illegal,
        })

    return trace


def _name(key: Column) -> Column:
    """A key as text that also tells NULL from every text."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))


def _ordered(turns: DataFrame, piece_rows: int) -> DataFrame:
    """Rows in order, written in pieces of about ``piece_rows``, with their flags."""
    trimmed = F.btrim("text", F.lit(BLANKS))
    flagged = turns.withColumns({
        "name": _name(F.col("conv_id")),
        "letter": F.coalesce(*[F.when(F.substring("role", 1, 1) == c, i) for i, c in enumerate("sua")], F.lit(3)),
        "blank": trimmed == "", "unended": ~F.substring(trimmed, -1, 1).isin(*ENDS),
        "digest": F.md5("text"), "_row": F.monotonically_increasing_id(),
    })
    order = ["name", F.asc_nulls_first("turn"), "role", "digest", "_row"]
    pieces = turns.count() // piece_rows + 1
    placed = flagged.repartitionByRange(pieces, *order).sortWithinPartitions(*order)
    low_bits = F.lit((1 << 33) - 1)
    return materialize(placed.drop("_row").withColumns({
        "_piece": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(low_bits),
    }), "turns")


def repair_turns(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    block: int = BLOCK, piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """The cheapest edits that make each conversation ``(s?(ua)+)?`` by first letters of its roles.

    One row per turn: ``conv_id``, ``turn``, ``role``, ``text``, ``fault`` (blank, duplicate,
    truncated or NULL, the first that holds), ``illegal`` (the roles of the turn before
    and of this one do not follow each other), ``edits`` (insertions ``I`` before the turn,
    then ``K``, ``R`` or ``D``; then insertions after the last turn), ``repaired_role`` (NULL
    if deleted), ``lines`` (the repaired ``role:text`` lines that stand for it), ``cost``,
    and ``_piece``, ``_at``, which order all rows. Of edits of one cost those that are
    least in ASCII order are taken.

    Turns are ordered by ``turn``, NULL first, then by role and a digest of the text;
    NULL roles and texts count as one space, a NULL ``conv_id`` is a conversation of its
    own. Other columns are dropped; no rows give no rows.

    Rows are range partitioned into pieces and written; a conversation may span
    any number of them, however many of all rows it holds. Each piece tells, for every
    possible vector right of it, the vector left of it, for its first and its
    last conversation only; these few rows are linked, and each piece is then traced alone.
    """
    blank = F.lit(" ")
    plain = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, blank).alias("role"),
        F.coalesce(text, blank).alias("text"),
    )
    ordered = _ordered(plain, piece_rows)
    first = ordered.groupBy("name", "role", "digest").agg(F.min(F.struct("_piece", "_at")).alias("at"))
    first = first.select("at._piece", "at._at", F.lit(True).alias("first"))
    is_new = F.coalesce("first", F.lit(False))
    fault = F.when(F.col("blank"), "blank").when(~is_new, "duplicate").when(F.col("unended"), "truncated")
    symbol = F.when(F.col("blank") | ~is_new, MUST_GO).otherwise(F.col("letter") * 2 + F.col("unended").cast("int"))
    light = materialize(
        ordered.select("name", "letter", "blank", "unended", "_piece", "_at")
        .join(first, ["_piece", "_at"], "left")
        .select("name", "letter", symbol.alias("symbol"), fault.alias("fault"), "_piece", "_at"), "turn-symbols",
    )
    symbols = light.select("name", "letter", "symbol", "_piece", "_at")
    edges = symbols.groupBy("_piece").applyInPandas(
        _edge_rows(block), "name string, _piece int, left array<int>, leave array<int>, last_letter int"
    )
    borders = edges.groupBy("name").applyInPandas(
        _linked, "name string, _piece int, right_vector int, state int, letter_before int, is_last boolean"
    )
    traced = materialize(symbols.groupBy("_piece").cogroup(borders.groupBy("_piece")).applyInPandas(
        _traced(block), "_piece int, _at bigint, made string, inserted array<string>, given string, "
        "closing array<string>, illegal boolean",
    ), "turn-edits")
    rows = ordered.select("conv_id", "turn", "role", "text", "name", "_piece", "_at").join(
        light.select("_piece", "_at", "fault"), ["_piece", "_at"]
    ).join(traced, ["_piece", "_at"])
    edits = F.concat("made", F.repeat(F.lit("I"), F.size("closing")))
    count = lambda letter: F.regexp_count(edits, F.lit(letter)).cast("bigint")
    gone = F.endswith("made", F.lit("D"))
    late = (~gone & F.coalesce(F.col("fault") == "truncated", F.lit(False))).cast("bigint")
    cost = INSERT * count("I") + REROLE * count("R") + DELETE * count("D") + TRUNCATED * late
    final = F.when(~gone, F.coalesce("given", "role"))
    line = lambda r: F.concat(r, F.lit(":"))
    own = F.when(gone, F.array().cast("array<string>")).otherwise(F.array(F.concat(final, F.lit(":"), "text")))
    lines = F.concat(F.transform("inserted", line), own, F.transform("closing", line))
    return rows.select(
        "conv_id", "turn", "role", "text", "fault", "illegal", edits.alias("edits"), final.alias("repaired_role"),
        lines.alias("lines"), cost.alias("cost"), "_piece", "_at",
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and checksum of every conversation, from its rows one after another."""
    current, audit, digest, fresh = None, [], hashlib.sha256(), True

    def row() -> pa.RecordBatch:
        columns = [pa.array([current]), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])]
        return pa.RecordBatch.from_arrays(columns, ["name", "audit", "repaired_sha256"])

    for batch in batches:
        for name, edits, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if name != current:
                if current is not None:
                    yield row()
                current, audit, digest, fresh = name, [], hashlib.sha256(), True
            audit.append(edits)
            for line in lines.as_py():
                digest.update(line.encode() if fresh else b"\n" + line.encode())
                fresh = False
    if current is not None:
        yield row()


def conversation_reports(repaired: DataFrame, conversations: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row for every conversation of ``conversations``: faults, cost, edits and a checksum of the repair.

    The checksum is of the repaired lines joined by line feeds; SHA-256 takes its input
    in order, so the rows of a conversation pass through one task, sorted by Spark and never
    held. All else is summed before it is shuffled. A conversation without rows in
    ``repaired`` has zeros, no edits and the checksum of the empty text.
    """
    named = repaired.withColumn("name", _name(F.col("conv_id")))
    count = lambda test: F.sum(F.coalesce(test, F.lit(False)).cast("bigint"))
    sums = named.groupBy("name").agg(
        *[count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        count(F.col("illegal")).alias("illegal"), F.sum("cost").alias("cost"),
    )
    turns = named.filter("turn IS NOT NULL").select("name", "turn").distinct()
    gaps = turns.groupBy("name").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).cast("bigint").alias("gaps"))
    digests = (
        named.select("name", "edits", "lines", "_piece", "_at").repartition("name")
        .sortWithinPartitions("name", "_piece", "_at").select("name", "edits", "lines")
        .mapInArrow(_digests, "name string, audit string, repaired_sha256 string")
    )
    whole = conversations.select(F.col(conv).alias("conv_id"), _name(F.col(conv)).alias("name")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return whole.join(sums, "name", "left").join(gaps, "name", "left").join(digests, "name", "left").select(
        F.col("conv_id").alias(conv), *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def damage(conversations: DataFrame) -> DataFrame:
    """Turns with faults put in by the checksum of their conversation and number, NULLs as one space."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = conversations.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), kind.alias("_kind"))
    return rows.filter(F.col("_kind") != 0).select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")
