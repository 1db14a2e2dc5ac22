"""Conversation structure repair as a shortest path over scalar big integers.

A repair keeps, reroles or deletes each row and inserts empty turns, so that the roles read: perhaps a system turn, then user and assistant in turns. An
edge's weight is one integer: the cost above, and below it the edit's letter as an octal digit at the letter's own place in a field of
fixed width, whose unused end is zero. A path's weight is the sum, so the smaller integer is the cheaper path and, at equal cost, the one whose letters
come first in ASCII order (D, I, K, R are 1, 2, 3, 4; the padding is below all). Plain minima over (row, state) decide everything:
inserts stand before the row they precede, so two paths to a node have the same number of row edits, end in one, and neither's letters begin the other's.

A conversation may be of any length. Rows are sorted by range, cut into blocks of 256 and each block gives the weights from every state to every state; a fold
over a conversation's blocks adds them with the rank of the path so far as two digits in between, which is the same order. The digest of the repaired text is
sequential by nature: rows of a conversation are streamed through one task, in constant memory but for the audit itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinaria.llm.common import hot_keys, join_hot
from opinaria.session import cut_lineage

BLANKS = " \t\n\x0b\x0c\r"
BLOCK = 256
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LETTERS = str.maketrans("1234", "DIKR")
D, I, K, R = 1, 2, 3, 4
START, SYSTEM, USER, ASSISTANT = range(4)
# The state that a turn of a role leads to, by the state before it.
SPOKEN = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # of an inserted or reroled turn
ENDING = {START: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}  # inserts that complete a conversation
LEGAL = {"su", "ua", "au"}
FINE, BLANK, DUPLICATE, CUT = range(4)


def field_bits(rows: int) -> int:
    """Width of the letters of a block: a row takes two inserts and one edit at most."""
    return 9 * rows


def block_weights(rows: list[tuple[str, int]], start: int) -> list[int | None]:
    """Least weight from ``start`` to every state over rows of (role initial, fault); two zero bits part cost and letters."""
    bits = field_bits(len(rows))
    unit = bits + 2
    best: list[tuple[int, int] | None] = [None] * 4
    best[start] = (0, 0)  # weight, letters so far
    for initial, fault in rows:
        gap = list(best)
        fresh = list(best)
        for _ in range(2):  # a second insert can complete a pair, a third only comes back
            added: list[tuple[int, int] | None] = [None] * 4
            for state, node in enumerate(fresh):
                if node:
                    to = NEXT[state]
                    path = (node[0] + (INSERT << unit) + (I << bits - 3 * (node[1] + 1)), node[1] + 1)
                    if added[to] is None or path < added[to]:
                        added[to] = path
            fresh = added
            gap = [min(filter(None, pair), default=None) for pair in zip(gap, added)]
        best = [None] * 4
        extra = TRUNCATED if fault == CUT else 0
        for state, node in enumerate(gap):
            if not node:
                continue
            weight, n = node
            place = bits - 3 * (n + 1)
            steps = [(state, DELETE, D)]
            if fault not in (BLANK, DUPLICATE):
                steps.append((NEXT[state], REROLE + extra, R))
                if (to := SPOKEN.get(initial, {}).get(state)) is not None:
                    steps.append((to, KEEP + extra, K))
            for to, cost, letter in steps:
                path = (weight + (cost << unit) + (letter << place), n + 1)
                if best[to] is None or path < best[to]:
                    best[to] = path
    return [node and node[0] for node in best]


class Fold:
    """Best path of one conversation over its blocks; counts of faults, gaps and illegal neighbours."""

    def __init__(self):
        self.live = {START: (0, 0)}  # state: cost, rank of its letters among the live paths
        self.chosen: list[tuple[int, dict[int, tuple[int, int]]]] = []  # per block: bits, and by state the state before and the letters
        self.counts = [0, 0, 0, 0]
        self.illegal = self.distinct = 0
        self.last: str | None = None
        self.low = self.high = None

    def add(self, rows: int, weights: list[bytes | None], counts: list[int], illegal: int, first: str, last: str, low: int | None, high: int | None, distinct: int) -> None:
        bits = field_bits(rows)
        field = (1 << bits + 2) - 1
        reached: dict[int, tuple[int, int]] = {}
        for state, (cost, rank) in self.live.items():
            for to in range(4):
                if (cell := weights[4 * state + to]) is not None:
                    path = int.from_bytes(cell, "big") + (cost << bits + 2) + (rank << bits)
                    if to not in reached or path < reached[to][0]:
                        reached[to] = (path, state)
        order = sorted(reached, key=lambda s: reached[s][0] & field)
        self.live = {s: (reached[s][0] >> bits + 2, order.index(s)) for s in order}
        self.chosen.append((bits, {s: (reached[s][1], reached[s][0] & (field >> 2)) for s in order}))
        self.counts = [a + b for a, b in zip(self.counts, counts)]
        self.illegal += illegal + (self.last is not None and self.last + first not in LEGAL)
        self.last = last
        if low is not None:
            self.distinct += distinct - (self.high == low)
            self.low, self.high = low if self.low is None else self.low, high

    def audit(self) -> tuple[int, str]:
        """Cost and letters of the best complete path."""
        cost, _, state = min((cost + INSERT * ENDING[s], rank, s) for s, (cost, rank) in self.live.items())
        parts = ["I" * ENDING[state]]
        for bits, back in reversed(self.chosen):
            state, letters = back[state]
            parts.append(f"{letters:0{bits // 3}o}".rstrip("0").translate(LETTERS))
        return cost, "".join(reversed(parts))

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.distinct


class Replay:
    """Applies the letters of an audit to rows as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.digest, self.empty = audit, 0, START, hashlib.sha256(), True

    def _speak(self, role: str, text: str, state: int) -> None:
        self.digest.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
        self.state, self.empty = state, False

    def _new(self, text: str) -> None:
        state = NEXT[self.state]
        self._speak("user" if state == USER else "assistant", text, state)

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._new("")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self._speak(role, text, SPOKEN[role[0]][self.state])
        elif letter == "R":
            self._new(text)


def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, turn, role, text) with planted faults by crc32 of "conv_id:turn" modulo 20: 0 drops the row, 1 empties the text, 2 removes its full
    stops, exclamation and question marks, 3 repeats the row, 4 makes it a user's. Nulls in names and texts become one space; other columns are ignored."""
    blank = F.lit(" ")
    written = F.concat(F.coalesce(F.col(conv_col).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), blank))
    mark = F.pmod(F.crc32(written.cast("binary")), F.lit(20))
    text, role = F.coalesce(F.col(text_col), blank), F.coalesce(F.col(role_col), blank)
    copies = F.explode(F.array_repeat(F.lit(0), F.when(mark == 0, 0).when(mark == 3, 2).otherwise(1)))
    return conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.when(mark == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(mark == 1, F.lit("")).when(mark == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), copies.alias("copy")).drop("copy")


def fault(text: Column) -> Column:
    """BLANK, CUT or FINE of a text alone."""
    solid = F.rtrim(text, F.lit(BLANKS))
    return F.when(solid == "", BLANK).when(F.right(solid, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(CUT)


SUMMARY = ("conv_id {kind}, pos long, n int, weights array<binary>, counts array<long>, illegal long, first string, last string, low long, high long, distinct long")


def _summaries(kind: str):
    """Rows (conv_id, pos, turn, initial, fault), sorted by pos, to one summary per conversation and block."""

    def summary(conv, rows: list[tuple], inner: bool) -> tuple:
        codes = [(r[3], r[4]) for r in rows]
        weights: list[bytes | None] = []
        for start in range(4):
            found = [None] * 4 if inner and start != START else block_weights(codes, start)
            weights += [None if w is None else w.to_bytes(w.bit_length() // 8 + 1, "big") for w in found]
        turns = [r[2] for r in rows if r[2] is not None]
        initials = [r[3] for r in rows]
        return (conv, rows[0][1], len(rows), weights, [sum(c[1] == k for c in codes) for k in range(4)], sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
                initials[0], initials[-1], min(turns, default=None), max(turns, default=None), len(set(turns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        inner = False  # the conversation begins inside the block, so it begins in the first state
        done: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (row[0] != held[0][0] or row[1] // BLOCK != held[0][1] // BLOCK):
                    done.append(summary(held[0][0], held, inner))
                    inner = row[1] // BLOCK == held[0][1] // BLOCK
                    held = []
                held.append(row)
            yield _summary_batch(done, batch.schema.field(0).type)
            done = []
        if held:
            yield _summary_batch([summary(held[0][0], held, inner)], batch.schema.field(0).type)

    return run, SUMMARY.format(kind=kind)


def _summary_batch(rows: list[tuple], conv: pa.DataType) -> pa.RecordBatch:
    kinds = [conv, pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    columns = list(zip(*rows)) or [[]] * len(kinds)
    names = ["conv_id", "pos", "n", "weights", "counts", "illegal", "first", "last", "low", "high", "distinct"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _repairs(kind: str):
    """Per conversation its summaries, then its rows, both by pos: to one result row."""
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = replay = None
        current, cost = None, 0
        done: list[tuple] = []

        def end() -> None:
            replay.inserts()
            done.append((current, fold.gaps(), fold.counts[BLANK], fold.counts[DUPLICATE], fold.counts[CUT], fold.illegal, cost, replay.audit, replay.digest.hexdigest()))

        for batch in batches:
            for conv, is_text, _, role, text, n, weights, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if fold is None or conv != current:
                    if fold is not None:
                        end()
                    current, fold, replay = conv, Fold(), None
                if not is_text:
                    fold.add(n, weights, *rest)
                    continue
                if replay is None:
                    cost, audit = fold.audit()
                    fold.chosen, replay = [], Replay(audit)
                replay.row(role, text)
            yield _result_batch(done, batch.schema.field(0).type)
            done.clear()
        if fold is not None:
            end()
            yield _result_batch(done, batch.schema.field(0).type)

    return run, f"conv_id {kind}, " + ", ".join(f"{n} long" for n in names) + ", audit string, repaired_sha256 string"


def _result_batch(rows: list[tuple], conv: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 9
    kinds = [conv] + [pa.int64()] * 6 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                      names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])


def judged_rows(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows in order (conv_id, pos, turn, role, text, ...; pos increases by conversation, turn with nulls first, role and text), and their codes without
    texts (conv_id, pos, turn, initial of the role, first fault)."""
    blank = F.lit(" ")
    named = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                                 F.coalesce(F.col(role_col).cast("string"), blank).alias("role"), F.coalesce(F.col(text_col).cast("string"), blank).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    conv = F.col("conv_id").cast("string")
    written = F.concat_ws(":", F.coalesce(F.octet_length(conv), F.lit(-1)).cast("string"), F.coalesce(conv, F.lit("")), F.octet_length("role").cast("string"), "role", "text")
    rows = cut_lineage(named.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", F.monotonically_increasing_id().alias("pos"), "turn", "role", "text", fault(F.col("text")).alias("fault"), F.unhex(F.sha2(written, 256)).alias("same")))
    repeated = cut_lineage(rows.where(F.col("fault") != BLANK).groupBy("same").agg(F.count(F.lit(1)).alias("many"), F.min("pos").alias("first")).where("many > 1"))
    hot = hot_keys(repeated, "same", "many", rows.count())
    found = join_hot(rows.select("conv_id", "pos", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "same"), repeated.drop("many"), "same", hot=hot)
    again = F.coalesce(F.col("first") < F.col("pos"), F.lit(False)) & (F.col("fault") != BLANK)
    codes = found.select("conv_id", "pos", "turn", "initial", F.when(again, DUPLICATE).otherwise(F.col("fault")).alias("fault"))
    return rows, codes


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows count in the order of their turns, nulls first; rows of one turn by role and text. A null role or text counts as one space; rows without a
    conversation id form one conversation. ``gaps`` are the turns missing between the smallest and the largest. A row's first fault counts: blank,
    duplicate (role and text seen before) or truncated (the text does not end in a full stop, exclamation or question mark); ``illegal`` are
    neighbours whose roles do not follow each other. Keeping is free, a truncated row that is not deleted costs 3, rerole and insert 3, delete 4,
    required for blank and duplicate rows. ``audit`` holds the first letters of the cheapest edits, the ASCII-least of these; the digest is of the repaired
    "role:text" joined by newlines. With ``ids`` (a table with the column ``conv_col``) every id there has a row; without rows: zeros, no edits, the digest of
    nothing. Other columns are ignored; an empty table gives no rows.
    """
    rows, codes = judged_rows(conversations, conv_col, turn_col, role_col, text_col)
    kind = rows.schema["conv_id"].dataType.simpleString()
    summarise, summary_schema = _summaries(kind)
    block = F.shiftright("pos", BLOCK.bit_length() - 1)
    blocks = cut_lineage(codes.repartition(block).sortWithinPartitions("pos").mapInArrow(summarise, summary_schema))
    empty = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in blocks.schema.fields[2:]}
    both = blocks.select("conv_id", F.lit(False).alias("is_text"), "pos", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), *empty).unionByName(
        rows.select("conv_id", F.lit(True).alias("is_text"), "pos", "role", "text", *empty.values()))
    resolve, schema = _repairs(kind)
    done = both.repartition("conv_id").sortWithinPartitions("conv_id", "is_text", "pos").mapInArrow(resolve, schema)
    if ids is not None:
        wanted = ids.select(F.col(conv_col).alias("_id")).distinct()
        done = wanted.join(done, F.col("_id").eqNullSafe(F.col("conv_id")), "left").select(
            F.col("_id").alias("conv_id"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in done.columns[1:7]],
            F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
    return done.withColumnRenamed("conv_id", conv_col)
