"""Repair of conversation structure: the cheapest edits that make the roles of a conversation a system row, if any, and pairs of
user and assistant, by Four-Russians block tables.

A row is one symbol: its role's initial (s, u, a or another) with or without a truncated text, or a row that must go. What the
rest of a conversation costs from each of the four states of the pattern (nothing yet, after s, after u, after a) is a vector;
less its smallest entry only a few vectors exist. A table holds what every block of ``BLOCK`` symbols makes of each of them, so
a conversation is processed from its end by one lookup a block. Tracing goes forward: each block is expanded backward from the
vector behind it, symbol by symbol, and of the edits on a cheapest way the one with the ASCII-least initial is taken at every
step. Two equally cheap edit strings are never one the beginning of the other, as inserts cost, so this gives the least string.

Rows stand in the order of their turns, nulls first, within a turn in the order of the digest of role and text; equal rows are
copies of each other. Null roles and texts count as one space, thus as another role and a blank text. A null conversation id is
a conversation of its own. An empty table gives no rows, repeated rows are duplicates, further columns are ignored.

Where a row's text stands first is a minimum by key, combined before its shuffle. A conversation's symbols are traced by one
task, which holds a byte or two a row, as the edit string of its result does; texts are streamed past the edits in order, and a
conversation of any length needs no more memory than one batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 4
#: Costs of the edits, and of keeping a truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
_SPACE = " \t\n\x0b\f\r"
#: Symbols: twice the class of the initial (s, u, a, other), one more if truncated; then rows that must go.
_GONE, _SYMBOLS = 8, 9
_BLANK = 9
#: States: nothing yet, after s, after u, after a. Where a kept initial leads, and where an inserted or changed role does.
_KEPT = ({0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2})
_MADE = (2, 2, 3, 2)
_ROLE = ("user", "user", "assistant", "user")
_REST = {0: "", 1: "II", 2: "I", 3: ""}
_FINAL = (0, 2 * INSERT, INSERT, 0)
#: Rows whose edits go into one row of the edit table.
SEGMENT = 4096


def _before(after: tuple[int, ...], symbol: int) -> list[int]:
    """What the rest costs before a row, from what it costs behind it."""
    def least(state: int) -> int:
        costs = [DELETE + after[state]]
        if symbol != _GONE:
            extra = TRUNCATED * (symbol & 1)
            costs.append(REROLE + extra + after[_MADE[state]])
            if symbol >> 1 in _KEPT[state]:
                costs.append(extra + after[_KEPT[state][symbol >> 1]])
        return min(costs)

    out = [least(s) for s in range(4)]
    for _ in range(3):
        out = [min(c, INSERT + out[_MADE[s]]) for s, c in enumerate(out)]
    return out


def _edits(before: list[int], after: tuple[int, ...], symbol: int, state: int) -> tuple[str, int]:
    """The least initials of cheapest edits up to and with this row, and the state behind them."""
    ops = ""
    while before[state] != DELETE + after[state]:
        if before[state] == INSERT + before[_MADE[state]]:
            ops, state = ops + "I", _MADE[state]
            continue
        to = _KEPT[state].get(symbol >> 1)
        if to is not None and before[state] == TRUNCATED * (symbol & 1) + after[to]:
            return ops + "K", to
        return ops + "R", _MADE[state]
    return ops + "D", state


class Tables:
    """All normalised cost vectors with what single symbols and whole blocks make of them."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.vectors: list[tuple[int, ...]] = [_FINAL]
        numbers = {_FINAL: 0}
        self.next: list[list[int]] = []
        self.added: list[list[int]] = []
        self.edits: list[list[list[tuple[str, int]]]] = []
        for vector in self.vectors:  # grows while it is read
            to, added, edits = [], [], []
            for symbol in range(_SYMBOLS):
                before = _before(vector, symbol)
                low = min(before)
                plain = tuple(c - low for c in before)
                if plain not in numbers:
                    numbers[plain] = len(self.vectors)
                    self.vectors.append(plain)
                to.append(numbers[plain])
                added.append(low)
                edits.append([_edits(before, vector, symbol, s) for s in range(4)])
            self.next.append(to)
            self.added.append(added)
            self.edits.append(edits)
        one, cost = np.array(self.next), np.array(self.added)
        codes = np.arange(_SYMBOLS ** block)
        at = np.repeat(np.arange(len(self.vectors))[:, None], len(codes), 1)
        total = np.zeros_like(at)
        for place in range(block):  # the last symbol of a block is its lowest digit and comes first
            symbol = codes // _SYMBOLS ** place % _SYMBOLS
            total += cost[at, symbol]
            at = one[at, symbol]
        self.block_next, self.block_added = at.tolist(), total.tolist()

    def traced(self, symbols: bytes) -> tuple[int, list[str]]:
        """The least cost, and the edits of each row (with inserts before it); inserts behind the last row come last."""
        size, vector, cost = self.block, 0, 0
        head = len(symbols) % size
        behind: list[int] = []  # the vector behind each block, the last block's first
        for at in range(len(symbols) - size, head - 1, -size):
            behind.append(vector)
            code = 0
            for symbol in symbols[at:at + size]:
                code = code * _SYMBOLS + symbol
            cost += self.block_added[vector][code]
            vector = self.block_next[vector][code]
        if head:
            behind.append(vector)
        for symbol in reversed(symbols[:head]):
            cost += self.added[vector][symbol]
            vector = self.next[vector][symbol]
        cost += self.vectors[vector][0]
        out, state, start = [], 0, 0
        for end in range(head or size, len(symbols) + 1, size):
            vectors = [behind.pop()]
            for symbol in reversed(symbols[start + 1:end]):
                vectors.append(self.next[vectors[-1]][symbol])
            for symbol in symbols[start:end]:
                ops, state = self.edits[vectors.pop()][symbol][state]
                out.append(ops)
            start = end
        out.append(_REST[state])
        return cost, out


@cache
def _tables() -> Tables:
    return Tables()


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by a checksum of ``conv_id:turn``; ``present`` is false for a row that was dropped."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    rows = conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"),
                                (kind != 0).alias("present"), F.when(kind == 3, 2).otherwise(1).alias("_n"))
    return rows.withColumn("_n", F.explode(F.sequence(F.lit(1), "_n"))).drop("_n")


def _keyed(rows: DataFrame) -> DataFrame:
    """The rows without nulls in role and text, with the digest that tells them apart; dropped rows have neither."""
    here = F.col("present") if "present" in rows.columns else F.lit(True)
    here = F.coalesce(here, F.lit(True))
    text = lambda c: F.when(here, F.coalesce(F.col(c).cast("string"), F.lit(" ")))
    out = rows.select("conv_id", F.when(here, F.col("turn").cast("long")).alias("turn"), text("role").alias("role"), text("text").alias("text"))
    return out.withColumn("key", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))


def _symbols(keyed: DataFrame) -> DataFrame:
    """(conv_id, turn, key, symbol, first): a row's symbol, and whether its role and text stand in no earlier turn."""
    end = F.rtrim("text", F.lit(_SPACE))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    # The kind stays readable for blank rows: their initials count as neighbours.
    symbol = kind * 2 + F.when(F.right(end, F.lit(1)).isin(".", "!", "?"), 0).otherwise(1)
    light = keyed.select("conv_id", "turn", "key", F.when(F.col("key").isNotNull(), symbol).cast("int").alias("symbol"), (end == "").alias("blank"))
    order = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    first = light.filter(F.col("key").isNotNull()).groupBy(F.col("conv_id").alias("_c"), F.col("key").alias("_k")).agg(F.min(order)["turn"].alias("_t"))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("key") == F.col("_k"))
    return light.join(first, same, "left").select("conv_id", "turn", "key", "symbol", "blank", F.col("turn").eqNullSafe(F.col("_t")).alias("first"))


_LEGAL = {(0, 1), (1, 2), (2, 1)}
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Conversation:
    """What is known of a conversation while its rows come by in order."""

    def __init__(self, ident):
        self.ident = ident
        self.symbols, self.starts = bytearray(), []
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = None
        self.last = None
        self.before: tuple | None = None

    def add(self, turn, key, symbol, blank, first) -> None:
        if key is None:
            return
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.distinct = turn, self.distinct + 1
        if len(self.symbols) % SEGMENT == 0:
            self.starts.append((turn, key))
        if self.last is not None and (self.last, symbol >> 1) not in _LEGAL:
            self.illegal += 1
        self.last = symbol >> 1
        if blank:
            self.blank, symbol = self.blank + 1, _GONE
        elif not first or self.before == (turn, key):
            self.duplicate, symbol = self.duplicate + 1, _GONE
        else:
            self.truncated += symbol & 1
        self.before = (turn, key)
        self.symbols.append(symbol)

    def pieces(self) -> Iterator[tuple]:
        cost, edits = _tables().traced(bytes(self.symbols))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        counts = (gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost)
        for at in range(max(len(self.starts), 1)):
            turn, key = self.starts[at] if self.starts else (None, None)
            stop = (at + 1) * SEGMENT if at + 1 < len(self.starts) else len(edits)
            yield (self.ident, turn, key, at, "".join(edits[at * SEGMENT:stop]), *(counts if at == 0 else (None,) * len(counts)))


def _in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, tuple]]:
    """Rows in order, each with whether another conversation begins."""
    before, some = None, False
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            yield not some or row[0] != before, row
            before, some = row[0], True


def _written(rows: Iterator[tuple], schema: pa.Schema, size: int = 1 << 13, held_bytes: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if len(held) == size or weight > held_bytes:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(schema)], schema=schema)


def _schema(ident: pa.DataType, *fields: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema([("conv_id", ident), *fields])


def _ddl(rows: DataFrame) -> str:
    return f"conv_id {rows.schema['conv_id'].dataType.simpleString()}"


def _pieces(keyed: DataFrame) -> DataFrame:
    """The edits of every conversation, a row for each segment of its rows; the first has the counts."""
    long = pa.int64()

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = _schema(first.schema.field(0).type, ("turn", long), ("key", pa.binary()), ("at", long), ("edits", pa.string()), *((n, long) for n in _COUNTS))

        def rows() -> Iterator[tuple]:
            own = None
            for new, (ident, *row) in _in_groups(_chained(first, batches)):
                if new:
                    if own:
                        yield from own.pieces()
                    own = _Conversation(ident)
                own.add(*row)
            if own:
                yield from own.pieces()

        yield from _written(rows(), schema)

    sorted_rows = _symbols(keyed).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "key")
    return sorted_rows.mapInArrow(trace, f"{_ddl(keyed)}, turn bigint, key binary, at bigint, edits string, " + ", ".join(f"{n} bigint" for n in _COUNTS))


def _chained(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def _with_edits(rows: DataFrame) -> DataFrame:
    """Rows and pieces of their conversation's edits in order: a piece comes before the first row it is for."""
    keyed = _keyed(rows)
    pieces = _pieces(keyed).withColumns({"role": F.lit(None).cast("string"), "text": F.lit(None).cast("string")})
    none = {n: F.lit(None).cast("long") for n in ("at", *_COUNTS)}
    texts = keyed.filter(F.col("key").isNotNull()).withColumns(none).withColumn("edits", F.lit(None).cast("string"))
    columns = ["conv_id", "turn", "key", "at", "edits", "role", "text", *_COUNTS]
    both = pieces.select(*columns).unionByName(texts.select(*columns))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "key", F.col("at").asc_nulls_last()).select(
        "conv_id", "at", "edits", "role", "text", *_COUNTS)


class _Edited:
    """Applies a conversation's edits to its rows as they come by."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.at = self.state = 0

    def _next(self) -> str | None:
        while self.pieces and self.at == len(self.pieces[0]):
            self.pieces.pop(0)
            self.at = 0
        if not self.pieces:
            return None
        self.at += 1
        return self.pieces[0][self.at - 1]

    def _made(self) -> str:
        role = _ROLE[self.state]
        self.state = _MADE[self.state]
        return role

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of this row and of the rows inserted before it, without a deleted one."""
        while (op := self._next()) == "I":
            yield op, self._made(), ""
        if op == "K":
            self.state = _KEPT[self.state]["sua".index(role[0])]
            yield op, role, text
        elif op == "R":
            yield op, self._made(), text

    def rest(self) -> Iterator[tuple[str, str, str]]:
        while self._next():
            yield "I", self._made(), ""


def _passed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, counts, None) where a conversation begins, (conv_id, None, row) for its repaired rows, (.., piece) of its edits."""
    own, before = None, None
    for new, (ident, at, edits, role, text, *counts) in _in_groups(batches):
        if new:
            if own:
                yield from ((before, "row", r) for r in own.rest())
            own, before = _Edited(), ident
            yield ident, "counts", counts
        if at is not None:
            own.pieces.append(edits)
            yield ident, "edits", edits
        else:
            yield from ((ident, "row", r) for r in own.row(role, text))
    if own:
        yield from ((before, "row", r) for r in own.rest())


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text, edit (K, R or I)."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = _schema(first.schema.field(0).type, ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string()))

        def out() -> Iterator[tuple]:
            place = 0
            for ident, kind, x in _passed(_chained(first, batches)):
                if kind == "counts":
                    place = 0
                elif kind == "row":
                    yield ident, place, x[1], x[2], x[0]
                    place += 1

        yield from _written(out(), schema)

    return _with_edits(rows).mapInArrow(emit, f"{_ddl(rows)}, place bigint, role string, text string, edit string")


def audited(rows: DataFrame) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit (initials of the edits), repaired_sha256.

    ``gaps`` counts the turns missing between the first and the last; ``illegal`` the neighbours whose initials are not su, ua or
    au; the faults are those of the rows as given. Rows whose column ``present``, if there is one, is false only name their
    conversation. A conversation without rows has zeros, no edits and the digest of an empty string.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = _schema(first.schema.field(0).type, *((n, pa.int64()) for n in _COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string()))

        def out() -> Iterator[tuple]:
            held = None
            for ident, kind, x in _passed(_chained(first, batches)):
                if kind == "counts":
                    if held:
                        yield (*held, "".join(audit), digest.hexdigest())
                    held, audit, digest, some = (ident, *x), [], hashlib.sha256(), False
                elif kind == "edits":
                    audit.append(x)
                else:
                    digest.update(("\n" * some + x[1] + ":" + x[2]).encode())
                    some = True
            if held:
                yield (*held, "".join(audit), digest.hexdigest())

        yield from _written(out(), schema)

    return _with_edits(rows).mapInArrow(emit, f"{_ddl(rows)}, " + ", ".join(f"{n} bigint" for n in _COUNTS) + ", audit string, repaired_sha256 string")
