"""Repair of conversations by weighted interval parsing.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles. The repair
grammar is in Chomsky normal form: its symbols are pairs of states of that pattern, a
row derives ``p..q`` by one of its edits, and ``p..q`` splits into ``p..r r..q``. Every
cell of the chart holds, for each symbol, the least (cost, audit) that turns a span of
rows into it; insertions are closed over before and after each row. Spans are combined
bottom-up by their length.

Costs add up and equal costs never make one audit the beginning of another (every letter
that is not an insertion stands for a row, and a further insertion costs), so the least
of two parts joined is the joined least, and a span can be parsed for itself. A row
enters only by its initial and its fault. Consecutive rows of a conversation are parsed
in segments of up to ``SEGMENT``, wherever they lie, and the cells of the segments are
combined by doubling; a very long conversation is parsed by many tasks. Its texts pass
one task as a stream, in order, because they are hashed or written in one piece.

Defined results: a null role or text is one space; an initial other than ``s``, ``u``
and ``a``, or none, cannot be kept; rows are ordered by turn (null first), then role,
then text, so repeated rows lie behind each other; a null conv_id is a conversation of
its own; blank texts are faults; no rows give no edits; further columns are ignored. A
conversation is limited by its audit, and 11 cells of that length, which must fit a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.text import tagged
from footfall.session import stage

SEGMENT = 16
# The white space and the sentence ends that the query contract names.
WHITE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
LEGAL = ("su", "ua", "au")
DELETE, REROLE, INSERT, CUT = 3, 2, 2, 1
ROLES = {"u": "user", "a": "assistant"}
# States: at the start, after s, after u, after a; the pattern may end at the start and after a.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL = (0, 3)

Cells = dict[tuple[int, int], tuple[int, str]]


def _least(cells: Cells, symbol: tuple[int, int], cost: int, audit: str) -> None:
    old = cells.get(symbol)
    if old is None or (cost, audit) < old:
        cells[symbol] = (cost, audit)


def join_spans(left: Cells, right: Cells, into: Cells | None = None) -> Cells:
    """All derivations ``p..q -> p..r r..q`` of two adjacent spans."""
    out = {} if into is None else into
    for (p, r), (cost, audit) in left.items():
        for q in range(4):
            other = right.get((r, q))
            if other is not None:
                _least(out, (p, q), cost + other[0], audit + other[1])
    return out


def _closure() -> Cells:
    """Cheapest insertions from every state to every other."""
    cells: Cells = {(p, p): (0, "") for p in range(4)}
    once = dict(cells)
    for (p, initial), q in STEPS.items():
        if initial in ROLES:
            _least(once, (p, q), INSERT, "I")
    for _ in range(4):
        cells = join_spans(cells, once)
    return cells


INSERTS = _closure()


@lru_cache(maxsize=64)
def row_cells(code: str) -> Cells:
    """Cells of one row, from its initial (``s u a x``) and its fault (``k`` none, ``b d t``)."""
    initial, fault = code
    edits: Cells = {(p, p): (DELETE, "D") for p in range(4)}
    if fault in "kt":
        cut = CUT if fault == "t" else 0
        for (p, step), q in STEPS.items():
            if step == initial:
                _least(edits, (p, q), cut, "K")
            if step in ROLES:
                _least(edits, (p, q), REROLE + cut, "R")
    return join_spans(join_spans(INSERTS, edits), INSERTS)


@lru_cache(maxsize=50_000)
def parse(codes: str) -> Cells:
    """Cells of a whole segment: a chart over all its spans, by growing length and over all splits."""
    n = len(codes) // 2
    chart = {(k, k + 1): row_cells(codes[2 * k : 2 * k + 2]) for k in range(n)}
    for length in range(2, n + 1):
        for low in range(n - length + 1):
            cells: Cells = {}
            for middle in range(low + 1, low + length):
                join_spans(chart[low, middle], chart[middle, low + length], cells)
            chart[low, low + length] = cells
    return chart[0, n]


def join_all(spans: list[Cells]) -> Cells:
    """Cells of adjacent spans together, pairs first, then pairs of pairs."""
    while len(spans) > 1:
        joined = [join_spans(a, b) for a, b in zip(spans[::2], spans[1::2])]
        spans = joined + ([spans[-1]] if len(spans) % 2 else [])
    return spans[0]


def cheapest(cells: Cells) -> tuple[int, str]:
    return min(cells[0, q] for q in FINAL if (0, q) in cells)


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with drops, empty and cut texts, repeats and wrong roles, by a hash of the key."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", "".join(ENDS), "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")


def ordered(rows: DataFrame) -> DataFrame:
    """The rows with their conversation key and ``at``, which orders all rows of a conversation.

    Ranges, not conversations, are dealt out, so a long conversation fills many partitions.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(tagged(F.col("conv_id")).alias("conv"), F.col("turn").cast("bigint"), one("role").alias("role"), one("text").alias("text"))
    dealt = rows.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 32))
    return dealt.sortWithinPartitions("conv", "turn", "role", "text").withColumn("at", F.monotonically_increasing_id())


def segments(rows: DataFrame) -> DataFrame:
    """``conv, at, codes`` of runs of up to ``SEGMENT`` consecutive rows of the ordered rows."""
    initial = F.substring("role", 1, 1)
    seen = rows.groupBy("conv", "role", F.sha2("text", 256)).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    last = F.substring(F.rtrim("text", F.lit(WHITE)), -1, 1)
    codes = rows.select(
        "conv", "at", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"), last.alias("last")
    ).join(seen, "at", "left")
    fault = F.when(F.col("last") == "", "b").when(F.col("new").isNull(), "d").when(F.col("last").isin(*ENDS), "k").otherwise("t")
    run = codes.select("conv", "at", F.concat("initial", fault).alias("code")).groupBy("conv", F.floor(F.col("at") / SEGMENT).alias("run"))
    places = F.sort_array(F.collect_list(F.struct("at", "code")))
    return run.agg(places.alias("places")).select(
        "conv", F.get("places", F.lit(0))["at"].alias("at"), F.array_join(F.transform("places", lambda p: p["code"]), "").alias("codes")
    )


@lru_cache(maxsize=50_000)
def written(codes: str) -> str:
    """The cells of a segment as text, which travels and is remembered better than nested rows."""
    return " ".join(f"{p}{q}{cost},{audit}" for (p, q), (cost, audit) in parse(codes).items())


@lru_cache(maxsize=50_000)
def read(cells: str) -> Cells:
    split = (cell.split(",") for cell in cells.split(" "))
    return {(int(head[0]), int(head[1])): (int(head[2:]), audit) for head, audit in split}


_COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _illegal(initials: str) -> int:
    return sum(a + b not in LEGAL for a, b in pairwise(initials))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = batch.column(2).to_pylist()
        counts = [pa.array([x[1::2].count(f) for x in codes], pa.int64()) for f in "bdt"]
        counts.append(pa.array([_illegal(x[::2]) for x in codes], pa.int64()))
        ends = [pa.array([x[0] for x in codes]), pa.array([x[-2] for x in codes]), pa.array([len(x) // 2 for x in codes], pa.int32())]
        arrays = [batch.column(0), batch.column(1), *ends, *counts, pa.array(map(written, codes), pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, ["conv", "at", "first", "last", "n", *_COUNTS, "cells"])


def _pieces(audit: str, sizes: list[int]) -> Iterator[str]:
    """The audit cut at its segments; insertions go with the row behind them, the last ones with the last segment."""
    low = 0
    for size in sizes[:-1]:
        high = low
        while size:
            size -= audit[high] != "I"
            high += 1
        yield audit[low:high]
        low = high
    yield audit[low:]


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Per conversation the cheapest edits, one record for each segment, the first of them with the sums."""
    for batch in batches:
        for conv, parts in zip(batch.column(0).to_pylist(), batch.column(1)):
            parts = parts.as_py()
            cost, audit = cheapest(join_all([read(p["cells"]) for p in parts]))
            sums = {name: sum(p[name] for p in parts) for name in _COUNTS}
            sums["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in pairwise(parts))
            head = {"audit": audit, "cost": cost, **sums}
            for part, piece in zip(parts, _pieces(audit, [p["n"] for p in parts])):
                yield {"conv": conv, "at": part["at"], "piece": piece, **head}
                head = {}


_EDIT = pa.schema([("conv", pa.string()), ("at", pa.int64()), ("piece", pa.string()), ("audit", pa.string())] + [(c, pa.int64()) for c in ("cost", *_COUNTS)])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'bigint' if pa.types.is_int64(f.type) else 'string'}" for f in schema)


def _batched(records: Iterator[dict], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    held = []
    for record in records:
        held.append(record)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def edits(rows: DataFrame) -> DataFrame:
    """Cheapest edits of the conversations of the ordered rows, one record for each segment."""
    schema = f"conv string, at bigint, first string, last string, n int, {', '.join(f'{c} bigint' for c in _COUNTS)}, cells string"
    parts = segments(rows).mapInArrow(_parsed, schema)
    whole = parts.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("at", "first", "last", "n", *_COUNTS, "cells"))).alias("parts"))
    return whole.mapInArrow(lambda batches: _batched(_settled(batches), _EDIT), _ddl(_EDIT))


class _Conversation:
    """Walks one conversation in order: keeps, renames, drops and inserts rows."""

    def __init__(self, conv: str):
        self.conv, self.state, self.piece, self.head = conv, 0, "", None
        self.low = self.high = self.previous = None
        self.turns = 0

    def _move(self, initial: str) -> None:
        self.state = STEPS[self.state, initial]

    def _needed(self) -> str:
        return "a" if self.state == 2 else "u"

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        """The insertions that come next."""
        while self.piece.startswith("I"):
            role = self._needed()
            self._move(role)
            self.piece = self.piece[1:]
            yield "I", ROLES[role], ""

    def row(self, turn: int | None, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        if turn is not None and turn != self.previous:
            self.low = turn if self.low is None else self.low
            self.high, self.previous, self.turns = turn, turn, self.turns + 1
        yield from self.inserted()
        letter, self.piece = self.piece[0], self.piece[1:]
        if letter == "R":
            initial = self._needed()
            role = ROLES[initial]
            self._move(initial)
        elif letter == "K":
            self._move(role[0])
        yield letter, role, text

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def _walk(batches: Iterator[pa.RecordBatch], start: Callable, on_row: Callable, end: Callable) -> Iterator[dict]:
    """Feed the sorted records to one conversation after the other."""
    current, state = None, None
    for batch in batches:
        columns = [batch.column(name) for name in ("conv", "kind", "conv_id", "turn", "role", "text", "head")]
        for record in zip(*columns):
            conv, kind, conv_id, turn, role, text, head = (x.as_py() for x in record)
            if current is None or current.conv != conv:
                if current is not None:
                    yield from end(current, state)
                current = _Conversation(conv)
                state = start(conv_id)
            if kind == 1:
                yield from (x for e in current.inserted() for x in on_row(current, state, *e))
                current.piece += head["piece"]
                current.head = head if head["audit"] is not None else current.head
            elif kind == 2:
                yield from (x for e in current.row(turn, role, text) for x in on_row(current, state, *e))
    if current is not None:
        yield from end(current, state)


def _stream(rows: DataFrame, ids: DataFrame, settled: DataFrame) -> DataFrame:
    """Ids, edits and rows of every conversation together and in order."""
    head = F.struct("piece", "audit", "cost", *_COUNTS)
    none = lambda kind: F.lit(None).cast(kind)
    head_type = "struct<piece:string,audit:string,cost:bigint,blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint>"
    shape = lambda df, kind, **has: df.select(
        "conv", has.get("at", F.col("at")).cast("bigint").alias("at"), F.lit(kind).alias("kind"), has.get("conv_id", none("bigint")).alias("conv_id"),
        has.get("turn", none("bigint")).alias("turn"), has.get("role", none("string")).alias("role"), has.get("text", none("string")).alias("text"),
        has.get("head", none(head_type)).alias("head"),
    )
    named = shape(ids, 0, at=F.lit(-1), conv_id=F.col("conv_id"))
    told = shape(settled, 1, head=head)
    said = shape(rows, 2, turn=F.col("turn"), role=F.col("role"), text=F.col("text"))
    return named.unionByName(told).unionByName(said).repartition("conv").sortWithinPartitions("conv", "at", "kind")


def _ids(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").cast("bigint")).distinct().withColumn("conv", tagged(F.col("conv_id")))


_ROW = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def repair(rows: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, place, edit, role, text``, without the deleted rows."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put(current: _Conversation, state: dict, edit: str, role: str, text: str) -> Iterator[dict]:
            if edit != "D":
                state["place"] += 1
                yield {"conv_id": state["conv_id"], "place": state["place"], "edit": edit, "role": role, "text": text}

        def end(current: _Conversation, state: dict) -> Iterator[dict]:
            yield from (x for e in current.inserted() for x in put(current, state, *e))

        return _batched(_walk(batches, lambda conv_id: {"conv_id": conv_id, "place": 0}, put, end), _ROW)

    staged = stage(ordered(rows), "turns")
    return _stream(staged, _ids(rows), edits(staged)).mapInArrow(write, _ddl(_ROW))


_DIGEST = pa.schema(
    [("conv_id", pa.int64())]
    + [(c, pa.int64()) for c in ("gaps", *_COUNTS, "cost")]
    + [("audit", pa.string()), ("repaired_sha256", pa.string())]
)


def digest(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """Faults, cheapest edits and hash of the repaired text of every conversation of ``conversations``, from its rows."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put(current: _Conversation, state: dict, edit: str, role: str, text: str) -> Iterator[dict]:
            if edit != "D":
                state["hash"].update(f"{state['between']}{role}:{text}".encode())
                state["between"] = "\n"
            yield from ()

        def end(current: _Conversation, state: dict) -> Iterator[dict]:
            for e in current.inserted():
                yield from put(current, state, *e)
            head = current.head or {"cost": 0, "audit": "", **dict.fromkeys(_COUNTS, 0)}
            named = {c: head[c] for c in (*_COUNTS, "cost", "audit")}
            yield {"conv_id": state["conv_id"], "gaps": current.gaps(), **named, "repaired_sha256": state["hash"].hexdigest()}

        start = lambda conv_id: {"conv_id": conv_id, "hash": hashlib.sha256(), "between": ""}
        return _batched(_walk(batches, start, put, end), _DIGEST)

    staged = stage(ordered(rows), "turns")
    settled = stage(edits(staged), "edits")
    return _stream(staged, _ids(conversations), settled).mapInArrow(write, _ddl(_DIGEST))
