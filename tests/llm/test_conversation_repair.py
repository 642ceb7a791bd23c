"""Conversation repair against a search over all edits, and against plain Python on odd rows."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import zlib
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from footfall.llm import conversation_repair as cr

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, at int, conv int"


def _search(codes):
    """Dijkstra over (row, state): (cost, audit) grows with every edit, so the first end reached is the least."""
    queue, seen = [(0, "", 0, 0)], set()
    while queue:
        cost, audit, row, state = heapq.heappop(queue)
        if row == len(codes) and state in cr.FINAL:
            return cost, audit
        if (row, state) in seen:
            continue
        seen.add((row, state))
        go = lambda c, letter, r, s: heapq.heappush(queue, (cost + c, audit + letter, r, s))
        for role in "ua":
            if (state, role) in cr.STEPS:
                go(2, "I", row, cr.STEPS[state, role])
        if row < len(codes):
            initial, fault = codes[row]
            go(3, "D", row + 1, state)
            if fault in "kt":
                cut = fault == "t"
                if (state, initial) in cr.STEPS:
                    go(cut, "K", row + 1, cr.STEPS[state, initial])
                for role in "ua":
                    if (state, role) in cr.STEPS:
                        go(2 + cut, "R", row + 1, cr.STEPS[state, role])


def test_every_short_conversation():
    codes = [i + f for i in "suax" for f in "kbt"]
    for n in (1, 2, 3):
        for rows in itertools.product(codes, repeat=n):
            assert cr.cheapest(cr.parse("".join(rows))) == _search(rows), rows


def test_segments_join_as_the_whole_chart():
    rng = random.Random(3)
    for n in (7, 16, 33, 100):
        rows = [rng.choice("suuaax") + rng.choice("kkkbdt") for _ in range(n)]
        parts = [cr.parse("".join(rows[k : k + 5])) for k in range(0, n, 5)]
        assert cr.cheapest(cr.join_all(parts)) == _search(rows)
    whole = [rng.choice("sua") + rng.choice("kt") for _ in range(20)]
    assert cr.parse("".join(whole)) == cr.join_all([cr.parse("".join(whole[k : k + 3])) for k in range(0, 20, 3)])


def _damaged(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def _digest(damaged, ids):
    by = defaultdict(list)
    for row in damaged:
        by[row[0]].append(row)
    out = []
    for conv in ids:
        rows = sorted(by[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, codes, faults = set(), [], {"b": 0, "d": 0, "t": 0, "k": 0}
        for _, _, role, text in rows:
            bare = text.rstrip(WHITE)
            fault = "b" if not bare else "d" if (role, text) in seen else "k" if bare[-1] in ".!?" else "t"
            seen.add((role, text))
            faults[fault] += 1
            codes.append((role[:1] if role[:1] in ("s", "u", "a") else "x") + fault)
        cost, audit = _search(codes)
        turns = [r[1] for r in rows if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(codes))
        said, left, state = [], list(rows), 0
        for letter in audit:
            role, text = (None, "") if letter == "I" else left.pop(0)[2:]
            if letter == "D":
                continue
            if letter != "K":
                role = "assistant" if state == 2 else "user"
            state = cr.STEPS[state, role[0]]
            said.append(f"{role}:{text}")
        sha = hashlib.sha256("\n".join(said).encode()).hexdigest()
        out.append((conv, gaps, faults["b"], faults["d"], faults["t"], illegal, cost, audit, sha))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _check(spark, rows, damaged=None):
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    hurt = cr.damage(frame) if damaged is None else frame
    got = cr.digest(hurt, frame).select(*COLUMNS).collect()
    want = _digest(list(_damaged(rows)) if damaged is None else damaged, {r[0] for r in rows})
    assert sorted(map(tuple, got), key=str) == want


def test_odd_rows(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Hi!"), (1, 2, "assistant", "Hi!"),
        (2, None, None, None), (2, None, "user", "no end"), (2, 5, "tool", "x.\n "), (2, 9, "", "empty role."),
        (None, 0, "user", "lost."), (None, None, "assistant", " \t\n"), (None, 3, "Assistant", "Ünïcode 😀."),
        (3, 7, "assistant", "only one."), (4, 1, "user", "a" * 50_000 + "."), (4, 2, "assistant", "b. " * 5_000),
        (5, 4, "user", "same turn."), (5, 4, "assistant", "same turn."), (5, 4, "user", "Same turn."), (-6, -3, "user", ""),
    ]
    _check(spark, rows)
    _check(spark, rows + rows[:6])
    whole = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    _check(spark, whole, whole)


def test_all_rows_dropped(spark):
    turns = [t for t in range(200) if zlib.crc32(f"7:{t}".encode()) % 20 == 0]
    _check(spark, [(7, t, "user", "gone.") for t in turns])


def test_small_table(spark, small):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in pq.read_table(f"{small}/conversations.parquet").to_pylist()]
    _check(spark, rows)


@pytest.mark.parametrize("turns", [lambda k: k, lambda k: None, lambda k: k // 500])
def test_long_conversation_fills_many_partitions(spark, turns):
    rng = random.Random(5)
    rows = [(4, turns(k), rng.choice(["user", "assistant"]), f"row {rng.randrange(2500)}{rng.choice(['.', ''])}") for k in range(3000)]
    assert len(list(_damaged(rows))) > 2000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _check(spark, rows + [(2, 0, "user", "short.")])
        dealt = cr.ordered(cr.damage(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)))
        per = dealt.groupBy(F.shiftright("at", 33)).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(per) >= 4 and max(r["count"] for r in per) < 1500


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hello?"), (1, 1, "user", "There?"), (1, 2, "assistant", "Yes."), (2, 0, "tool", "")]
    got = cr.repair(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).orderBy("conv_id", "place").collect()
    assert [tuple(r) for r in got] == [
        (1, 1, "K", "user", "Hello?"), (1, 2, "I", "assistant", ""), (1, 3, "K", "user", "There?"), (1, 4, "K", "assistant", "Yes."),
    ]


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cr.digest(cr.damage(empty), empty).collect() == []
    assert cr.repair(empty).collect() == []
