"""Contamination against a search for every window in every document."""

from __future__ import annotations

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from footfall.llm import decontaminate
from tests.llm import brute

ITEMS = "item_id long, text string"


def _got(frame):
    return {(r.doc_id): (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in frame.collect()}


@pytest.mark.parametrize("limit", [200_000, 0])
def test_whole_table(spark, small, small_rows, limit):
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    got = _got(decontaminate.digest(docs, items, broadcast_rows=limit))
    rows = [(r["item_id"], r["text"]) for r in pq.read_table(f"{small}/benchmark.parquet").to_pylist()]
    want = brute.contamination([(r["doc_id"], r["text"]) for r in small_rows], rows)
    assert got == want and any(w[1] for w in want.values())


def test_small_cases(spark):
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = [(1, long), (2, "Short ITEM"), (3, "the"), (4, None), (5, "..."), (6, long), (None, "nameless item here"), (10, "rare zzz"), (7, "a a a a a a a a a a")]
    docs = [
        (1, f"x {long.upper()} y, short--item"), (2, "THE end of the text"), (3, "alpha beta gamma delta epsilon zeta eta theta iota KAPPA"),
        (4, "alpha beta gamma delta epsilon zeta eta theta iota x kappa"), (5, None), (6, ""), (7, "nameless item here"), (8, "a " * 25),
        (9, "short É item shorté item"), (9, "short item"), (None, "short item"),
    ]
    got = decontaminate.digest(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)).collect()
    named = [i for i in items if i[0] is not None]
    want = []
    for doc, text in docs:
        n_words, _, n_items, sha = brute.contamination([(doc, text)], named)[doc]
        want.append((doc, n_words, brute.contamination([(doc, text)], items)[doc][1], n_items, sha))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256)) for r in got)
    assert {r.doc_id: r.n_near for r in got}[4] > 0  # one word too many, so near but no hit
    assert {r.doc_id: r.contaminated for r in got}[4] is False


def test_odd_rows(spark, odd, odd_rows, none):
    items = spark.createDataFrame([(1, "same words here"), (2, "password hunter22")], ITEMS)
    rows = decontaminate.digest(odd.withColumns({c: F.lit(1) for c in ("w", "words", "items", "term", "base")}), items).collect()
    assert len(rows) == len(odd_rows) and sum(r.contaminated for r in rows) == 3
    assert decontaminate.digest(none, items).collect() == []
    clean = decontaminate.digest(odd, spark.createDataFrame([], ITEMS)).collect()
    assert len(clean) == len(odd_rows) and not any(r.contaminated for r in clean)
    kept = decontaminate.remove_leaks(odd, items)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows) - 3
