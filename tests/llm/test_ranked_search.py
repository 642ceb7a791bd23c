"""Ranked search against plain Python, over a whole table, odd rows, and small tiles and blocks."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from footfall.llm import ranked_search
from tests.llm.brute import LOWER

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def _brute(docs, items, top=50):
    bags = [(doc_id, Counter(_terms(text))) for doc_id, text in docs]
    n_docs, n_terms = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item].update(_terms(text))
    out = []
    for item, own in wanted.items():
        scored = []
        for doc_id, bag in bags:
            n = sum(bag.values())
            score = 0
            for t in own & bag.keys():
                m = 100 - 50 + (50 * n * n_docs) // n_terms
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 20 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def _got(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()), key=str)


ITEMS = [(1, "one words here"), (2, "STRASSE Straße straße"), (2, "wide unit"), (None, "null source"), (5, None), (6, " .,;"), (7, "absent"), (8, "x 𝔘𝔫𝔦 x")]


@pytest.mark.parametrize("tiles", [None, (1, 2, 1)])
def test_odd_rows(spark, odd_rows, monkeypatch, tiles):
    if tiles:
        monkeypatch.setattr(ranked_search, "ITEM_TILE", tiles[0])
        monkeypatch.setattr(ranked_search, "DOC_TILE", tiles[1])
        monkeypatch.setattr(ranked_search, "VOCABULARY_TILE", tiles[2])
    docs = [(r[0], r[1]) for r in odd_rows]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, score int")
    items = spark.createDataFrame([(i, t, 2) for i, t in ITEMS], "item_id bigint, text string, rank int")
    assert _got(ranked_search.search(frame, items)) == _brute(docs, ITEMS)
    assert _got(ranked_search.search(frame, items, top=1)) == _brute(docs, ITEMS, 1)


def test_ties_and_copies(spark):
    docs = [(k % 70, "same text for all") for k in range(300)] + [(None, "same text for all")] * 3 + [(500, "other words")] * 200
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = [(0, "same text"), (1, "other")]
    assert _got(ranked_search.search(frame, spark.createDataFrame(items, "item_id bigint, text string"))) == _brute(docs, items)


@pytest.mark.parametrize("block", [ranked_search.BLOCK_PAIRS, 300])
def test_small_table(spark, small, small_rows, block):
    docs = [(r["doc_id"], r["text"]) for r in small_rows]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{small}/benchmark.parquet").to_pylist()]
    read = lambda name: spark.read.parquet(f"{small}/{name}.parquet")
    assert _got(ranked_search.search(read("documents"), read("benchmark"), block_pairs=block)) == _brute(docs, items)


def test_sums_stay_exact(monkeypatch):
    """Near 2^53 a float sum would round: narrow tiles keep every score exact."""
    import numpy as np

    n = 5000
    tile = ranked_search._Tile(0, [np.arange(n), np.arange(0, n, 2)])
    weight = np.full(n, 2_000_001, np.int64)
    impacts = np.full(n, 999_999, np.int64)
    width = (ranked_search.EXACT - 1) // (2_000_001 * 1_000_000)
    scores = tile.scores(np.arange(n), np.zeros(n, np.int64), impacts, 1, weight, width)
    assert scores.ravel().tolist() == [n * 2_000_001 * 999_999, n // 2 * 2_000_001 * 999_999]
    assert scores[0, 0] > ranked_search.EXACT


def test_no_rows(spark, none, odd):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert ranked_search.search(none, items).collect() == []
    assert ranked_search.search(odd, items.limit(0)).collect() == []
