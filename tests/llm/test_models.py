"""Language identification and the quality classifier: exact parts by brute force, the rest held out."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from footfall.llm import language_id, quality_model
from footfall.llm.queries import QUERIES

PIECES = ["▁", "▁a", "a", "ab", "b", "▁ab", "c", "bc", "abc"]


def _all_cuts(word, p):
    """Sum over all segmentations, by trying every set of cuts."""
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        product = 1.0
        for i, j in zip(at, at[1:]):
            piece = word[i:j]
            product *= p[PIECES.index(piece)] if piece in PIECES else (language_id.UNKNOWN if j == i + 1 else 0.0)
        total += product
    return total


def test_forward_sums_all_segmentations(monkeypatch):
    table, dice = language_id.Pieces.of(PIECES), np.random.default_rng(1)
    p = np.vstack([dice.random((len(PIECES), 2)), [language_id.UNKNOWN] * 2])
    words = ["a", "abc", "aabcb", "xab", "abcabcab", "é"]
    for short in (40, 3):  # all at once, and one by one
        monkeypatch.setattr(language_id, "SHORT", short)
        got = language_id.word_scores(words, table, p)
        for w in words:
            for k in range(2):
                assert math.isclose(got[w][k], math.log(_all_cuts("▁" + w, p[:, k])), rel_tol=1e-9)
    long = language_id.word_scores(["abc" * 2000], table, p)["abc" * 2000]
    assert np.isfinite(long).all()


def test_expected_counts():
    table, dice = language_id.Pieces.of(PIECES), np.random.default_rng(2)
    p = np.append(dice.random(len(PIECES)), language_id.UNKNOWN)
    word, step = "abcab", 1e-6
    got = language_id.expected_counts([word], np.array([3.0]), table, p)
    for k in range(len(PIECES)):  # an expected count is the derivative of log P by log p
        up, down = p.copy(), p.copy()
        up[k] *= 1 + step
        down[k] *= 1 - step
        slope = (math.log(_all_cuts("▁" + word, up)) - math.log(_all_cuts("▁" + word, down))) / (2 * step)
        assert math.isclose(got[k], 3 * slope, abs_tol=1e-5)


def test_languages_held_out(spark, small, small_rows):
    lang = {r["doc_id"]: r["lang"] for r in small_rows}
    rows = QUERIES["op1_language_id"](spark, small).collect()
    assert {r.doc_id for r in rows} == set(lang) and len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert 100 < len(held) < 300 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97


def test_language_of_odd_rows(spark, odd, odd_rows, none):
    model = language_id.fit(odd.withColumns({c: F.lit(1) for c in ("word", "n", "piece")}), language_id.read_pieces())
    got = language_id.predict(odd, model).collect()
    assert len(got) == len(odd_rows) and {r.lang_pred for r in got} == {"en", "und"}
    assert {r.lang_pred for r in got if r.doc_id in (0, 1, 2)} == {"und"}
    assert language_id.fit(none, PIECES) is None and language_id.predict(none, model).collect() == []
    assert {r.lang_pred for r in language_id.predict(odd, None).collect()} == {"und"}


def test_word_vectors_count_neighbours(spark):
    docs = spark.createDataFrame([("b a c",), ("a d",), (None,)], "text string").repartition(3)
    buckets, (places, signs) = quality_model._Buckets(), quality_model.index_vectors()
    want = np.zeros(quality_model.DIM)
    for near in "bcd":
        for k in range(quality_model.NONZERO):
            want[places[buckets[near], k]] += signs[buckets[near], k]
    got = quality_model.word_vectors(docs)[buckets["a"]]
    assert np.allclose(got / np.linalg.norm(got), want / np.linalg.norm(want), atol=1e-6)


def test_gradient():
    dice = np.random.default_rng(3)
    x, y = dice.normal(size=(20, quality_model.FEATURES)), dice.integers(0, 2, 20).astype(float)
    shapes = [(quality_model.FEATURES, 4), (4,), (4,), ()]
    net = quality_model.Network(np.zeros(quality_model.FEATURES), np.ones(quality_model.FEATURES), [np.asarray(dice.normal(size=s)) for s in shapes])

    def loss():
        z = net.logits(x)
        decay = quality_model.DECAY / 2 * sum((net.weights[k] ** 2).sum() for k in (0, 2))
        return np.mean(np.logaddexp(0, -np.where(y > 0, z, -z))) + decay

    for k, g in enumerate(quality_model._gradient(net, x, y)):
        at = tuple(0 for _ in net.weights[k].shape)
        kept = net.weights[k]
        sides = []
        for step in (1e-6, -1e-6):
            net.weights[k] = kept.copy()
            net.weights[k][at] += step
            sides.append(loss())
        net.weights[k] = kept
        assert math.isclose((sides[0] - sides[1]) / 2e-6, np.asarray(g)[at], abs_tol=1e-6)


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in QUERIES["op10_quality_model"](spark, folder).collect()}
    labels = pq.read_table(f"{folder}/labels.parquet").to_pylist()
    held = [(rows[r["doc_id"]].score, r["quality"]) for r in labels if r["doc_id"] in rows and rows[r["doc_id"]].held_out]
    ones, zeros = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])
    assert len(zeros) > 50 and auc > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows.values())


def test_quality_of_odd_rows(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, 1), (6, 0), (None, 1), (7, None), (999, 1)], "doc_id long, quality int")
    got = quality_model.score(odd.withColumns({c: F.lit(1) for c in ("vector", "quality", "slab")}), labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    flat = quality_model.score(odd, labels.filter("quality = 1")).collect()
    assert {r.score for r in flat} == {1.0}
    assert quality_model.score(none, labels).collect() == []
    assert {r.score for r in quality_model.score(odd, labels.limit(0)).collect()} == {0.5}
