"""Targets against the wording of the contract, packing and permutations against brute force."""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from footfall.llm import mixing
from tests.llm import brute


def _usage(docs):
    return sorted(((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in mixing.usage(docs).collect()), key=str)


def test_usage(spark, small, small_rows):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = _usage(docs)
    size = {r["doc_id"]: len(brute.WORD.findall(r["text"] or "")) for r in small_rows}
    source = {r["doc_id"]: r["source"] for r in small_rows}
    by_source = Counter()
    for doc, n in size.items():
        by_source[source[doc]] += n
    want = brute.targets(by_source)
    assert len(rows) == len(small_rows)
    taken = Counter()
    for doc, n, source_size, target, used in rows:
        assert n == size[doc] and source_size == by_source[source[doc]]
        assert abs(target - want[source[doc]]) < 1e-6 * target and used <= 3 * n
        taken[source[doc]] += used
    for s, target in want.items():
        assert abs(taken[s] - target) <= 0.01 * target + mixing.BLOCK_WORDS
    assert rows == _usage(docs.repartition(5))


def test_targets_with_caps(spark):
    sizes = {"a": 1000, "b": 5, "c": 700, "d": 1, None: 40, "e": 30, "f": 0}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(frame).collect()}
    want = brute.targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 64, 1000):
        got = [r[0] for r in spark.range(n).select(mixing._permuted(F.col("id"), F.lit(n).cast("long"), F.lit("k"))).collect()]
        assert sorted(got) == list(range(n))
    assert got != list(range(n))


def test_mix_agrees_with_usage(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    used = Counter()
    for r in mixing.mix(docs).collect():
        assert len(brute.WORD.findall(r.text)) == r.words
        used[r.doc_id] += r.words
    assert {d: t for d, _, _, _, t in _usage(docs) if t} == dict(used)


def test_mix_shuffles_texts_once(spark, small):
    for name, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(name, value)
    try:
        mixed = mixing.mix(spark.read.parquet(f"{small}/documents.parquet"))
        plan = mixed._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(name)
    # The join that the texts meet last takes them as the first shuffle left them.
    above = plan[: plan.index("Exchange")]
    assert "array_join" in above and "split" in above and "FileScan" not in above


def test_mix_of_repeated_rows(spark):
    rows = [(None, None, "x y " * 40), (None, None, "x y " * 40), (1, "a", "b c " * 40), (1, "a", "d e " * 40), (1, "a", "b c " * 40), (2, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    used, parts = Counter(), defaultdict(set)
    for r in mixing.mix(docs).collect():
        assert len(r.text.split()) == r.words
        used[r.doc_id] += r.words
        parts[r.doc_id].update(r.text.split())
    assert parts == {None: {"x", "y"}, 1: {"b", "c", "d", "e"}}
    taken = Counter()
    for doc, _, _, _, n in _usage(docs):
        taken[doc] += n
    assert dict(used) == {d: n for d, n in taken.items() if n}


def test_shards_draw_sources_in_proportion(spark):
    sources = spark.createDataFrame([("a", 10**6, 3e5), ("b", 10**6, 7e5)], "source string, source_size long, target double")
    counts = defaultdict(Counter)
    for r in mixing.plan_slots(sources, shard_slots=500).collect():
        counts[r.shard][r.source] += 1
    assert len(counts) > 20 and len({c["a"] for c in counts.values()}) > 5
    full = [c["a"] / sum(c.values()) for c in counts.values() if sum(c.values()) > 400]
    assert abs(sum(full) / len(full) - 0.3) < 0.02


def test_odd_rows(spark, odd, odd_rows, none):
    rows = _usage(odd.withColumns({c: F.lit(1) for c in ("size", "start", "runs", "block", "target")}))
    want = [(r[0], len(brute.WORD.findall(r[1] or ""))) for r in odd_rows]
    assert sorted(map(str, [(r[0], r[1]) for r in rows])) == sorted(map(str, want))
    assert all(r[4] <= 3 * r[1] for r in rows)
    assert _usage(none) == [] and mixing.mix(none).collect() == []
