"""Mining of small hand-made baskets and sequences."""

from __future__ import annotations

from footfall.operators import patterns, trajectories


def test_itemsets_and_rules(spark):
    frame = spark.createDataFrame([(list(t),) for t in ("ab", "abc", "a", "bc")], "items array<string>")
    found = {"".join(r["items"]): r.freq for r in patterns.frequent_itemsets(frame, 0.5).collect()}
    assert found == {"a": 3, "b": 3, "c": 2, "ab": 2, "bc": 2}
    rules = {("".join(r.antecedent), r.consequent[0]): r.confidence for r in patterns.association_rules(frame, 0.5, 0.9).collect()}
    assert rules == {("c", "b"): 1.0}


def test_sequences_and_rules(spark):
    frame = spark.createDataFrame([([[x] for x in t],) for t in ("ab", "ba", "abc")], "sequence array<array<string>>")
    found = {"".join(r["items"]): r.freq for r in patterns.frequent_sequences(frame, 0.3).collect()}
    assert found == {"a": 3, "b": 3, "c": 1, "ab": 2, "ba": 1, "ac": 1, "bc": 1, "abc": 1}
    mined = patterns.frequent_sequences(frame, 0.3)
    rules = {("".join(r.antecedent), r.consequent[0]): r.confidence for r in patterns.sequence_rules(mined, 0.6).collect()}
    assert rules[("a", "b")] == 2 / 3 and rules[("c", "b")] == 1.0 and rules[("bc", "a")] == 1.0


def test_sequence_order_is_first_visit(spark):
    rows = [("u", "2020-01-01", "b", 3), ("u", "2020-01-01", "a", 2), ("u", "2020-01-01", "b", 1), ("u", "2020-01-01", "c", 2)]
    frame = spark.createDataFrame(rows, "username string, day string, poi string, ts long")
    row = trajectories.user_day_sequences(frame).first()
    assert row.sequence == [["b"], ["a"], ["c"]]
    assert trajectories.user_day_places(frame).first().places == ["a", "b", "c"]


def test_codes_follow_name_order(spark):
    frame = spark.createDataFrame([(f"p{i:02}",) for i in range(40)], "poi string").repartition(6)
    assert [(r.poi, r.code) for r in trajectories.encode_places(frame).orderBy("poi").collect()] == [(f"p{i:02}", i) for i in range(40)]
