"""Near-duplicate groups against the comparison of all documents that share a shingle."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from footfall.llm import near_dedup
from footfall.llm.components import components
from tests.llm import brute


def _got(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}


def test_whole_table(spark, small, small_rows):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = brute.near_groups([(r["doc_id"], r["text"]) for r in small_rows])
    assert _got(near_dedup.near_groups(docs)) == want
    kept = [r.doc_id for r in near_dedup.keep_first(docs).collect()]
    assert sorted(kept) == sorted({root for _, root in want.values()})


def test_chains_crowds_and_copies(spark):
    """Near copies of near copies, many documents around one passage, and thousands of exact copies."""
    dice = random.Random(3)
    word = lambda: "".join(dice.choice("abcdefgh") for _ in range(7))
    base, passage, rows = [word() for _ in range(120)], [word() for _ in range(60)], []
    for _ in range(30):  # each differs a little from the one before, the ends differ entirely
        rows.append(" ".join(base))
        base[dice.randrange(len(base))] = word()
        base[dice.randrange(len(base))] = word()
    rows += [" ".join(passage + [word() for _ in range(dice.choice([8, 12, 16, 60]))]) for _ in range(80)]
    rows += ["the same text in very many rows of the table"] * 500
    rows += ["Short", "short", "four words in all", "Four  words\tin all", "four words in"]
    docs = list(enumerate(rows))
    dice.shuffle(docs)
    got = _got(near_dedup.near_groups(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == brute.near_groups(docs)


def test_close_pairs_in_a_crowd(spark, monkeypatch):
    """Few close pairs among many documents of one template that are all too different, whatever the hubs."""
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 8)
    dice = random.Random(5)
    word = lambda: "".join(dice.choice("abcdefgh") for _ in range(7))
    template, rows = [word() for _ in range(96)], []
    for _ in range(700):
        rows.append(template + [word() for _ in range(32)])
    for k in range(8):
        rows.append(rows[200 + 50 * k][:-13] + [word() for _ in range(13)])
    docs = [(i, " ".join(words)) for i, words in enumerate(rows)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: 200 + 50 * (i - 700) if i >= 700 else i for i in range(708)}


def test_bucket_keys_are_not_broadcast(spark):
    """Each node has 91 keys, which Spark's estimate does not count."""
    hashes = [(i, 5, [i % 3 + k for k in range(near_dedup.COLLECTIONS)]) for i in range(30)]
    nodes = near_dedup.stage(spark.createDataFrame(hashes, "id long, n long, hashes array<long>"), "nodes")
    held = near_dedup._buckets(nodes)
    assert "Broadcast" not in held._jdf.queryExecution().executedPlan().toString()
    assert held.count() == 30 * 91 and held.columns == ["key", "id", "n"]
    assert "Broadcast" not in held._jdf.queryExecution().executedPlan().toString()


def test_odd_rows(spark, odd, odd_rows, none):
    clashing = odd.withColumns({c: F.lit(1) for c in ("digest", "hashes", "id", "key", "n", "root", "hub")})
    got = near_dedup.near_groups(clashing).collect()
    assert len(got) == len(odd_rows)
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    want = brute.near_groups([(r[0], r[1]) for r in odd_rows if r[0] is not None])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert near_dedup.near_groups(none).collect() == [] and near_dedup.keep_first(odd).columns == odd.columns


def test_rows_of_one_id_are_one_document(spark):
    rows = [(5, "a b c d e f g h"), (9, "a b c d e f g h"), (9, "p q r s t u v w"), (7, "p q r s t u v w")]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {5}


def test_components(spark):
    dice = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(dice.randrange(500, 600), dice.randrange(500, 600)) for _ in range(60)]
    root = {x: x for pair in links for x in pair}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if x != r}


def test_strangers_meet_a_large_component_once(spark):
    """5,000 near copies and two strangers behind one shingle: a pair for each copy and stranger, none between copies."""
    rows = [(7, i, 0, 100, 0) for i in range(5000)] + [(7, 9000, 9000, 100, 0), (7, 9001, 9001, 100, 0)]
    rows += [(8, i, 0, 100, 1) for i in range(5000)]  # a shingle of one component links nothing
    front = spark.createDataFrame(rows, "s long, id long, root long, n int, at int")
    pairs = near_dedup._met(front, 75)
    assert pairs.count() == 2 * 5000 + 1
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
    assert pairs.filter("hub >= id").isEmpty()


def test_columns_of_any_name_are_kept(spark):
    from footfall.llm import decontaminate, quality_rules, secret_scan

    text = "eleven different words make a document that passes all of them"
    names = ["__gone", "host_rate", "__doc", "__words", "__spans", "kept", "digest", "carried_1", "Root", "key"]
    docs = spark.createDataFrame([(1, text, "s"), (2, text, "s")], "doc_id long, text string, source string")
    docs = docs.select(*[F.lit(n).alias(n) for n in names], "*")
    items = spark.createDataFrame([(1, "nothing of the kind stands in these two documents at all")], "item_id long, text string")
    for kept in (near_dedup.keep_first(docs), quality_rules.keep_good(docs), decontaminate.remove_leaks(docs, items), secret_scan.mask(docs)):
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert rows and all(r[n] == n for r in rows for n in names)
