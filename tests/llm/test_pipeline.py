"""The pipeline against brute force, stage by stage, and the registration of its operators."""

from __future__ import annotations

import random
from collections import Counter

import pyarrow.parquet as pq

import __spark_entry__ as contract
import corpus_pipeline
from footfall.llm import quality_rules
from tests.llm import brute
from tests.llm.conftest import SCHEMA


def _expected(rows, items):
    """doc_id and text of what reaches the mix."""
    rows = {d: t for d, t in rows if not brute.quality(t)["base_failed"]}
    rows = {d: rows[d] for d, (_, root) in brute.near_groups(list(rows.items())).items() if d == root}
    return {d: rows[d] for d, found in brute.contamination(list(rows.items()), items).items() if not found[1]}


def test_run_on_the_whole_table(spark, small, small_rows):
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{small}/benchmark.parquet").to_pylist()]
    want = _expected([(r["doc_id"], r["text"]) for r in small_rows], items)
    source = {r["doc_id"]: r["source"] for r in small_rows}
    mixed = contract.queries()["pipeline"](spark, small).collect()
    assert {r.doc_id for r in mixed} <= set(want)
    sizes, taken = Counter(), Counter()
    for doc, text in want.items():
        sizes[source[doc]] += len(brute.WORD.findall(text))
    for r in mixed:
        taken[r.source] += r.words
        assert r.source == source[r.doc_id]
        if not any(brute.base_secrets(want[r.doc_id])[f"n_{k}"] for k in ("assign", "access", "hex")):
            assert " ".join(brute.WORD.findall(want[r.doc_id])[r["from"] : r["from"] + r.words]) == r.text
        found = brute.base_secrets(r.text)
        assert found["n_access"] == found["n_hex"] == 0
    for s, target in brute.targets(sizes).items():
        assert abs(taken[s] - target) < 0.03 * target + 64


def test_stages_keep_the_columns(spark, odd, small):
    docs = odd
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = function(spark, docs, small)
        assert docs.columns == odd.columns, name
    kept = {r.doc_id for r in docs.collect()}
    assert 7 not in kept and 3 not in kept and 9 not in kept  # repeats itself, or too short
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() >= 0
    empty = spark.createDataFrame([], SCHEMA)
    for name, function in corpus_pipeline.STAGES:
        assert function(spark, empty, small).count() == 0


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "secret_scan", "mixing"]
    names = [n for n in contract.queries() if n.startswith("op")]
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 14)} and "pipeline" in contract.queries()
