"""Line dedup against plain Python, over a whole table and over odd rows."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from footfall.llm import line_dedup
from tests.llm.brute import LOWER
from tests.llm.conftest import SCHEMA

WHITE = " \t\n\x0b\x0c\r"


def _split(text):
    return (text or "").split("\n")


def _key(line):
    return line.strip(WHITE).translate(LOWER)


def _shared(rows, min_docs, min_chars=1):
    held = defaultdict(set)
    for at, (_, text) in enumerate(rows):
        for line in _split(text):
            held[_key(line)].add(at)
    return {k for k, docs in held.items() if len(docs) >= min_docs and len(k) >= min_chars}


def _digest(rows, min_docs):
    shared = _shared(rows, min_docs)
    out = []
    for doc_id, text in rows:
        lines = _split(text)
        kept = [x for x in lines if _key(x) not in shared]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


ODD = [
    (1, "Header\nown words\nfooter "),
    (2, "HEADER\r\nother words\n\tfooter"),
    (3, "header\n\n\nfooter\nheader"),
    (3, "header\n\n\nfooter\nheader"),
    (None, "header\nno id"),
    (None, "header\nno id"),
    (None, None),
    (7, None),
    (8, ""),
    (9, "\n"),
    (10, "ÀÉ header\nİ\nÀé header"),
    (11, "\n".join(f"line {k % 40}" if k % 3 else "header" for k in range(5000))),
    (12, " header \nend\n"),
]


@pytest.mark.parametrize("min_docs", [1, 2, 3, 6])
def test_odd_rows(spark, min_docs):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in ODD], "doc_id bigint, text string, runs int, __runs int")
    got = [tuple(r) for r in line_dedup.digest(docs, min_docs=min_docs).collect()]
    assert sorted(got, key=str) == _digest(ODD, min_docs)


def test_small_table(spark, small, small_rows):
    rows = [(r["doc_id"], r["text"]) for r in small_rows]
    got = line_dedup.digest(spark.read.parquet(f"{small}/documents.parquet")).collect()
    assert sorted(map(tuple, got), key=str) == _digest(rows, 10)


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_RUNS", 0)
    docs = spark.createDataFrame(ODD, "doc_id bigint, text string")
    assert sorted(map(tuple, line_dedup.digest(docs, min_docs=3).collect()), key=str) == _digest(ODD, 3)


def test_texts_keep_their_columns_and_first_lines(spark):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in ODD if i not in (3, None)], "doc_id bigint, text string, lines string, __lines string")
    dropped = {r.doc_id: r for r in line_dedup.drop_lines(docs, min_docs=2).collect()}
    assert dropped[1].text == "own words" and dropped[12].text == "end\n" and dropped[7].text is None
    assert dropped[1].lines == "x" and dropped[1]["__lines"] == "y"
    first = {r.doc_id: r.text for r in line_dedup.drop_lines(docs, min_docs=2, keep_first=True).collect()}
    assert first[1] == "Header\nown words\nfooter " and first[2] == "other words" and first[12] == "end\n"


def test_runs_are_compressed(spark):
    docs = spark.createDataFrame([(k, "a\nb\nc\n" + f"own {k}\n" + "d\ne") for k in range(10)], "doc_id bigint, text string")
    runs = {tuple(map(tuple, r.runs)) for r in line_dedup.bitmaps(docs).collect()}
    assert runs == {((0, 3), (4, 2))}


def test_a_key_of_every_document_is_split(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("license\nown "), "id").alias("text"))
    lines = line_dedup.line_keys(docs)
    dealt = lines.repartitionByRange(8, *line_dedup._KEY, *line_dedup._DOC)
    hot = lines.groupBy(*line_dedup._KEY).count().orderBy(F.desc("count")).limit(1)
    parts = dealt.withColumn("part", F.spark_partition_id()).join(hot, line_dedup._KEY).groupBy("part").count().collect()
    assert len(parts) >= 4 and max(r["count"] for r in parts) < 1500
    assert {r.n_dropped for r in line_dedup.digest(docs).collect()} == {1}


def test_one_exchange_of_lines(spark, small):
    lines = line_dedup.line_keys(spark.read.parquet(f"{small}/documents.parquet"))
    plan = line_dedup.shared_keys(lines)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Python" not in plan and "Arrow" not in plan


def test_no_rows(spark, none):
    assert line_dedup.digest(none).collect() == []
    assert line_dedup.drop_lines(none).columns == [c.split()[0] for c in SCHEMA.split(", ")]
