"""Token counts against the tokenizer itself."""

from __future__ import annotations

import base64

import tiktoken
from pyspark.sql import functions as F

from footfall.llm import token_scan


def _encoding():
    with open(token_scan.RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("t", pat_str=token_scan.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _want(rows):
    encoding = _encoding()
    return sorted(str((doc, len(encoding.encode_ordinary(text or "")))) for doc, text in rows)


def _got(frame):
    return sorted(str((r.doc_id, r.n_tokens)) for r in frame.collect())


def test_pattern():
    import public_tokenizers

    assert token_scan.PATTERN == public_tokenizers.PATTERN


def test_whole_table(spark, small, small_rows):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert _got(token_scan.count_tokens(docs)) == _want([(r["doc_id"], r["text"]) for r in small_rows])


def test_documents_across_blocks(spark, odd, odd_rows, none, monkeypatch):
    monkeypatch.setattr(token_scan, "RUN_BLOCKS", 3)
    rows = [(r[0], r[1]) for r in odd_rows]
    for block in (1, 7, 64):
        clashing = odd.withColumns({c: F.lit(1) for c in ("file", "block", "data", "n", "base")})
        assert _got(token_scan.count_tokens(clashing, block_tokens=block)) == _want(rows)
    assert token_scan.count_tokens(none).collect() == []
    text = [(1, "a <|endoftext|> b")]
    assert _got(token_scan.count_tokens(spark.createDataFrame(text, "doc_id long, text string"))) == _want(text)


def test_unclosed_rest(spark):
    data = [(0, 0, bytearray(b"\x01\x00\x02\x00"), None), (0, 1, bytearray(b"\x03\x00\x50\xc4"), None), (0, 2, bytearray(b"\x05\x00"), None)]
    got = token_scan.document_lengths(token_scan.scan_blocks(spark.createDataFrame(data, token_scan.BLOCKS)))
    assert sorted((r.number, r.tokens) for r in got.collect()) == [(0, 3), (1, 1)]
