"""Token counts per document from flat token files, by a separator scan.

A flat file is nothing but token ids, one document after the other, each closed by the
end-of-document id; it is kept in blocks of fixed length that pay no heed to documents
(one row ``file, block, data`` each, so that Spark can read it from any store). Every
block is searched for the separator in one vectorised pass. A prefix scan over the
numbers of separators tells each block the number of its first document, and the tokens
that a block hands on to the next separator are added up by that number, however many
blocks a document spans.

Defined results: null and empty texts are documents of no tokens; the separator's own
string inside a text is ordinary text; repeated rows are counted each for itself; an
unclosed rest at the end of a file is a document if it has tokens; columns other than
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.session import stage_path

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed values of that vocabulary: its free id, which closes a document, and its word pattern.
END = 50_256
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DTYPE = "<u2"
BLOCK_TOKENS = 65_536
# Blocks that one window sees; longer files are scanned in two levels.
RUN_BLOCKS = 1024
BLOCKS = "file bigint, block bigint, data binary, ended array<bigint>"


def write_blocks(docs: DataFrame, ranks_path: str = RANKS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Tokenise ``doc_id, text`` into flat files, one per task: ``file, block, data, ended``.

    ``ended`` lists the documents that close in a block, in order; the scan does not use it.
    """
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        file, block = TaskContext.get().partitionId(), 0
        rest, ended = np.empty(0, DTYPE), []  # tokens and document ends not yet written

        def cut(tokens: np.ndarray, ends: list[tuple[int, int | None]], last: bool) -> pa.RecordBatch:
            nonlocal rest, ended, block
            n = -(-len(tokens) // block_tokens) if last else len(tokens) // block_tokens
            data = [tokens[k * block_tokens : (k + 1) * block_tokens].tobytes() for k in range(n)]
            ids: list[list] = [[] for _ in range(n)]
            for at, doc in ends:
                if at // block_tokens < n:
                    ids[at // block_tokens].append(doc)
            ended = [(at - n * block_tokens, doc) for at, doc in ends if at // block_tokens >= n]
            rest, block = tokens[n * block_tokens :], block + n
            columns = [pa.array([file] * n, pa.int64()), pa.array(range(block - n, block), pa.int64()), pa.array(data, pa.binary()), pa.array(ids, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, ["file", "block", "data", "ended"])

        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part, at, tokens = batch.slice(start, 200), len(rest), [rest]
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    text = (text or "").encode("utf-8", "replace").decode("utf-8")
                    tokens.append(np.array([*encoding.encode_ordinary(text), END], DTYPE))
                    at += len(tokens[-1])
                    ended.append((at - 1, doc))
                yield cut(np.concatenate(tokens), ended, False)
        yield cut(rest, ended, True)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(tokenise, BLOCKS)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lengths of the pieces between separators in each block, the first and last open ones included."""
    for batch in batches:
        pieces = []
        for data in batch.column(2):
            tokens = np.frombuffer(data.as_py(), DTYPE)
            at = np.flatnonzero(tokens == END)
            pieces.append(np.diff(np.concatenate([[-1], at, [len(tokens)]])) - 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pieces, pa.list_(pa.int64()))], ["file", "block", "pieces"])


def scan_blocks(blocks: DataFrame) -> DataFrame:
    """``file, block, pieces, base`` of each block; ``base`` numbers its first document.

    The numbers are an exclusive prefix sum of separators in two levels: over runs of
    blocks, then within a run.
    """
    found = blocks.select("file", "block", "data").mapInArrow(_scan, "file bigint, block bigint, pieces array<bigint>")
    found = found.withColumn("n", F.size("pieces") - 1).withColumn("run", F.floor(F.col("block") / RUN_BLOCKS))
    runs = found.groupBy("file", "run").agg(F.sum("n").alias("total"))
    ahead = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select("file", "run", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    local = found.withColumn("local", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return local.join(offsets, ["file", "run"]).select("file", "block", "pieces", (F.col("offset") + F.col("local")).alias("base"))


def document_lengths(scanned: DataFrame) -> DataFrame:
    """``file, number, tokens`` of every document of the files, in their order.

    A piece that a separator closes is counted where it ends; what a block leaves open
    waits under the number of the document that it belongs to.
    """
    pieces = F.col("pieces")
    closed = scanned.select("file", "base", F.posexplode(F.slice(pieces, F.lit(1), F.size(pieces) - 1)).alias("i", "tokens"))
    closed = closed.select("file", (F.col("base") + F.col("i")).alias("number"), "tokens")
    left = scanned.select("file", (F.col("base") + F.size(pieces) - 1).alias("number"), F.element_at(pieces, -1).alias("open"))
    left = left.groupBy("file", "number").agg(F.sum("open").alias("open")).filter("open > 0")
    both = closed.join(left, ["file", "number"], "full")
    return both.select("file", "number", (F.coalesce("tokens", F.lit(0)) + F.coalesce("open", F.lit(0))).alias("tokens"))


def count_tokens(docs: DataFrame, ranks_path: str = RANKS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Write ``docs`` as flat token files, scan them, and name the documents: ``doc_id, n_tokens``."""
    spark, path = docs.sparkSession, stage_path(docs.sparkSession, "tokens")
    write_blocks(docs, ranks_path, block_tokens).write.option("compression", "zstd").parquet(path)
    blocks = spark.read.schema(BLOCKS).parquet(path)
    scanned = scan_blocks(blocks)
    names = blocks.select("file", "block", "ended").join(scanned.select("file", "block", "base"), ["file", "block"])
    names = names.select("file", "base", F.posexplode("ended").alias("i", "doc_id"))
    names = names.select("file", (F.col("base") + F.col("i")).alias("number"), "doc_id")
    return names.join(document_lengths(scanned), ["file", "number"]).select("doc_id", F.col("tokens").alias("n_tokens"))
