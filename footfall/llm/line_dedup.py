"""Lines that many documents share, dropped by keep bitmaps.

Only hashes travel: a line is its 128-bit key hash, its document and its position. The
hashes are partitioned by range with document and position as secondary sort, so the
lines of a document that share a key lie behind each other, and a stream over a partition
sees which of them is the first. The documents of a key are its first occurrences. They
are added up within the partitions before the sums meet, and since document is part of
the range, a key that stands in every document fills many partitions. What comes back for
a document is the run-length form of its keep bitmap, never text. Only DataFrame
functions are used.

Defined results: a null or empty text is one empty line; keys shorter than ``min_chars``
are never dropped; rows that share doc_id and text lose the same lines and count as one
document each; a null doc_id is a document like any other; further columns, whatever
their names, are ignored, and kept by :func:`drop_lines`. A very long text costs its
lines; its positions (8 bytes for each dropped line) and its runs have to fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.text import ascii_lower, fresh_names
from footfall.operators.joins import BROADCAST_ROWS, lookup_join
from footfall.session import stage

MIN_DOCS = 10
MIN_CHARS = 1
# The white space that the query contract strips.
STRIPPED = " \t\n\x0b\x0c\r"
# Runs of all bitmaps together up to which they are broadcast (16 bytes each).
BROADCAST_RUNS = 1_000_000

_KEY = ["key_high", "key_low"]
_DOC = ["doc", "text_high", "text_low"]


def _document(doc_id: Column, text: Column) -> list[Column]:
    """Key of a document that is never null: its id, and 128 bits of its text and of whether it has an id."""
    return [
        F.coalesce(doc_id.cast("bigint"), F.lit(0).cast("bigint")),
        F.xxhash64(doc_id.isNull(), text),
        F.xxhash64(F.lit(1), doc_id.isNull(), text),
    ]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Hashed key, document and position of every line that could be dropped."""
    text = F.col("text")
    keys = [part.alias(name) for part, name in zip(_document(F.col("doc_id"), text), _DOC)]
    lines = docs.select(*keys, F.posexplode(_lines(ascii_lower(text))).alias("pos", "line"))
    lines = lines.select(*_DOC, "pos", F.btrim("line", F.lit(STRIPPED)).alias("key"))
    lines = lines.filter(F.length("key") >= max(min_chars, 1))
    return lines.select(F.xxhash64("key").alias("key_high"), F.xxhash64(F.lit(1), "key").alias("key_low"), *_DOC, "pos")


def shared_keys(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Keys of at least ``min_docs`` documents with the place of their first occurrence."""
    ordered = lines.repartitionByRange(*_KEY, *_DOC).sortWithinPartitions(*_KEY, *_DOC, "pos")
    # Rows that share doc_id and text tie, so each of them is a first occurrence.
    first = F.rank().over(Window.partitionBy(*_KEY, *_DOC).orderBy("pos")) == 1
    firsts = ordered.withColumn("first", first).filter("first")
    counted = firsts.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct(*_DOC, "pos")).alias("first_at"))
    return counted.filter(F.col("n_docs") >= min_docs)


def bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """Compressed keep bitmap of every document that loses lines.

    ``doc, text_high, text_low`` name the document; ``runs`` holds the runs of zeros of
    its bitmap as ``start, n``; all other lines stay. With ``keep_first`` a key keeps its
    first occurrence, by doc_id and position.
    """
    lines = stage(line_keys(docs, min_chars), "line-keys")
    shared = shared_keys(lines, min_docs).drop("n_docs")
    dropped = lookup_join(lines, shared if keep_first else shared.drop("first_at"), _KEY, [*_DOC, "pos"])
    if keep_first:
        dropped = dropped.filter(F.struct(*_DOC, "pos") != F.col("first_at"))
    positions = dropped.groupBy(*_DOC).agg(F.sort_array(F.collect_set("pos")).alias("positions"))
    return stage(positions, "dropped-lines").select(*_DOC, _runs(F.col("positions")).alias("runs"))


def _runs(positions: Column) -> Column:
    starts = F.filter(positions, lambda p, k: (k == 0) | (F.get(positions, k - 1) != p - 1))
    ends = F.filter(positions, lambda p, k: (k == F.size(positions) - 1) | (F.get(positions, k + 1) != p + 1))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e - s + 1).alias("n")))


def _kept(lines: Column, runs: Column) -> Column:
    """Lines outside the runs: the slices before each run, and the one after the last."""
    end = lambda k: F.get(runs, k)["start"] + F.get(runs, k)["n"]
    from_line = lambda k: F.when(k == 0, F.lit(0)).otherwise(end(k - 1))
    before = F.transform(runs, lambda r, k: F.slice(lines, from_line(k) + 1, r["start"] - from_line(k)))
    last = end(F.size(runs) - 1)
    return F.concat(F.flatten(before), F.slice(lines, last + 1, F.size(lines) - last))


def _with_runs(docs: DataFrame, lost: DataFrame, names: dict[str, str]) -> DataFrame:
    """``docs`` with the lines of each text and the runs it loses, or null."""
    lost = lost.withColumnsRenamed({c: names[c] for c in [*_DOC, "runs"]})
    keys = {names[c]: part for c, part in zip(_DOC, _document(F.col("doc_id"), F.col("text")))}
    size = lost.agg(F.count(F.lit(1)), F.sum(F.size(names["runs"]))).first()
    if size[0] <= BROADCAST_ROWS and (size[1] or 0) <= BROADCAST_RUNS:
        lost = F.broadcast(lost)
    return docs.withColumns(keys).join(lost, [names[c] for c in _DOC], "left").withColumn(names["lines"], _lines(F.col("text")))


def _kept_text(names: dict[str, str]) -> Column:
    lines, runs = F.col(names["lines"]), F.col(names["runs"])
    return F.when(runs.isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(F.array_join(_kept(lines, runs), "\n"))


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """``docs`` without the lines that ``min_docs`` documents share; texts that lose nothing, and other columns, stay as they are."""
    names = fresh_names(docs, [*_DOC, "runs", "lines"])
    df = _with_runs(docs, bitmaps(docs, min_docs, min_chars, keep_first), names)
    kept = F.when(F.col(names["runs"]).isNull(), F.col("text")).otherwise(_kept_text(names))
    return df.withColumn("text", kept).select(*docs.columns)


def digest(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Lines, dropped lines and hash of the kept text of every document."""
    docs = docs.select("doc_id", "text")
    names = fresh_names(docs, [*_DOC, "runs", "lines"])
    df = _with_runs(docs, bitmaps(docs, min_docs, min_chars), names)
    dropped = F.aggregate(names["runs"], F.lit(0).cast("bigint"), lambda total, r: total + r["n"])
    return df.select(
        "doc_id",
        F.size(names["lines"]).cast("bigint").alias("n_lines"),
        F.coalesce(dropped, F.lit(0)).cast("bigint").alias("n_dropped"),
        F.sha2(_kept_text(names), 256).alias("kept_sha256"),
    )
