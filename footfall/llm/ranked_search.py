"""Ranked lexical search by dense blocked matrix products.

The items are the queries, every document is scored for each of them. One pass over the
texts keeps the counts of the items' terms, from which the statistics follow. A second
pass takes tiles of documents: their integer impacts become a dense matrix over the
compact vocabulary of a tile of items (only terms that occur on both sides), which is
multiplied with the weights of those items in float64. A vocabulary tile has so few
terms that no partial sum reaches 2^53; the sums of several tiles are added as int64, so
every score is exact. Of each tile all documents that reach the item's current last
place are looked at, ties included, and the ``top`` best stay.

Items are taken in blocks of about ``BLOCK_PAIRS`` (item, term) pairs, the bound of what
is sent to the tasks; each block is run against all documents.

Defined results: null and empty texts, and texts without terms, are ranked nowhere and
count in no statistic; every row of the documents is a document, also a repeated one;
rows of items that share an item_id (or have none) are one item with the terms of all; an
item without terms has no result; equal scores are ordered by doc_id, a null one last;
further columns are ignored. Whole texts count, however long: a text costs its terms.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.session import drop_stage, stage

TOP = 50
BLOCK_PAIRS = 200_000
ITEM_TILE = 256
DOC_TILE = 512
VOCABULARY_TILE = 2048
EXACT = 2**53
# Fixed values of the score that the query contract names.
SCALE, TF_WEIGHT, LENGTH_WEIGHT, BASE, SLOPE = 1_000_000_000, 1000, 20, 50, 50
# A rank is taken in this many parts first, so that no task sees the finds of all tasks for an item.
PARTS = 64

_LETTERS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
# Bytes of one term stay, with A-Z in lower case; all other ASCII becomes a space.
_TABLE = bytes(c if c >= 128 or c in _LETTERS else 32 for c in range(256)).lower()


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a whole text in UTF-8, with repeats."""
    return (text or b"").translate(_TABLE).split()


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = sorted(set(terms(text.as_py())))
            for at in range(0, len(found), 10_000):
                part = found[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(part), pa.int64()), pa.array(part, pa.binary())], ["item_id", "term"])


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct ``item_id, term`` of the queries."""
    texts = items.select(F.col("item_id").cast("bigint"), F.col("text").cast("binary"))
    return texts.mapInArrow(_item_terms, "item_id bigint, term binary").distinct()


def postings(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``doc_id, n, terms, counts``: all terms of a document counted, those of the vocabulary by number."""
    numbers = {term: k for k, term in enumerate(vocabulary)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found, counts = [], [], []
            for text in batch.column(1):
                words = terms(text.as_py())
                bag = Counter(words)
                known = sorted((numbers[w], bag[w]) for w in bag.keys() & numbers.keys())
                sizes.append(len(words))
                found.append([k for k, _ in known])
                counts.append([n for _, n in known])
            arrays = [pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n", "terms", "counts"])

    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary"))
    return texts.mapInArrow(count, "doc_id bigint, n bigint, terms array<int>, counts array<bigint>")


def weights(n_docs: int, frequencies: dict[int, int], size: int) -> np.ndarray:
    """Integer weight of each term of the vocabulary; terms that no document holds weigh nothing."""
    out = np.zeros(size, np.int64)
    for term, df in frequencies.items():
        out[term] = math.floor(1000.0 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    return out


class _Tile:
    """Up to ``ITEM_TILE`` items over the compact vocabulary of their terms."""

    def __init__(self, first: int, members: list[np.ndarray]):
        self.first, self.n = first, len(members)
        rows = np.repeat(np.arange(self.n), [len(m) for m in members])
        self.vocabulary, columns = np.unique(np.concatenate(members), return_inverse=True)
        order = np.argsort(columns, kind="stable")
        self.rows, self.columns = rows[order], columns[order]

    def scores(self, found: np.ndarray, owners: np.ndarray, impacts: np.ndarray, n_docs: int, weight: np.ndarray, width: int) -> np.ndarray:
        """Exact scores, items by documents."""
        at = np.searchsorted(self.vocabulary, found)
        here = np.flatnonzero(self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == found)
        present, columns = np.unique(at[here], return_inverse=True)
        total = np.zeros((self.n, n_docs), np.int64)
        for low in range(0, len(present), width):
            block = present[low : low + width]
            entries = here[(columns >= low) & (columns < low + width)]
            matrix = np.zeros((len(block), n_docs))
            matrix[np.searchsorted(block, at[entries]), owners[entries]] = impacts[entries]
            place = np.searchsorted(block, self.columns)
            own = np.flatnonzero(block[np.minimum(place, len(block) - 1)] == self.columns)
            left = np.zeros((self.n, len(block)))
            left[self.rows[own], place[own]] = weight[self.vocabulary[self.columns[own]]]
            total += (left @ matrix).astype(np.int64)
        return total


def _best(scores: np.ndarray, docs: np.ndarray, missing: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` best: by score, then doc_id, a missing one last."""
    return np.lexsort((docs, missing, -scores))[:top]


def rank_postings(found: DataFrame, members: list[np.ndarray], names: list, weight: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """``item_id, doc_id, score``: the best documents of every task for each item."""
    largest = max(int(weight.max(initial=0)), 1) * (SCALE // TF_WEIGHT)
    width = max(1, min(VOCABULARY_TILE, (EXACT - 1) // largest))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = [_Tile(k, members[k : k + ITEM_TILE]) for k in range(0, len(members), ITEM_TILE)]
        none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))
        best = [none] * len(members)
        last = np.ones(len(members), np.int64)  # the score that a document needs to be looked at
        for batch in batches:
            for at in range(0, batch.num_rows, DOC_TILE):
                part = batch.slice(at, DOC_TILE)
                ids = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                missing = part.column(0).is_null().to_numpy(zero_copy_only=False)
                lengths = np.array([BASE + SLOPE * n * n_docs // n_terms for n in part.column(1).to_pylist()], np.int64)
                lists = part.column(2)
                owners = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                numbers, counts = lists.flatten().to_numpy(), part.column(3).flatten().to_numpy()
                impacts = (SCALE * counts) // (TF_WEIGHT * counts + LENGTH_WEIGHT * lengths[owners])
                for tile in tiles:
                    scores = tile.scores(numbers, owners, impacts, part.num_rows, weight, width)
                    reach = scores >= last[tile.first : tile.first + tile.n, None]
                    for row in np.flatnonzero(reach.any(axis=1)):
                        item, own = tile.first + row, np.flatnonzero(reach[row])
                        joined = [np.concatenate(x) for x in zip(best[item], (scores[row, own], ids[own], missing[own]))]
                        keep = _best(*joined, top)
                        best[item] = tuple(x[keep] for x in joined)
                        if len(keep) == top:
                            last[item] = best[item][0][-1]
        for item, (scores, ids, missing) in enumerate(best):
            if len(scores):
                arrays = [pa.array([names[item]] * len(scores), pa.int64()), pa.array(ids, pa.int64(), mask=missing), pa.array(scores, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["item_id", "doc_id", "score"])

    return found.mapInArrow(rank, "item_id bigint, doc_id bigint, score bigint")


def _first(found: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """The ``top`` best documents of every item: ``item_id, rank, doc_id, score``."""
    spark = docs.sparkSession
    pairs = stage(item_terms(items), "item-terms")
    blocks = math.ceil(pairs.count() / block_pairs)
    ranked = []
    for block in range(blocks):
        of_block = pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else pairs
        by_item: dict = {}
        for row in of_block.collect():  # bounded by block_pairs
            by_item.setdefault(row.item_id, []).append(bytes(row.term))
        if not by_item:
            continue
        vocabulary = sorted({t for own in by_item.values() for t in own})
        numbers = {t: k for k, t in enumerate(vocabulary)}
        names = sorted(by_item, key=lambda i: (i is None, i))
        members = [np.array(sorted(numbers[t] for t in by_item[i]), np.int64) for i in names]
        found = stage(postings(docs, vocabulary), "postings")
        n_docs, n_terms = found.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if n_docs:
            held = found.select(F.explode("terms").alias("term")).groupBy("term").count()
            weight = weights(n_docs, {r.term: r["count"] for r in held.collect()}, len(vocabulary))
            ranked.append(stage(rank_postings(found, members, names, weight, n_docs, n_terms, top), "ranked"))
        drop_stage(found)
    drop_stage(pairs)
    if not ranked:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    every = ranked[0]
    for more in ranked[1:]:
        every = every.unionByName(more)
    every = every.withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS)))
    return _first(_first(every, ["item_id", "part"], top), ["item_id"], top).select("item_id", "rank", "doc_id", "score")
