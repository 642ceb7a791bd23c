"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Every token falls into one of ``BUCKETS`` hashed words, and each bucket has a sparse
random index vector of ``+1`` and ``-1``. A word vector is the sum of the index vectors
of the words next to it, over all documents. A document is the mean of its words' unit
vectors, common words weighted down, with three more measures of the pool: the share of
neighbours with the same index vector, the share of distinct ones, and the logarithm of
the number of words. A two-layer numpy network is fitted on at most
about ``FIT_ROWS`` labelled rows, and a temperature is fitted on a part held back.

Word vectors have a fixed size, whatever the corpus: each task adds up its documents in
one matrix, and matrices are summed in two steps.

Defined results: null, empty and token-less texts have the zero vector and are scored
like any other; labels that are null or without a document are not used; without labels
of both kinds every score is the share of ones, or 0.5; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.operators.joins import lookup_join
from footfall.session import stage

TOKEN = re.compile(r"\w+|[^\w\s]+")
BUCKETS = 16_384
DIM = 64
FEATURES = DIM + 3
NEAR = 2
NONZERO = 2
# Rows of the matrix that travel together, and parts in the first step of the sum.
SLAB = 256
PARTS = 32
RARE = 1e-3
FIT_ROWS = 20_000
HIDDEN = 32
EPOCHS = 40
BATCH = 128
RATE = 3e-3
DECAY = 1e-4
SEED = 11
THRESHOLD = 0.7
KNOWN_WORDS = 300_000


class _Buckets(dict):
    """Bucket of each token, computed once while it is remembered."""

    def __missing__(self, token: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[token] = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass")) % BUCKETS
        return value


def _token_buckets(text: str | None, buckets: dict) -> np.ndarray:
    tokens = TOKEN.findall(text or "")
    return np.fromiter(map(buckets.__getitem__, tokens), np.int64, len(tokens))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each bucket's index vector."""
    dice = np.random.default_rng(SEED)
    return dice.integers(0, DIM, (BUCKETS, NONZERO)), dice.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def _accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of a task: one row per slab of the matrix, its last column the word counts."""
    buckets, (places, signs) = _Buckets(), index_vectors()
    total, counts = np.zeros(BUCKETS * DIM), np.zeros(BUCKETS)

    def flush(pending: list[np.ndarray]) -> None:
        # Documents stand apart by a gap as wide as the window.
        ids = np.concatenate([part for doc in pending for part in (doc, np.full(NEAR, -1))])
        counts[:] += np.bincount(ids[ids >= 0], minlength=BUCKETS)
        for shift in range(1, NEAR + 1):
            a, b = ids[shift:], ids[:-shift]
            known = (a >= 0) & (b >= 0)
            a, b = a[known], b[known]
            for word, near in ((a, b), (b, a)):
                for k in range(NONZERO):
                    total[:] += np.bincount(word * DIM + places[near, k], signs[near, k], BUCKETS * DIM)

    pending, size = [], 0
    for batch in batches:
        for text in batch.column(0):
            ids = _token_buckets(text.as_py(), buckets)
            pending.append(ids)
            size += len(ids)
            if size >= 500_000:
                flush(pending)
                pending, size = [], 0
    if pending:
        flush(pending)
    if counts.any():
        matrix = np.hstack([total.reshape(BUCKETS, DIM), counts[:, None]]).astype(np.float32)
        slabs = [matrix[at : at + SLAB].tobytes() for at in range(0, BUCKETS, SLAB)]
        part = int(np.random.default_rng(int(counts.sum())).integers(PARTS))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(slabs)), pa.int32()), pa.array([part] * len(slabs), pa.int32()), pa.array(slabs)], ["slab", "part", "data"])


def _add_slabs(group: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(data, np.float32).astype(np.float64) for data in group["data"])
    return pd.DataFrame({"slab": group["slab"].iloc[:1], "part": group["part"].iloc[:1], "data": [total.astype(np.float32).tobytes()]})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Weighted unit vectors of all buckets, from the contexts in all documents."""
    schema = "slab int, part int, data binary"
    sums = docs.select("text").mapInArrow(_accumulate, schema).groupBy("slab", "part").applyInPandas(_add_slabs, schema)
    # At most PARTS rows for each of the fixed number of slabs.
    sums = sums.groupBy("slab").applyInPandas(_add_slabs, schema).toPandas()
    matrix = np.zeros((BUCKETS, DIM + 1), np.float32)
    for slab, data in zip(sums["slab"], sums["data"]):
        matrix[slab * SLAB : (slab + 1) * SLAB] = np.frombuffer(data, np.float32).reshape(SLAB, DIM + 1)
    vectors, counts = matrix[:, :DIM], matrix[:, DIM]
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    share = counts / max(1.0, counts.sum())
    return vectors / np.where(length > 0, length, 1) * (RARE / (RARE + share))[:, None]


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """``doc_id, vector``: the mean of the words' vectors of each whole text, and three measures of it."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors.astype(np.float32))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, vectors = _Buckets(), shared.value
        for batch in batches:
            out = np.zeros((batch.num_rows, FEATURES), np.float32)
            for k, text in enumerate(batch.column(1)):
                ids = _token_buckets(text.as_py(), buckets)
                if len(ids):
                    used, times = np.unique(ids, return_counts=True)
                    out[k, :DIM] = times @ vectors[used] / len(ids)
                    out[k, DIM:] = np.mean(ids[1:] == ids[:-1]) if len(ids) > 1 else 0, len(used) / len(ids), np.log1p(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(out.ravel(), FEATURES).cast(pa.list_(pa.float32()))], ["doc_id", "vector"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(pool, "doc_id bigint, vector array<float>")


@dataclass
class Network:
    """``sigmoid((relu(x W1 + b1) W2 + b2) / temperature)`` over standardised vectors."""

    mean: np.ndarray
    spread: np.ndarray
    weights: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum((x - self.mean) / self.spread @ w1 + b1, 0) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def _gradient(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    w1, b1, w2, _ = net.weights
    x = (x - net.mean) / net.spread
    hidden = np.maximum(x @ w1 + b1, 0)
    error = (1 / (1 + np.exp(-np.clip(hidden @ w2 + net.weights[3], -60, 60))) - y) / len(y)
    back = np.outer(error, w2) * (hidden > 0)
    return [x.T @ back + DECAY * w1, back.sum(axis=0), hidden.T @ error + DECAY * w2, error.sum()]


def train(x: np.ndarray, y: np.ndarray) -> Network:
    """Fit by Adam on four fifths of the rows, the temperature on the rest."""
    dice = np.random.default_rng(SEED)
    order = dice.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    spread = x[used].std(axis=0)
    weights = [dice.normal(0, (2 / FEATURES) ** 0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), dice.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    net = Network(x[used].mean(axis=0), np.where(spread > 0, spread, 1), weights)
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(EPOCHS):
        for part in np.array_split(dice.permutation(used), max(1, len(used) // BATCH)):
            step += 1
            for k, g in enumerate(_gradient(net, x[part], y[part])):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                ahead = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                net.weights[k] = net.weights[k] - RATE * ahead
    if len(held) and 0 < y[held].mean() < 1:
        logits = net.logits(x[held])

        def loss(t: float) -> float:
            return float(np.mean(np.logaddexp(0, -np.where(y[held] > 0, logits, -logits) / t)))

        net.temperature = min(np.geomspace(0.25, 8, 61), key=loss)
    return net


def fit(vectors: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Network | float:
    """Network from ``doc_id, vector`` and ``doc_id, quality``, or a constant score."""
    labels = stage(labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", "quality").distinct(), "labels")
    n = labels.count()
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    sample = labels.filter(chance < min(1.0, rows / max(1, n)))
    # Ordered, so that the model does not depend on how tasks finish.
    found = lookup_join(vectors, sample, ["doc_id"], ["vector"]).toPandas().sort_values("doc_id", kind="stable")
    if found["quality"].nunique() < 2:
        return float(found["quality"].mean()) if len(found) else 0.5
    return train(np.vstack(found["vector"]).astype(np.float64), found["quality"].to_numpy(float))


def score(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, score, predicted`` for every row of ``docs``, learned from ``labels``."""
    vectors = stage(pooled(docs, word_vectors(docs)), "pooled")
    net = fit(vectors, labels, rows)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES).astype(np.float64)
            found = net.score(x) if isinstance(net, Network) else np.full(len(x), net)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    scored = vectors.mapInArrow(rate, "doc_id bigint, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
