"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The
likelihood of a word is the sum over all ways to cut it into pieces, which a forward
pass over its positions adds up; a text is the product of its words. Piece
probabilities are learned by expectation maximisation: Spark counts words per language,
tasks give the expected piece counts of their words, and the sums, at most vocabulary
times languages, make the next model.

Fitting uses at most about ``FIT_ROWS`` rows per language, chosen by a hash; scoring
reads every text as a whole.

Defined results: null texts and texts without letters are ``und`` with score 0, and so
is everything if there is nothing to learn from; characters outside the vocabulary
cost the same in every language; rows with null language are not learned from; repeated
rows are scored alike; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.text import split_words
from footfall.session import stage

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
FIT_ROWS = 2000
ROUNDS = 3
SMOOTHING = 0.01
# Probability of a character that the vocabulary lacks, the same in every language.
UNKNOWN = 1e-7
# Words up to this length are handled together; longer ones one by one, rescaled as they go.
SHORT = 40
# Words whose scores a worker remembers; it starts anew when the store is full.
KNOWN_WORDS = 300_000
LETTER = re.compile(r"[^\W\d_]")
START = "▁"
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def read_pieces(path: str = VOCABULARY) -> list[str]:
    """The pieces of a sentencepiece vocabulary that stand for text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({model.id_to_piece(i) for i in plain})


@dataclass
class Pieces:
    """Hashes of all prefixes of the pieces, sorted, and the piece that each is, or -1."""

    prefixes: np.ndarray
    piece: np.ndarray
    longest: int

    @classmethod
    def of(cls, pieces: list[str]) -> Pieces:
        ids = {text: i for i, text in enumerate(pieces)}
        prefixes = {text[:k] for text in pieces for k in range(1, len(text) + 1)}
        hashed = sorted((_hash(p), ids.get(p, -1)) for p in prefixes)
        keys = np.array([h for h, _ in hashed], np.uint64)
        return cls(keys, np.array([i for _, i in hashed]), max(map(len, pieces)))

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are prefixes of pieces, and the pieces of those that are."""
        at = np.minimum(np.searchsorted(self.prefixes, hashes), len(self.prefixes) - 1)
        known = self.prefixes[at] == hashes
        return known, self.piece[at[known]]


def _hash(text: str) -> int:
    value = 0
    for c in text:
        value = ((value + ord(c) + 1) * int(FACTOR)) & 0xFFFFFFFFFFFFFFFF
    return value


def lattice(words: list[str], pieces: Pieces) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces inside words of one length: ``(from, to, rows, piece)``; -1 is an unknown character."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1).astype(np.uint64)
    arcs = []
    for i in range(codes.shape[1]):
        rows, hashes = np.arange(len(words)), np.zeros(len(words), np.uint64)
        for j in range(i, min(codes.shape[1], i + pieces.longest)):
            hashes = (hashes + codes[rows, j] + np.uint64(1)) * FACTOR
            known, ids = pieces.look_up(hashes)
            if j == i:
                single = np.full(len(rows), -1)
                single[known] = ids
                arcs.append((i, i + 1, rows, single))
            elif (is_piece := ids >= 0).any():
                arcs.append((i, j + 1, rows[known][is_piece], ids[is_piece]))
            rows, hashes = rows[known], hashes[known]
            if not len(rows):
                break
    return arcs


def forward(arcs: list, n_words: int, length: int, p: np.ndarray) -> np.ndarray:
    """Sums over all segmentations up to each position: ``word, position, language``.

    The last row of ``p`` is the unknown character.
    """
    alpha = np.zeros((n_words, length + 1, p.shape[1]))
    alpha[:, 0] = 1.0
    for i, j, rows, ids in arcs:
        alpha[rows, j] += alpha[rows, i] * p[ids]
    return alpha


def _long_word(word: str, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Log-likelihood of one long word per language; the sums are rescaled at every position."""
    scale = np.zeros(p.shape[1])
    by_end = defaultdict(list)
    for at in range(0, len(word), 256):
        # Pieces that begin in this part; parts overlap by the longest piece.
        part = word[at : at + 256 + pieces.longest]
        for i, j, _, ids in lattice([part], pieces):
            if i < 256:
                by_end[at + j].append((at + i, ids[0]))
    ring = {0: np.ones(p.shape[1])}
    for end in range(1, len(word) + 1):
        total = sum((ring[start] * p[piece] for start, piece in by_end.pop(end)), np.zeros(p.shape[1]))
        ring[end] = total
        ring.pop(end - pieces.longest - 1, None)
        scale += np.log(total)
        ring = {start: value / total for start, value in ring.items()}
    return scale


def word_scores(words: Iterable[str], pieces: Pieces, p: np.ndarray) -> dict[str, np.ndarray]:
    """Log-likelihood per language of each word, from the sum over its segmentations."""
    by_length, out = defaultdict(list), {}
    for word in words:
        if len(word) < SHORT:
            by_length[len(word)].append(word)
        else:
            out[word] = _long_word(START + word, pieces, p)
    for length, same in by_length.items():
        for at in range(0, len(same), 20_000):
            part = same[at : at + 20_000]
            marked = [START + word for word in part]
            alpha = forward(lattice(marked, pieces), len(part), length + 1, p)
            out.update(zip(part, np.log(alpha[:, -1])))
    return out


def expected_counts(words: list[str], counts: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in words of one language, over all their segmentations."""
    total = np.zeros(len(p))
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths[lengths < SHORT]):
        same = np.flatnonzero(lengths == length)
        for part in np.array_split(same, -(-len(same) // 20_000)):
            arcs = lattice([START + words[k] for k in part], pieces)
            alpha = forward(arcs, len(part), length + 1, p[:, None])[:, :, 0]
            beta = np.zeros_like(alpha)
            beta[:, -1] = 1.0
            share = counts[part] / alpha[:, -1]
            for i, j, rows, ids in sorted(arcs, key=lambda a: -a[0]):
                through = p[ids] * beta[rows, j]
                beta[rows, i] += through
            for i, j, rows, ids in arcs:
                use = alpha[rows, i] * p[ids] * beta[rows, j] * share[rows]
                total += np.bincount(np.where(ids < 0, len(p) - 1, ids), use, len(p))
    return total


@dataclass
class Model:
    languages: list[str]
    log_prior: np.ndarray
    pieces: Pieces
    p: np.ndarray


def fit(labelled: DataFrame, pieces: list[str], rows: int = FIT_ROWS, rounds: int = ROUNDS) -> Model | None:
    """Learn from ``doc_id, text, lang``; None if there is no labelled row.

    The languages of the labels come to the driver, and the model has a column for each.
    """
    labelled = labelled.filter(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return None
    limits = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, rows / sizes[lang])))])
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) / 1_000_000
    sample = labelled.filter(chance < F.element_at(limits, F.col("lang")))
    words = sample.select("lang", F.explode(split_words(F.col("text"))).alias("word"))
    counted = stage(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "word_counts")

    table, v = Pieces.of(pieces), len(pieces)
    p = np.full((v + 1, len(languages)), 1.0 / v)
    p[v] = UNKNOWN
    column = {lang: k for k, lang in enumerate(languages)}
    context = labelled.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast((table, p, column))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, p, column = shared.value
            total = np.zeros(p.T.shape)
            for batch in batches:
                langs, words, n = (np.array(batch.column(k).to_pylist(), dtype=object) for k in range(3))
                for lang in set(langs):
                    mine = np.flatnonzero(langs == lang)
                    k = column[lang]
                    total[k] += expected_counts(list(words[mine]), n[mine].astype(float), table, p[:, k])
            lang, piece = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(piece), pa.array(total[lang, piece])], ["lang", "piece", "uses"])

        found = counted.mapInArrow(expect, "lang bigint, piece bigint, uses double")
        found = found.groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toPandas()
        uses = np.full((v, len(languages)), SMOOTHING)
        known = found[found["piece"] < v]
        uses[known["piece"].to_numpy(), known["lang"].to_numpy()] += known["uses"].to_numpy()
        p = np.vstack([uses / uses.sum(axis=0), np.full(len(languages), UNKNOWN)])
    seen = np.array([sizes[lang] for lang in languages], float)
    return Model(languages, np.log(seen / seen.sum()), table, p)


class _KnownWords:
    """Word scores of a worker, as rows of one matrix."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.scores = np.zeros((KNOWN_WORDS, len(self.model.languages)))

    def learn(self, words: set[str]) -> None:
        fresh = [w for w in words if w not in self.row]
        if len(self.row) + len(fresh) > len(self.scores):
            self.clear()
            fresh = list(words)
            if len(fresh) > len(self.scores):
                self.scores = np.zeros((len(fresh), len(self.model.languages)))
        for word, score in word_scores(fresh, self.model.pieces, self.model.p).items():
            self.scores[len(self.row)] = score
            self.row[word] = len(self.row)

    def text(self, words: list[str]) -> np.ndarray:
        rows = np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))
        return self.scores[rows].sum(axis=0)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs``; the score is the posterior."""
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    if model is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = _KnownWords(model)
        for batch in batches:
            names, scores = [], []
            for at in range(0, batch.num_rows, 1000):
                texts = batch.column(1).slice(at, 1000).to_pylist()
                words = [t.split() if t and LETTER.search(t) else None for t in texts]
                known.learn(set().union(*filter(None, words)))
                for mine in words:
                    if not mine:
                        names.append("und")
                        scores.append(0.0)
                        continue
                    logs = known.text(mine) + model.log_prior
                    best = int(logs.argmax())
                    names.append(model.languages[best])
                    scores.append(float(1.0 / np.exp(logs - logs[best]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.mapInArrow(score, "doc_id bigint, lang_pred string, score double")
