"""Benchmark decontamination with a positional inverted index of the training words.

Benchmark items are cut into windows. The corpus counts of the benchmark's terms name
the two rarest terms of each window; the index stores the positions of those terms,
next to the documents they come from. A posting minus the term's offset is the place
where the window would begin: where the lists of both terms agree, the window's words
are compared in the document itself; where they differ by a few words, it is a
proximity match. Only DataFrame functions are used.

Defined results: null and blank texts have no words, items without words no window; a
null item_id can be hit but is not named; rows that share a doc_id, null included, are
each judged by their own text; equal items are all named; empty tables give empty or
clean results; further columns are ignored, and kept by :func:`remove_leaks`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.text import SEPARATORS, ascii_lower, fenced_filter, keeping_columns, split_words
from footfall.operators.joins import BROADCAST_ROWS, lookup_join
from footfall.session import stage

WINDOW = 10
# How far two rare terms may stand from their distance in the item, in words.
SLACK = 3
CANDIDATES = "array<struct<base:bigint,words:array<string>,items:array<string>>>"


def _words(text: Column) -> Column:
    return split_words(ascii_lower(text), SEPARATORS)


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: ``w, words, items``; an item shorter than a window is one window."""
    words = items.select(F.col("item_id").cast("string").alias("item"), _words(F.col("text")).alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - (window - 1)))
    cut = words.select("item", "all", F.explode(starts).alias("i")).select("item", F.slice("all", F.col("i"), F.lit(window)).alias("words"))
    return cut.groupBy("words").agg(F.collect_set("item").alias("items")).select(F.xxhash64("words").alias("w"), "words", "items")


def _occurrences(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """Postings ``term, doc_id, pos`` of the given terms, from ``doc_id, text``."""
    every = docs.select("doc_id", F.posexplode(_words(F.col("text"))).alias("pos", "term"))
    return lookup_join(every, terms, ["term"], ["doc_id", "pos"], small_rows=n_terms)


def term_counts(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Corpus counts of the windows' terms: ``term, count``; counted before the shuffle."""
    terms = stage(windows.select(F.explode("words").alias("term")).distinct(), "terms")
    found = _occurrences(docs.select(F.lit(0).alias("doc_id"), "text"), terms, terms.count())
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("count"))


def rarest_terms(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """The two rarest terms of each window: ``w, n, rank, term, offset``.

    A window with a term that the corpus lacks cannot occur and is left out.
    """
    terms = windows.select("w", F.size("words").alias("n"), F.posexplode("words").alias("offset", "term"))
    known = lookup_join(terms, counts, ["term"], ["w"])
    rank = F.row_number().over(Window.partitionBy("w", "n").orderBy("count", "offset"))
    whole = F.count(F.lit(1)).over(Window.partitionBy("w", "n"))
    ranked = known.withColumn("rank", rank).withColumn("whole", whole)
    return ranked.filter((F.col("rank") <= 2) & (F.col("whole") >= F.col("n"))).select("w", "n", "rank", "term", "offset")


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Store the positional postings of ``terms``: ``term, doc_id, pos``.

    The index is cut by documents: each task writes the postings of its documents, so
    no list is gathered in one place and a hot term costs no shuffle.
    """
    return stage(_occurrences(docs, terms, terms.count()), "postings")


def near_places(index: DataFrame, rare: DataFrame, slack: int = SLACK) -> DataFrame:
    """Places where both rare terms of a window stand, give or take ``slack`` words:
    ``doc_id, w, base, shift``; a shift of 0 is a candidate for the exact phrase.

    Bases are compared by buckets a little wider than the slack, so a document full of
    one term does not pair all its positions.
    """
    n_rare = rare.count()

    def places(rank: int) -> DataFrame:
        terms = rare.filter(F.col("rank") == rank).select("term", "w", "n", "offset")
        found = lookup_join(index, terms, ["term"], ["doc_id", "pos"], small_rows=n_rare)
        return found.select("doc_id", "w", "n", (F.col("pos") - F.col("offset")).cast("bigint").alias("base"))

    first = places(1)
    alone = first.filter((F.col("n") == 1) & (F.col("base") >= 0)).select("doc_id", "w", "base", F.lit(0).cast("bigint").alias("shift"))
    bucket = F.floor(F.col("base") / (slack + 1))
    left = first.select("doc_id", "w", "base", bucket.alias("bucket"))
    around = F.explode(F.array(bucket - 1, bucket, bucket + 1))
    right = places(2).select(F.col("doc_id").alias("__doc"), F.col("w").alias("__w"), F.col("base").alias("other"), around.alias("__bucket"))
    same = left["doc_id"].eqNullSafe(F.col("__doc")) & (left["w"] == F.col("__w")) & (left["bucket"] == F.col("__bucket"))
    shift = F.col("other") - F.col("base")
    near = left.join(right, same).filter((F.abs(shift) <= slack) & (F.col("base") >= 0)).select("doc_id", "w", "base", shift.alias("shift"))
    return alone.unionByName(near)


def _candidates(docs: DataFrame, items: DataFrame, window: int, slack: int) -> tuple[DataFrame, int]:
    """Per doc_id: ``__doc, __cand, __near``, and how many candidates there are in all."""
    slim = docs.select("doc_id", "text")
    windows = stage(item_windows(items, window), "windows")
    counts = stage(term_counts(slim, windows), "term_counts")
    rare = stage(rarest_terms(windows, counts), "rare_terms")
    index = build_index(slim, rare.select("term").distinct())
    places = stage(near_places(index, rare, slack), "places")
    words = lookup_join(places, windows, ["w"], ["doc_id", "base"])
    exact = F.when(F.col("shift") == 0, F.struct("base", "words", "items"))
    per_doc = words.groupBy(F.col("doc_id").alias("__doc")).agg(
        F.collect_set(exact).cast(CANDIDATES).alias("__cand"), F.count_distinct("w").alias("__near")
    )
    return stage(per_doc, "candidates"), places.count()


def with_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, slack: int = SLACK, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with ``__hits``: ``n_words``, ``n_hit``, ``items`` (sorted), ``n_near`` (windows within the slack).

    Candidates are broadcast only below a counted limit; beyond it they meet the
    documents in a join on doc_id.
    """
    found, total = _candidates(docs, items, window, slack)
    side = F.broadcast(found) if total <= broadcast_rows else found
    df = docs.join(side, docs["doc_id"].eqNullSafe(F.col("__doc")), "left").withColumn("__words", _words(F.col("text")))
    true = F.filter("__cand", lambda c: F.slice(F.col("__words"), (c["base"] + 1).cast("int"), F.size(c["words"])) == c["words"])
    df = df.withColumn("__true", F.coalesce(true, F.array().cast(CANDIDATES)))
    places = F.flatten(F.transform("__true", lambda c: F.sequence(c["base"], c["base"] + F.size(c["words"]) - 1)))
    hits = F.struct(
        F.size("__words").cast("bigint").alias("n_words"),
        F.size(F.array_distinct(places)).cast("bigint").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("__true", lambda c: c["items"])))).alias("items"),
        F.coalesce("__near", F.lit(0)).cast("bigint").alias("n_near"),
    )
    return df.withColumn("__hits", hits).drop("__doc", "__cand", "__near", "__words", "__true")


def digest(docs: DataFrame, items: DataFrame, window: int = WINDOW, slack: int = SLACK, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Words, hit words and items of each document."""
    hits = with_hits(docs.select("doc_id", "text"), items, window, slack, broadcast_rows)
    return hits.select(
        "doc_id",
        "__hits.n_words",
        "__hits.n_hit",
        F.size("__hits.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("__hits.items", ","), 256).alias("items_sha256"),
        (F.col("__hits.n_hit") > 0).alias("contaminated"),
        "__hits.n_near",
    )


@keeping_columns("doc_id", "text")
def remove_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, with all their columns."""
    return fenced_filter(with_hits(docs, items), F.col("__hits.n_hit") == 0).select(*docs.columns)
