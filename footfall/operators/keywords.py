"""Place keywords from the tags of grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.operators.curves import elbow, histogram, with_positions
from footfall.operators.joins import HOT_ROWS, hot_keys, lookup_join, salted_join
from footfall.operators.text import (
    CELL,
    cell_bag,
    cell_count,
    cell_term_frequency,
    document_frequency,
    idf,
    tf_histogram,
    top_n_per_cell,
)
from footfall.session import stage


def term_idf_join(tf: DataFrame, idf_table: DataFrame) -> DataFrame:
    """Attach the weight of each term; terms without one are dropped."""
    return lookup_join(tf, idf_table.select("term", "idf"), ["term"], CELL)


def scored(tf: DataFrame, idf_table: DataFrame) -> DataFrame:
    """Score ``(1 + ln tf) * idf`` per cell and term."""
    return term_idf_join(tf, idf_table).select(
        *CELL, "term", "tf", ((1 + F.log("tf")) * F.col("idf")).alias("score")
    )


def global_elbow(tf: DataFrame) -> DataFrame:
    """One row: the elbow of all term counts as the integer ``cut``.

    A count of v needs v tag occurrences, so T occurrences have at most
    sqrt(2 T) distinct counts and the histogram stays small.
    """
    curve = tf_histogram(tf).withColumn("curve", F.lit(0))
    return elbow(curve, ["curve"], "tf", short="error", rows=0).select(F.col("y").cast("bigint").alias("cut"))


def local_elbow(scores: DataFrame) -> DataFrame:
    """Terms at or above the elbow of the scores of their cell (``scores`` is staged).

    Cells with fewer than three terms keep them all.
    """
    curve = histogram(scores, CELL, "score")
    cuts = elbow(curve, CELL, "score", rows=scores.count()).select(*CELL, F.col("y").alias("cut"))
    return lookup_join(scores, cuts, CELL, ["term"]).filter(F.col("score") >= F.col("cut")).drop("cut")


def _staged_bag(posts: DataFrame, size_m: float, ref_lat: float | None) -> DataFrame:
    return stage(cell_bag(posts, size_m, ref_lat), "bag")


def lcurve_scores(posts: DataFrame, stop_words: DataFrame, size_m: float = 200, ref_lat: float | None = None) -> DataFrame:
    """Terms above the global and the local elbow: ``cell_y, cell_x, term, tf, score``."""
    bag = _staged_bag(posts, size_m, ref_lat)
    tf = stage(cell_term_frequency(bag, stop_words), "counts")
    weights = idf(document_frequency(tf), cell_count(bag), "lcurve")
    frequent = tf.filter(F.col("tf") > global_elbow(tf).scalar())
    return local_elbow(stage(scored(frequent, weights), "scores"))


def keywords_lcurve(posts: DataFrame, stop_words: DataFrame, size_m: float = 200, ref_lat: float | None = None) -> DataFrame:
    """Keywords by the two elbow cuts, with the number of cells that name them: ``term, cells``."""
    return lcurve_scores(posts, stop_words, size_m, ref_lat).groupBy("term").agg(F.count(F.lit(1)).alias("cells"))


def tfidf_topn_scores(
    posts: DataFrame, stop_words: DataFrame, size_m: float = 200, min_count: int = 100, top_n: int = 10, ref_lat: float | None = None
) -> DataFrame:
    """The best terms of each cell among those that occur at least ``min_count`` times in it."""
    bag = _staged_bag(posts, size_m, ref_lat)
    tf = stage(cell_term_frequency(bag, stop_words), "counts")
    weights = idf(document_frequency(tf), cell_count(bag), "topn")
    return top_n_per_cell(scored(tf.filter(F.col("tf") >= min_count), weights), top_n)


def keywords_tfidf_topn(
    posts: DataFrame, stop_words: DataFrame, size_m: float = 200, min_count: int = 100, top_n: int = 10, ref_lat: float | None = None
) -> DataFrame:
    """Keywords by score rank: ``term, cells``."""
    best = tfidf_topn_scores(posts, stop_words, size_m, min_count, top_n, ref_lat)
    return best.groupBy("term").agg(F.count(F.lit(1)).alias("cells"))


def ranked_keywords(scores: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """All terms of a cell by descending score, ties by term, as ``rank`` from 1.

    A cell too full for one task is ranked in blocks of equal work: the terms with
    a higher score come from the curve, those with the same score from a window.
    """
    order = Window.partitionBy(*CELL).orderBy(F.col("score").desc(), "term")
    if hot_keys(scores, CELL, hot_rows=hot_rows) is None:
        return scores.withColumn("rank", F.row_number().over(order))
    curve = with_positions(histogram(scores, CELL, "score"), CELL, "score", hot_rows=hot_rows)
    ties = Window.partitionBy(*CELL, "score").orderBy("term")
    return (
        salted_join(scores, curve.select(*CELL, "score", "start"), [*CELL, "score"], ["term"], hot_rows=hot_rows)
        .withColumn("rank", (F.col("start") + F.row_number().over(ties)).cast("int"))
        .drop("start")
    )
