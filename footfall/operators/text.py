"""Tags per grid cell: bags, document frequency and term weights.

A merged tag list is held as counted rows ``cell_y, cell_x, tag, n`` rather than
as an array: one busy cell then stays spread over many rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.grid import cell_centre, with_cell
from footfall.functions.tags import is_not_builtin_stop, is_plain_word
from footfall.operators.joins import lookup_join

CELL = ["cell_y", "cell_x"]


def explode_tags(posts: DataFrame) -> DataFrame:
    """One row per post and tag position; repeated tags stay repeated."""
    return posts.select("*", F.posexplode("tags").alias("pos", "tag")).drop("tags")


def without_terms(rows: DataFrame, stop_words: DataFrame, column: str = "tag") -> DataFrame:
    """Drop the rows whose ``column`` is a stop word.

    The planner broadcasts the stop words when their size allows, and splits a
    skewed left side when it does not.
    """
    return rows.join(stop_words.select(F.col("term").alias(column)), column, "left_anti")


def term_filter(rows: DataFrame, stop_words: DataFrame, column: str = "tag") -> DataFrame:
    """Keep plain words that are no stop words."""
    return without_terms(rows.filter(is_plain_word(F.col(column))), stop_words, column)


def prune_stop_terms(posts: DataFrame) -> DataFrame:
    """Remove the built-in stop words, and tags that contain a stop fragment."""
    return posts.withColumn("tags", F.filter("tags", lambda tag: is_not_builtin_stop(tag)))


def cell_bag(posts: DataFrame, size_m: float = 200, ref_lat: float | None = None) -> DataFrame:
    """Counted tags per cell: ``cell_y, cell_x, tag, n``. All later steps derive from it."""
    placed = with_cell(posts, size_m, ref_lat).select(*CELL, F.explode("tags").alias("tag"))
    return placed.groupBy(*CELL, "tag").agg(F.count(F.lit(1)).alias("n"))


def merge_lists(posts: DataFrame, size_m: float = 200) -> DataFrame:
    """Tag lists of each cell joined end to end after :func:`prune_stop_terms`, as a bag."""
    return cell_bag(prune_stop_terms(posts), size_m)


def distinct_merge_lists(posts: DataFrame, size_m: float = 200) -> DataFrame:
    """Union of the tag lists of each cell, as one row per cell and tag."""
    return with_cell(posts, size_m).select(*CELL, F.explode("tags").alias("tag")).distinct()


def cell_tags(posts: DataFrame, size_m: float = 200, ref_lat: float | None = None) -> DataFrame:
    """Merged tags under the centre of each cell: ``key_latitude, key_longitude, tag, n``."""
    lat, lon = cell_centre(size_m, ref_lat)
    bag = cell_bag(prune_stop_terms(posts), size_m, ref_lat)
    return bag.select(lat.alias("key_latitude"), lon.alias("key_longitude"), "tag", "n")


def cell_distinct_tags(bag: DataFrame) -> DataFrame:
    """Distinct raw tags per cell."""
    return bag.select(*CELL, "tag")


def cell_count(bag: DataFrame) -> DataFrame:
    """One row: the number ``n_cells`` of cells with a tag."""
    return bag.select(*CELL).distinct().agg(F.count(F.lit(1)).alias("n_cells"))


def cell_term_frequency(bag: DataFrame, stop_words: DataFrame) -> DataFrame:
    """Occurrences of each term per cell: ``cell_y, cell_x, term, tf``."""
    kept = term_filter(bag, stop_words)
    return kept.select(*CELL, F.col("tag").alias("term"), F.col("n").alias("tf"))


def document_frequency(tf: DataFrame) -> DataFrame:
    """Number of cells per term: ``term, df``."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(df_table: DataFrame, n_cells: DataFrame, rule: str = "lcurve") -> DataFrame:
    """ln(N / df) per term.

    ``lcurve`` keeps terms in more than two cells. ``topn`` keeps terms whose
    *idf* lies in [2, 10]; the bounds are the established ones, although they
    read like document frequencies.
    """
    weighted = df_table.withColumn("idf", F.log(n_cells.scalar() / F.col("df")))
    if rule == "lcurve":
        return weighted.filter(F.col("df") > 2)
    if rule == "topn":
        return weighted.filter(F.col("idf").between(2, 10))
    raise ValueError(f"unknown rule {rule}")


def doc_raw_tf(merged: DataFrame, stop_words: DataFrame) -> DataFrame:
    """Term counts of merged cells, filtered by stop words only."""
    return without_terms(merged, stop_words)


def doc_presence(merged: DataFrame, stop_words: DataFrame) -> DataFrame:
    """One per term of each merged cell, filtered by stop words only."""
    return without_terms(merged, stop_words).withColumn("n", F.lit(1))


def log_tf(tf: DataFrame) -> DataFrame:
    """Add ``log_tf = 1 + ln(tf)``."""
    return tf.withColumn("log_tf", 1 + F.log("tf"))


def relative_tf(tf: DataFrame) -> DataFrame:
    """Add ``relative_tf``, the share of the term in its cell."""
    totals = tf.groupBy(*CELL).agg(F.sum("tf").alias("_total"))
    whole = lookup_join(tf, totals, CELL, ["term"])
    return whole.withColumn("relative_tf", F.col("tf") / F.col("_total")).drop("_total")


def tf_histogram(tf: DataFrame) -> DataFrame:
    """How often each count occurs over all cells and terms: ``tf, n``."""
    return tf.groupBy("tf").agg(F.count(F.lit(1)).alias("n"))


def top_n_per_cell(scored: DataFrame, n: int) -> DataFrame:
    """Best ``n`` terms of each cell by score, ties by term.

    The planner cuts to ``n`` before the shuffle, so a busy cell stays cheap.
    """
    order = Window.partitionBy(*CELL).orderBy(F.col("score").desc(), "term")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
