"""The composed jobs: posts to keywords, regions and mobility rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from footfall.operators.keywords import keywords_lcurve
from footfall.operators.patterns import (
    MAX_LENGTH,
    MIN_SUPPORT,
    SEQUENCE_CONFIDENCE,
    SET_CONFIDENCE,
    frequent_sequences,
    itemsets_and_rules,
    sequence_rules,
)
from footfall.operators.regions import extract_rois
from footfall.operators.trajectories import rejected_dates, transactions, user_day_places, user_day_sequences, visits
from footfall.session import stage
from footfall.sources.kml import read_roi_kml
from footfall.sources.posts import read_posts, read_terms


def pipeline(
    posts: DataFrame,
    keywords: DataFrame | None = None,
    stop_words: DataFrame | None = None,
    rois: DataFrame | None = None,
    size_m: float = 200,
    cap: int | None = None,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = SET_CONFIDENCE,
    ref_lat: float | None = None,
    **region_options,
) -> dict[str, DataFrame]:
    """Keywords, regions, frequent place sets and rules of ``posts``, and the posts
    ``rejected`` because their date does not parse.

    Given ``keywords`` or ``rois`` replace the steps that would compute them.
    ``ref_lat`` is the latitude that the keyword grid fits; ``region_options`` are those
    of :func:`extract_rois` (``neighbours``, ``threshold``, ``min_pts``, ``minimum``).
    The posts are read up to three times: pass a written table if they are costly.
    """
    if rois is None:
        if keywords is None:
            if stop_words is None:
                raise ValueError("computing keywords needs a table of stop words")
            keywords = stage(keywords_lcurve(posts, stop_words, size_m, ref_lat), "keywords")
        rois = stage(extract_rois(posts, keywords, cap, **region_options), "rois")
    baskets = stage(transactions(user_day_places(visits(posts, rois))), "baskets")
    itemsets, rules = itemsets_and_rules(baskets, min_support, min_confidence)
    tables = {"rois": rois, "itemsets": itemsets, "rules": rules, "rejected": rejected_dates(posts)}
    return tables if keywords is None else {"keywords": keywords, **tables}


def mobility_job(
    spark: SparkSession,
    dataset_path: str,
    keywords_path: str | None = None,
    stop_words_path: str | None = None,
    rois_path: str | None = None,
    bounds: tuple[float, float, float, float] | None = None,
    **options,
) -> dict[str, DataFrame]:
    """:func:`pipeline` over files: posts by extension, word lists as text, regions as KML.

    The steps read the posts up to three times, so JSON is parsed once and continued
    from columnar form.
    """
    posts = read_posts(spark, dataset_path, bounds)
    if not rois_path and dataset_path.rstrip("/").lower().endswith("json"):
        posts = stage(posts, "posts")
    return pipeline(
        posts,
        keywords=read_terms(spark, keywords_path) if keywords_path else None,
        stop_words=read_terms(spark, stop_words_path) if stop_words_path else None,
        rois=read_roi_kml(spark, rois_path) if rois_path else None,
        **options,
    )


def roi_job(
    spark: SparkSession,
    dataset_path: str,
    keywords_path: str,
    cap: int | None = None,
    bounds: tuple[float, float, float, float] | None = None,
    **region_options,
) -> DataFrame:
    """Regions ``poi, ring`` of the keywords of a file; options as in :func:`extract_rois`."""
    return extract_rois(read_posts(spark, dataset_path, bounds), read_terms(spark, keywords_path), cap, **region_options)


def trajectory_rules(
    posts: DataFrame,
    rois: DataFrame,
    min_support: float = MIN_SUPPORT,
    max_length: int = MAX_LENGTH,
    sequence_confidence: float = SEQUENCE_CONFIDENCE,
    set_confidence: float = SET_CONFIDENCE,
) -> dict[str, DataFrame]:
    """Frequent sequences and sets of the given regions, with their rules."""
    visit_rows = stage(visits(posts, rois), "visits")
    sequences = stage(user_day_sequences(visit_rows), "sequences")
    baskets = stage(transactions(user_day_places(visit_rows)), "baskets")
    patterns = stage(frequent_sequences(sequences, min_support, max_length), "patterns")
    itemsets, rules = itemsets_and_rules(baskets, min_support, set_confidence)
    return {
        "sequences": patterns,
        "sequence_rules": sequence_rules(patterns, sequence_confidence),
        "itemsets": itemsets,
        "rules": rules,
        "rejected": rejected_dates(posts),
    }


def trajectory_job(
    spark: SparkSession, dataset_path: str, rois_path: str, bounds: tuple[float, float, float, float] | None = None, **options
) -> dict[str, DataFrame]:
    """:func:`trajectory_rules` over files: posts by extension, regions as KML."""
    return trajectory_rules(read_posts(spark, dataset_path, bounds), read_roi_kml(spark, rois_path), **options)
