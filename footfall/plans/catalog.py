"""One query per operator over the derived posts, as ``(spark, sf_dir) -> DataFrame``.

Arrays are joined to text and metres and scores are rounded, so that results can
be compared across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.geo import (
    degree_to_km,
    degree_to_m,
    distance_m,
    m_to_degree,
    planar_area,
    ring_box,
    rectangle,
)
from footfall.functions.grid import cell_centre, with_cell
from footfall.operators import (
    cluster,
    curves,
    keywords,
    knn,
    patterns,
    points,
    radius,
    regions,
    spatial,
    text,
    trajectories,
)
from footfall.plans import jobs
from footfall.session import stage, stage_path
from footfall.sources import derived, kml
from footfall.sources import posts as sources

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CELL = text.CELL
PLACE = points.PLACE


def query(function: Query) -> Query:
    """Register a query under the name of its function."""
    QUERIES[function.__name__] = function
    return function


def _stop(spark: SparkSession) -> DataFrame:
    return derived.terms(spark, derived.STOP_WORDS)


def _keywords(spark: SparkSession, *more: str) -> DataFrame:
    return derived.terms(spark, [*derived.PLACES, *more])


def _r(name: str | Column, digits: int, alias: str | None = None) -> Column:
    column = F.col(name) if isinstance(name, str) else name
    return F.round(column, digits).alias(alias or name)


def _joined(name: str, separator: str = ",") -> Column:
    return F.array_join(name, separator).alias(name)


def _post_rows(posts: DataFrame) -> DataFrame:
    return posts.select(
        "username",
        "latitude",
        "longitude",
        "date_posted",
        F.size("tags").cast("bigint").alias("n_tags"),
        F.array_join("tags", "|").alias("tags"),
    )


# Sources and sinks: derived posts are written out and read back.


def _json_copy(spark: SparkSession, sf_dir: str, wrapped: bool, name: str = "posts.json") -> str:
    path = f"{stage_path(spark, 'files')}/{name}"
    sources.write_posts_json(derived.derive_posts(spark, sf_dir), path, wrapped)
    return path


@query
def read_posts_json(spark, sf_dir):
    return _post_rows(sources.read_posts_json(spark, _json_copy(spark, sf_dir, wrapped=False)))


@query
def read_posts_parquet(spark, sf_dir):
    path = f"{stage_path(spark, 'files')}/posts.parquet"
    sources.write_posts_parquet(derived.derive_posts(spark, sf_dir), path)
    return _post_rows(sources.read_posts_parquet(spark, path))


@query
def read_posts(spark, sf_dir):
    return _post_rows(sources.read_posts(spark, _json_copy(spark, sf_dir, wrapped=True, name="posts.JSON")))


@query
def json_to_parquet(spark, sf_dir):
    target = f"{stage_path(spark, 'files')}/posts.parquet"
    sources.json_to_parquet(spark, _json_copy(spark, sf_dir, wrapped=True), target)
    return _post_rows(sources.read_posts(spark, target))


@query
def read_terms(spark, sf_dir):
    path = f"{stage_path(spark, 'files')}/terms.txt"
    text.explode_tags(derived.posts(spark, sf_dir)).select("tag").write.text(path)
    return sources.read_terms(spark, path)


def _place_boxes(spark: SparkSession, sf_dir: str, with_tag: str | None = None) -> DataFrame:
    """Bounding rectangle of the posts of each place: ``poi, ring``."""
    posts = derived.posts(spark, sf_dir)
    if with_tag:
        posts = posts.filter(F.array_contains("tags", with_tag))
    boxes = points.keyword_points(posts, _keywords(spark)).groupBy("term").agg(
        F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1")
    )
    ring = rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return stage(boxes.select(F.col("term").alias("poi"), ring.alias("ring")), "boxes")


def _ring_rows(rois: DataFrame) -> DataFrame:
    box = rois.withColumn("box", ring_box(F.col("ring")))
    return box.select(
        "poi",
        F.size("ring").cast("bigint").alias("vertices"),
        *[F.col(f"box.{c}").alias(c) for c in ("lon_lo", "lon_hi", "lat_lo", "lat_hi")],
    )


@query
def read_roi_kml(spark, sf_dir):
    path = stage_path(spark, "kml")
    kml.write_roi_kml(_place_boxes(spark, sf_dir), path, document=True)
    return _ring_rows(kml.read_roi_kml(spark, path))


@query
def write_roi_kml(spark, sf_dir):
    path = stage_path(spark, "kml")
    boxes = _place_boxes(spark, sf_dir).withColumn("color", F.lit("ff0000ff"))
    kml.write_roi_kml(boxes, path, attributes=["color"])
    return spark.read.text(path).withColumnRenamed("value", "kml")


@query
def write_points_kml(spark, sf_dir):
    path, corner = stage_path(spark, "kml"), F.col("ring")[0]
    corners = _place_boxes(spark, sf_dir).select("poi", corner["lon"].alias("lon"), corner["lat"].alias("lat"))
    kml.write_points_kml(corners, path)
    return spark.read.text(path).withColumnRenamed("value", "kml")


@query
def write_results(spark, sf_dir):
    path = stage_path(spark, "results")
    sources.write_results({"keywords": keywords_lcurve(spark, sf_dir)}, path)
    return spark.read.parquet(f"{path}/keywords")


# Projections and filters.


@query
def normalise_posts(spark, sf_dir):
    raw = spark.read.schema(sources.RAW_SCHEMA).json(_json_copy(spark, sf_dir, wrapped=True))
    return _post_rows(sources.normalise_posts(raw))


@query
def valid_posts(spark, sf_dir):
    return derived.posts(spark, sf_dir).select("post_id", "latitude", "longitude", "username")


@query
def term_filter(spark, sf_dir):
    rows = text.explode_tags(derived.posts(spark, sf_dir)).select("post_id", "pos", "tag")
    return text.term_filter(rows, _stop(spark)).select("post_id", "pos", "tag")


@query
def explode_tags(spark, sf_dir):
    return text.explode_tags(derived.posts(spark, sf_dir)).select("post_id", "pos", "tag")


@query
def keyword_points(spark, sf_dir):
    return points.keyword_points(derived.posts(spark, sf_dir), _keywords(spark)).select(*PLACE, "post_id", "pos")


@query
def stop_term_prune(spark, sf_dir):
    return text.prune_stop_terms(derived.posts(spark, sf_dir)).select("post_id", _joined("tags", "|"))


@query
def min_points(spark, sf_dir):
    posts = derived.posts(spark, sf_dir)
    every_tag = posts.select(F.explode("tags").alias("term")).distinct()
    found = stage(points.keyword_points(posts, every_tag), "points")
    return points.min_points(found).select("term", "post_id", "pos")


# Grid and tag statistics.


@query
def grid_cell(spark, sf_dir):
    lat, lon = cell_centre()
    return with_cell(derived.posts(spark, sf_dir)).select(
        "post_id", *CELL, _r(lat, 9, "key_latitude"), _r(lon, 9, "key_longitude")
    )


@query
def cell_tags(spark, sf_dir):
    merged = text.cell_tags(derived.posts(spark, sf_dir))
    return merged.select(_r("key_latitude", 9), _r("key_longitude", 9), "tag", "n")


@query
def merge_lists(spark, sf_dir):
    return text.merge_lists(derived.posts(spark, sf_dir))


@query
def distinct_merge_lists(spark, sf_dir):
    return text.distinct_merge_lists(derived.posts(spark, sf_dir))


def _bag(spark, sf_dir):
    return text.cell_bag(derived.posts(spark, sf_dir))


def _tf(spark, sf_dir):
    return text.cell_term_frequency(_bag(spark, sf_dir), _stop(spark))


@query
def cell_distinct_tags(spark, sf_dir):
    return text.cell_distinct_tags(_bag(spark, sf_dir))


@query
def cell_count(spark, sf_dir):
    return text.cell_count(_bag(spark, sf_dir))


@query
def document_frequency(spark, sf_dir):
    return text.document_frequency(_tf(spark, sf_dir))


def _idf(spark, sf_dir, rule):
    bag = stage(_bag(spark, sf_dir), "bag")
    tf = text.cell_term_frequency(bag, _stop(spark))
    return tf, text.idf(text.document_frequency(tf), text.cell_count(bag), rule)


@query
def idf(spark, sf_dir):
    return _idf(spark, sf_dir, "lcurve")[1].select("term", "df", _r("idf", 9))


@query
def idf_topn(spark, sf_dir):
    return _idf(spark, sf_dir, "topn")[1].select("term", "df", _r("idf", 9))


@query
def cell_term_frequency(spark, sf_dir):
    return _tf(spark, sf_dir)


@query
def doc_raw_tf(spark, sf_dir):
    return text.doc_raw_tf(text.merge_lists(derived.posts(spark, sf_dir)), _stop(spark)).select(*CELL, "tag", "n")


@query
def doc_presence(spark, sf_dir):
    return text.doc_presence(text.merge_lists(derived.posts(spark, sf_dir)), _stop(spark)).select(*CELL, "tag", "n")


@query
def log_tf(spark, sf_dir):
    return text.log_tf(_tf(spark, sf_dir)).select(*CELL, "term", "tf", _r("log_tf", 9))


@query
def relative_tf(spark, sf_dir):
    return text.relative_tf(_tf(spark, sf_dir)).select(*CELL, "term", "tf", _r("relative_tf", 9))


@query
def tf_histogram(spark, sf_dir):
    return text.tf_histogram(_tf(spark, sf_dir))


# Elbows and keywords.


@query
def elbow(spark, sf_dir):
    counts = derived.posts(spark, sf_dir).select(F.explode("tags").alias("tag")).groupBy("tag").count()
    curve = curves.histogram(counts.withColumn("curve", F.lit("tags")), ["curve"], "count")
    return curves.elbow(curve, ["curve"], "count", short="error").select("curve", "i", _r("d", 9), "x", "y")


@query
def global_elbow(spark, sf_dir):
    return keywords.global_elbow(stage(_tf(spark, sf_dir), "tf"))


def _scores(spark, sf_dir):
    return keywords.lcurve_scores(derived.posts(spark, sf_dir), _stop(spark))


@query
def local_elbow(spark, sf_dir):
    return _scores(spark, sf_dir).select(*CELL, "term", "tf", _r("score", 9))


@query
def keywords_lcurve(spark, sf_dir):
    return keywords.keywords_lcurve(derived.posts(spark, sf_dir), _stop(spark))


@query
def keywords_tfidf_topn(spark, sf_dir):
    return keywords.keywords_tfidf_topn(derived.posts(spark, sf_dir), _stop(spark))


@query
def ranked_keywords(spark, sf_dir):
    ranked = keywords.ranked_keywords(stage(_scores(spark, sf_dir), "scores"))
    return ranked.select(*CELL, "term", _r("score", 9), "rank")


@query
def term_idf_join(spark, sf_dir):
    tf, weights = _idf(spark, sf_dir, "lcurve")
    return keywords.term_idf_join(tf, weights).select(*CELL, "term", "tf", _r("idf", 9))


# Distances and radii.


@query
def pair_distance(spark, sf_dir):
    lat, lon = cell_centre()
    d = distance_m(F.col("latitude"), F.col("longitude"), lat, lon)
    return with_cell(derived.posts(spark, sf_dir)).select("post_id", _r(d, 3, "metres"))


@query
def degree_metric(spark, sf_dir):
    lat, lon = F.col("latitude"), F.col("longitude")
    return derived.posts(spark, sf_dir).select(
        "post_id",
        _r(degree_to_km(lat), 6, "lat_km"),
        _r(degree_to_m(lon), 3, "lon_m"),
        _r(m_to_degree(lat * 1000.0), 9, "degrees"),
    )


def _locations(spark, sf_dir):
    found = points.keyword_points(derived.posts(spark, sf_dir), _keywords(spark))
    return stage(points.weighted_locations(found), "locations")


@query
def knn_distance(spark, sf_dir):
    return knn.knn_distance(_locations(spark, sf_dir)).select(*PLACE, "w", _r("dist", 3))


def _curve(spark, sf_dir):
    return stage(knn.distance_curve(knn.knn_distance(_locations(spark, sf_dir))), "curve")


@query
def eps_threshold(spark, sf_dir):
    return radius.eps_threshold(_curve(spark, sf_dir)).select("term", _r("eps", 3))


@query
def eps_elbow(spark, sf_dir):
    return radius.eps_elbow(_curve(spark, sf_dir)).select("term", _r("eps", 3))


@query
def eps_percentile(spark, sf_dir):
    return radius.eps_percentile(_curve(spark, sf_dir), 0.3).select("term", _r("eps", 3))


@query
def eps_threshold_coarse(spark, sf_dir):
    return radius.eps_threshold_coarse(_curve(spark, sf_dir)).select("term", _r("eps", 3))


@query
def eps_bootstrap(spark, sf_dir):
    return radius.eps_bootstrap(_curve(spark, sf_dir), repetitions=9, samples=200).select("term", _r("eps", 3))


@query
def elbow_min_gap(spark, sf_dir):
    knees = radius.elbow_min_gap(_curve(spark, sf_dir))
    return knees.select("term", "i", _r("d", 9), _r("eps", 3))


# Clusters and regions.


@query
def cap_points(spark, sf_dir):
    found = points.keyword_points(derived.posts(spark, sf_dir), _keywords(spark, "rome"))
    return points.cap_points(stage(found, "points"), 5000).select("term", "post_id", "pos")


def _eps(spark, locations):
    return stage(radius.eps_threshold(knn.distance_curve(knn.knn_distance(locations))), "eps")


@query
def eps_neighbours(spark, sf_dir):
    locations = _locations(spark, sf_dir)
    return cluster.eps_neighbours(locations, _eps(spark, locations))


@query
def core_points(spark, sf_dir):
    locations = _locations(spark, sf_dir)
    return cluster.core_points(locations, _eps(spark, locations)).select(*PLACE, "core")


def _clusters(spark, sf_dir):
    locations = _locations(spark, sf_dir)
    return cluster.dbscan(locations, _eps(spark, locations))


@query
def dbscan(spark, sf_dir):
    return _clusters(spark, sf_dir).select(
        *PLACE, "core", F.col("label.lat").alias("label_lat"), F.col("label.lon").alias("label_lon")
    )


@query
def largest_cluster(spark, sf_dir):
    return cluster.largest_cluster(_clusters(spark, sf_dir)).select(
        "term", F.col("label.lat").alias("label_lat"), F.col("label.lon").alias("label_lon"), "places"
    )


def _area(rings: DataFrame, name: str) -> DataFrame:
    return rings.select(name, _r(planar_area(F.col("ring")) * 1000000.0, 6, "micro_square_degrees"))


@query
def convex_hull(spark, sf_dir):
    return _area(regions.convex_hull(_locations(spark, sf_dir)), "term")


@query
def hull_close_ring(spark, sf_dir):
    boxes = _place_boxes(spark, sf_dir)
    opened = boxes.withColumn("ring", F.slice("ring", 1, F.size("ring") - 1))
    return _ring_rows(regions.hull_close_ring(opened))


@query
def extract_rois(spark, sf_dir):
    return _area(regions.extract_rois(derived.posts(spark, sf_dir), _keywords(spark)), "poi")


@query
def extract_rois_uncapped(spark, sf_dir):
    return _area(regions.extract_rois(derived.posts(spark, sf_dir), _keywords(spark), cap=None), "poi")


def _vertices(rings: DataFrame, name: str) -> DataFrame:
    """One row per corner of each closed ring."""
    corners = rings.select(name, F.explode(F.slice("ring", 2, F.size("ring") - 1)).alias("v"))
    return corners.select(name, _r(F.col("v.lon"), 9, "lon"), _r(F.col("v.lat"), 9, "lat"))


@query
def convex_hull_vertices(spark, sf_dir):
    return _vertices(regions.convex_hull(_locations(spark, sf_dir)), "term")


@query
def extract_rois_vertices(spark, sf_dir):
    return _vertices(regions.extract_rois(derived.posts(spark, sf_dir), _keywords(spark)), "poi")


# Spatial joins.


@query
def point_in_roi(spark, sf_dir):
    hits = spatial.point_in_roi(derived.posts(spark, sf_dir), derived.place_regions(spark))
    return hits.select("post_id", "poi")


@query
def roi_within_roi(spark, sf_dir):
    return spatial.roi_within_roi(_place_boxes(spark, sf_dir, "foto"), _place_boxes(spark, sf_dir))


@query
def roi_overlap(spark, sf_dir):
    shared = spatial.roi_overlap(_place_boxes(spark, sf_dir, "foto"), _place_boxes(spark, sf_dir))
    return shared.select("poi", "other_poi", _r(F.col("area") * 1000000.0, 6, "micro_square_degrees"))


def _ells(boxes: DataFrame) -> DataFrame:
    """L-shaped regions: the boxes without their north-eastern quarter."""
    corner = {"x0": F.col("ring")[0]["lon"], "y0": F.col("ring")[0]["lat"], "x1": F.col("ring")[2]["lon"], "y1": F.col("ring")[2]["lat"]}
    cut = boxes.select("poi", *[c.alias(n) for n, c in corner.items()]).selectExpr("*", "(x0 + x1) / 2 AS xm", "(y0 + y1) / 2 AS ym")
    corners = [("x0", "y0"), ("x1", "y0"), ("x1", "ym"), ("xm", "ym"), ("xm", "y1"), ("x0", "y1"), ("x0", "y0")]
    ring = F.array(*[F.struct(F.col(x).alias("lon"), F.col(y).alias("lat")) for x, y in corners])
    return cut.select("poi", ring.alias("ring"))


@query
def roi_within_concave(spark, sf_dir):
    return spatial.roi_within_roi(_place_boxes(spark, sf_dir, "foto"), _ells(_place_boxes(spark, sf_dir)))


@query
def roi_overlap_concave(spark, sf_dir):
    shared = spatial.roi_overlap(_ells(_place_boxes(spark, sf_dir, "foto")), _ells(_place_boxes(spark, sf_dir)))
    area = _r(F.col("area") * 1000000.0, 6, "micro_square_degrees")
    return shared.select("poi", "other_poi", area).filter("micro_square_degrees > 0")


@query
def roi_quality_concave(spark, sf_dir):
    return _quality_rows(spatial.roi_quality(_place_boxes(spark, sf_dir), _ells(_place_boxes(spark, sf_dir, "foto"))))


@query
def within_radius(spark, sf_dir):
    corner = F.col("ring")[0]
    centres = derived.place_regions(spark).select(F.col("poi").alias("name"), corner["lon"].alias("lon"), corner["lat"].alias("lat"))
    return spatial.within_radius(derived.posts(spark, sf_dir), centres, 150.0).select("post_id", "name", _r("dist", 3))


@query
def bbox_filter(spark, sf_dir):
    return spatial.bbox_filter(derived.posts(spark, sf_dir), 41.88, 12.46, 41.9, 12.48).select("post_id")


@query
def bbox_filter_stored(spark, sf_dir):
    """The same box over stored posts, whose layout lets the scan pass over the rest."""
    path = f"{stage_path(spark, 'files')}/posts.parquet"
    sources.write_posts_parquet(derived.derive_posts(spark, sf_dir), path)
    return _post_rows(spatial.bbox_filter(sources.read_posts_parquet(spark, path), 41.88, 12.46, 41.9, 12.48))


@query
def roi_area(spark, sf_dir):
    boxes = _place_boxes(spark, sf_dir)
    planar = spatial.roi_area(boxes, planar=True).withColumnRenamed("area_km2", "planar_km2")
    both = spatial.roi_area(boxes).join(planar, "poi")
    return both.select("poi", _r("area_km2", 6), _r("planar_km2", 6))


def _quality_rows(quality: DataFrame) -> DataFrame:
    areas = [_r(F.col(c) * 1000000.0, 5, c) for c in ("tp", "fp", "fn")]
    return quality.select("poi", "matched", *areas, *[_r(c, 5) for c in ("precision", "recall", "f1")])


@query
def roi_quality(spark, sf_dir):
    return _quality_rows(spatial.roi_quality(_place_boxes(spark, sf_dir), _place_boxes(spark, sf_dir, "foto")))


@query
def roi_quality_extracted(spark, sf_dir):
    found = regions.extract_rois(derived.posts(spark, sf_dir), _keywords(spark))
    return _quality_rows(spatial.roi_quality(derived.place_regions(spark), found))


# Trajectories and patterns.


def _visits(spark, sf_dir):
    return trajectories.visits(derived.posts(spark, sf_dir), derived.place_regions(spark))


@query
def visits(spark, sf_dir):
    return _visits(spark, sf_dir).select(
        "username", F.col("day").cast("string").alias("day"), "poi", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts")
    )


@query
def user_day_places(spark, sf_dir):
    days = trajectories.user_day_places(_visits(spark, sf_dir))
    return days.select("username", F.col("day").cast("string").alias("day"), _joined("places"))


def _baskets(spark, sf_dir):
    return trajectories.transactions(trajectories.user_day_places(_visits(spark, sf_dir)))


@query
def transactions(spark, sf_dir):
    return _baskets(spark, sf_dir).select(_joined("items"))


@query
def frequent_itemsets(spark, sf_dir):
    found = patterns.frequent_itemsets(stage(_baskets(spark, sf_dir), "baskets"))
    return found.select(_joined("items"), "freq")


def _rule_rows(rules: DataFrame, *measures: str) -> DataFrame:
    return rules.select(_joined("antecedent"), _joined("consequent"), *[_r(m, 6) for m in measures])


@query
def association_rules(spark, sf_dir):
    rules = patterns.association_rules(stage(_baskets(spark, sf_dir), "baskets"))
    return _rule_rows(rules, "confidence", "lift", "support")


@query
def encode_places(spark, sf_dir):
    return trajectories.encode_places(_place_boxes(spark, sf_dir))


def _sequences(spark, sf_dir):
    return stage(trajectories.user_day_sequences(_visits(spark, sf_dir)), "sequences")


@query
def user_day_sequences(spark, sf_dir):
    days = _sequences(spark, sf_dir)
    return days.select(
        "username", F.col("day").cast("string").alias("day"), F.array_join(F.flatten("sequence"), ">").alias("sequence")
    )


@query
def frequent_sequences(spark, sf_dir):
    return patterns.frequent_sequences(_sequences(spark, sf_dir)).select(_joined("items", ">"), "freq")


def _sequence_rule_rows(rules: DataFrame) -> DataFrame:
    return rules.select(_joined("antecedent", ">"), _joined("consequent"), _r("confidence", 6))


@query
def sequence_rules(spark, sf_dir):
    found = stage(patterns.frequent_sequences(_sequences(spark, sf_dir)), "patterns")
    return _sequence_rule_rows(patterns.sequence_rules(found))


# Jobs.


@query
def mobility_pipeline(spark, sf_dir):
    tables = jobs.pipeline(stage(derived.posts(spark, sf_dir), "posts"), stop_words=_stop(spark))
    return _rule_rows(tables["rules"], "confidence", "lift", "support")


def _named_rows(table: str, rows: DataFrame, name, value) -> DataFrame:
    return rows.select(F.lit(table).alias("table_name"), name.alias("name"), F.round(value.cast("double"), 6).alias("value"))


def _set_rows(tables: dict[str, DataFrame]) -> DataFrame:
    arrow = F.concat_ws("=>", F.array_join("antecedent", ","), F.array_join("consequent", ","))
    sets = _named_rows("itemsets", tables["itemsets"], F.array_join("items", ","), F.col("freq"))
    return sets.unionByName(_named_rows("rules", tables["rules"], arrow, F.col("confidence")))


@query
def mobility_tables(spark, sf_dir):
    """All tables of the pipeline, written as results and read back."""
    path = stage_path(spark, "results")
    posts = stage(derived.posts(spark, sf_dir), "posts")
    sources.write_results(jobs.pipeline(posts, stop_words=_stop(spark)), path)
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("keywords", "rois", "itemsets", "rules", "rejected")}
    rows = _named_rows("keywords", tables["keywords"], F.col("term"), F.col("cells"))
    rows = rows.unionByName(_named_rows("rois", tables["rois"], F.col("poi"), F.size("ring") - 1)).unionByName(_set_rows(tables))
    rejected = tables["rejected"].agg(F.count(F.lit(1)).alias("n"))
    return rows.unionByName(_named_rows("rejected", rejected, F.lit("posts"), F.col("n")))


@query
def roi_job(spark, sf_dir):
    path = f"{stage_path(spark, 'files')}/keywords.txt"
    _keywords(spark).write.text(path)
    return _area(jobs.roi_job(spark, _json_copy(spark, sf_dir, wrapped=False), path), "poi")


@query
def trajectory_job(spark, sf_dir):
    path = stage_path(spark, "kml")
    kml.write_roi_kml(derived.place_regions(spark), path)
    tables = jobs.trajectory_job(spark, _json_copy(spark, sf_dir, wrapped=True), path)
    return _sequence_rule_rows(tables["sequence_rules"])


@query
def trajectory_tables(spark, sf_dir):
    """All tables of the trajectory job, over a box of posts around the places."""
    path = stage_path(spark, "kml")
    kml.write_roi_kml(derived.place_regions(spark), path)
    tables = jobs.trajectory_job(spark, _json_copy(spark, sf_dir, wrapped=False), path, bounds=(41.0, 12.0, 42.0, 13.0))
    arrow = F.concat_ws("=>", F.array_join("antecedent", ">"), F.array_join("consequent", ">"))
    rows = _named_rows("sequences", tables["sequences"], F.array_join("items", ">"), F.col("freq"))
    rows = rows.unionByName(_named_rows("sequence_rules", tables["sequence_rules"], arrow, F.col("confidence")))
    return rows.unionByName(_set_rows(tables))


@query
def roi_job_vertices(spark, sf_dir):
    """The rings of the region job, corner by corner."""
    path = f"{stage_path(spark, 'files')}/keywords.txt"
    _keywords(spark).write.text(path)
    return _vertices(jobs.roi_job(spark, _json_copy(spark, sf_dir, wrapped=False), path, bounds=(0.0, 0.0, 90.0, 180.0)), "poi")
