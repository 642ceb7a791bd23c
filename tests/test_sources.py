"""Readers and writers on small hand-made files."""

from __future__ import annotations

import json

import pytest
from pyspark.errors import AnalysisException

from footfall.operators import trajectories
from footfall.plans import jobs
from footfall.sources import derived, kml, posts

PLAIN = {
    "geoData": {"latitude": 41.9, "longitude": 12.5, "accuracy": 16},
    "owner": {"username": "ann"},
    "datePosted": "Jan 3, 2017 4:05:06 PM",
    "tags": [{"value": "rome"}, {"value": "roma"}],
}


def write_json(path, *records):
    path.write_text("\n".join(json.dumps(r) for r in records))
    return str(path)


def test_plain_wrapped_and_mixed_records(spark, tmp_path):
    empty = {**PLAIN, "tags": []}
    absent = {**PLAIN, "tags": None}
    south = {**PLAIN, "geoData": {"latitude": -1.0, "longitude": 12.5}}
    for name, records in {
        "plain": [PLAIN, empty, absent, south],
        "wrapped": [{"EXTRA": r} for r in (PLAIN, empty, absent, south)],
        "mixed": [PLAIN, {"EXTRA": empty}, {"EXTRA": PLAIN}],
    }.items():
        frame = posts.read_posts(spark, write_json(tmp_path / f"{name}.JSON", *records))
        rows = frame.collect()
        assert len(rows) == (2 if name == "mixed" else 1)
        assert (rows[0].latitude, rows[0].accuracy, rows[0].username, rows[0].tags) == (41.9, 16.0, "ann", ["rome", "roma"])
        assert len({r.post_id for r in rows}) == 1


def test_bounds_replace_the_default_quarter(spark, tmp_path):
    south = {**PLAIN, "geoData": {"latitude": -33.0, "longitude": -70.0}}
    path = write_json(tmp_path / "posts.json", PLAIN, south)
    assert [r.latitude for r in posts.read_posts(spark, path, bounds=(-40, -80, -30, -60)).collect()] == [-33.0]


def test_conversion_round_trip(spark, tmp_path):
    source = write_json(tmp_path / "posts.json", PLAIN, {"EXTRA": PLAIN})
    target = str(tmp_path / "posts.parquet")
    posts.json_to_parquet(spark, source, target)
    assert spark.read.parquet(target).columns == posts.STORED_COLUMNS
    assert posts.read_posts(spark, target).collect() == posts.read_posts(spark, source).collect()


def test_reader_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="format"):
        posts.read_posts(spark, "posts.csv")
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        posts.read_posts(spark, str(tmp_path / "none.json"))
    spark.range(1).write.parquet(str(tmp_path / "other.parquet"))
    with pytest.raises(ValueError, match="lacks"):
        posts.read_posts(spark, str(tmp_path / "other.parquet"))


def test_terms_are_distinct_lines(spark, tmp_path):
    (tmp_path / "words.txt").write_text("a\nb\na\n")
    assert sorted(r.term for r in posts.read_terms(spark, str(tmp_path / "words.txt")).collect()) == ["a", "b"]


def placemark(name, *triples):
    coordinates = "\n   ".join(triples)
    return f"""<Placemark id="x"><name>
      {name} </name><Polygon><outerBoundaryIs><LinearRing><tessellate>1</tessellate><coordinates>
   {coordinates}
   </coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"""


def test_kml_folders_names_and_duplicates(spark, tmp_path):
    document = "".join(
        [
            '<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><Folder>',
            placemark("Colosseo", "0,0,0", "1,0,0", "1,1,0"),
            "</Folder>",
            placemark("Pantheon &amp; co", "0,0,0", "2,0,0", "2,2,0", "0,0,0"),
            placemark("COLOSSEO", "5,5,0", "6,5,0", "6,6,0"),
            "<Placemark><name>pin</name><Point><coordinates>1,1,0</coordinates></Point></Placemark>",
            "</Document></kml>",
        ]
    )
    (tmp_path / "rois.kml").write_text(document)
    rings = {r.poi: [(v.lon, v.lat) for v in r.ring] for r in kml.read_roi_kml(spark, str(tmp_path / "rois.kml")).collect()}
    assert set(rings) == {"colosseo", "pantheon & co"}
    assert rings["colosseo"] == [(5, 5), (6, 5), (6, 6), (5, 5)]
    assert len(rings["pantheon & co"]) == 4


def test_kml_text_is_escaped_and_complete(spark):
    frame = spark.createDataFrame([("a & b", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)], "<7>")],
                                  "poi string, ring array<struct<lon double, lat double>>, size string")
    text = kml.roi_kml(frame, ["size"], document=True).first().kml
    assert text.startswith("<?xml") and text.endswith("</Document></kml>")
    assert "<name>a &amp; b</name>" in text and '<Data name="size"><value>&lt;7&gt;</value></Data>' in text
    assert "0.0,0.0,0.0 1.0,0.0,0.0" in text
    from pyspark.sql import functions as F

    point = frame.select(kml.placemark(kml.point_text(F.lit(1.5), F.lit(2.0)), {"name": F.col("poi")}).alias("t")).first().t
    assert point == "<Placemark><name>a &amp; b</name><Point><coordinates>1.5,2.0</coordinates></Point></Placemark>"


def test_unparsable_dates_are_counted_not_used(spark):
    rows = [(1, 0.5, 0.5, "u", "Jan 3, 2017 4:05:06 PM"), (2, 0.5, 0.5, "u", "2017-01-03")]
    frame = spark.createDataFrame(rows, "post_id long, longitude double, latitude double, username string, date_posted string")
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    rois = spark.createDataFrame([("p", square)], "poi string, ring array<struct<lon double, lat double>>")
    assert [str(r.day) for r in trajectories.visits(frame, rois).collect()] == ["2017-01-03"]
    assert trajectories.rejected_dates(frame).count() == 1


def test_pipeline_needs_stop_words_or_keywords(spark):
    with pytest.raises(ValueError, match="stop words"):
        jobs.pipeline(spark.range(1))


def test_box_reaches_the_scan_of_stored_posts(spark, tables, tmp_path):
    from footfall.operators import spatial

    path = str(tmp_path / "stored.parquet")
    posts.write_posts_parquet(derived.posts(spark, tables), path)
    inside = spatial.bbox_filter(posts.read_posts_parquet(spark, path), 41.88, 12.46, 41.9, 12.48)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = inside.select("username")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("ReadSchema")[0]
    assert "GreaterThanOrEqual(latitude,41.88)" in pushed and "LessThanOrEqual(longitude,12.48)" in pushed
    assert "accuracy" not in plan[plan.index("ReadSchema") :]
    assert inside.count() == spatial.bbox_filter(derived.posts(spark, tables), 41.88, 12.46, 41.9, 12.48).count()
    nan = posts.valid_posts(spark.createDataFrame([(float("nan"), 5.0, ["a"]), (91.0, 5.0, ["a"]), (5.0, 5.0, ["a"])], "latitude double, longitude double, tags array<string>"))
    assert nan.count() == 1


def test_box_skips_row_groups_of_clustered_posts(spark, tmp_path):
    """A small box opens few row groups of clustered posts and nearly all of unordered ones."""
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from footfall.operators import spatial

    spread = lambda seed: F.lit(10.0) + F.abs(F.hash("id", F.lit(seed))) % 10_000 / 1000.0
    rows = spark.range(40_000).select(
        F.col("id").alias("post_id"), spread(1).alias("latitude"), spread(2).alias("longitude"), F.lit(1.0).alias("accuracy"),
        F.concat(F.lit("u"), "id").alias("username"), F.lit("Jan 3, 2017 4:05:06 PM").alias("date_posted"), F.array(F.lit("t")).alias("tags"),
    )
    # A third of the posts on one spot, which several files share.
    on_spot = F.col("post_id") % 3 == 0
    rows = rows.withColumns({c: F.when(on_spot, F.lit(15.5)).otherwise(F.col(c)) for c in ("latitude", "longitude")})
    box, opened, spot_files, kept = (12.0, 13.0, 12.5, 13.5), {}, {}, {}
    for clustered in (True, False):
        path = tmp_path / f"posts{clustered}.parquet"
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files, as for large input
        posts.write_posts_parquet(rows, str(path), clustered=clustered, row_group_bytes=20_000)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        groups, spot = [], set()
        for file in path.glob("*.parquet"):
            meta = pq.ParquetFile(file).metadata
            for g in range(meta.num_row_groups):
                lat, lon = (meta.row_group(g).column(i).statistics for i in (0, 1))
                groups.append(lat.max >= box[0] and lat.min <= box[2] and lon.max >= box[1] and lon.min <= box[3])
                if lat.min <= 15.5 <= lat.max:
                    spot.add(file)
        opened[clustered], spot_files[clustered] = sum(groups) / len(groups), len(spot)
        inside = spatial.bbox_filter(posts.read_posts_parquet(spark, str(path)), *box).select("username", "latitude", "longitude")
        kept[clustered] = sorted(inside.collect())
        scan = inside._jdf.queryExecution()
        scan.executedPlan().executeCollect()
        read = scan.executedPlan().collectLeaves().head().metrics().get("numOutputRows").get().value()
        assert not clustered or read < 4_000
    assert kept[True] == kept[False] and 0 < len(kept[True]) < 400
    assert opened[True] < 0.2 and opened[False] > 0.9 and spot_files[True] > 1
