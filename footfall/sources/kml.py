"""Regions as KML: reading Placemark polygons and writing points and polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.geo import closed

PLACEMARK = (
    "name string, Polygon struct<outerBoundaryIs: struct<LinearRing: struct<coordinates: string>>>"
)
# The KML document wrapper.
HEADER = '<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>'
FOOTER = "</Document></kml>"
# Text elements of a Placemark, in the order of the format's schema.
PLAIN = ("name", "description", "styleUrl")


def read_placemarks(spark: SparkSession, path: str) -> DataFrame:
    """Every polygon Placemark, in or outside a Folder: ``poi, ring, position``.

    Names are lower-cased and trimmed. The ring is the outer boundary, closed.
    ``file`` and ``position`` give their order: by file name, then along the file.
    """
    # Cutting the text at the closing tag keeps large files splittable, and allows
    # files with one document per line, which are no single XML document.
    pieces = spark.read.text(path, lineSep="</Placemark>")
    element = F.regexp_extract("value", r"(?s)(<Placemark[\s>].*)$", 1)
    marks = pieces.select(element.alias("xml"), F.col("_metadata.file_path").alias("file")).filter(F.col("xml") != "")
    mark = F.from_xml(F.concat("xml", F.lit("</Placemark>")), PLACEMARK).alias("mark")
    marks = marks.select(mark, "file").select("mark.*", "file")
    text = F.col("Polygon.outerBoundaryIs.LinearRing.coordinates")
    triples = F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")
    ring = F.transform(
        triples,
        lambda t: F.struct(
            F.element_at(F.split(t, ","), 1).cast("double").alias("lon"),
            F.element_at(F.split(t, ","), 2).cast("double").alias("lat"),
        ),
    )
    named = marks.filter(text.isNotNull()).select(
        F.lower(F.trim(F.regexp_replace("name", r"^\s+|\s+$", ""))).alias("poi"),
        ring.alias("ring"),
        "file",
        F.monotonically_increasing_id().alias("position"),
    )
    return named.filter(F.size("ring") > 0).withColumn("ring", closed(F.col("ring")))


def read_roi_kml(spark: SparkSession, path: str) -> DataFrame:
    """Regions by name, ``poi, ring``; of several with one name the last is kept."""
    marks = read_placemarks(spark, path)
    return marks.groupBy("poi").agg(F.max_by("ring", F.struct("file", "position")).alias("ring"))


def _escaped(text: Column) -> Column:
    text = text.cast("string")
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def _element(name: str, *content: Column) -> Column:
    """An element, or null if one part of its content is."""
    return F.concat(F.lit(f"<{name}>"), *content, F.lit(f"</{name.split(' ')[0]}>"))


def placemark(geometry: Column, attributes: dict[str, Column], document: bool = False) -> Column:
    """KML text of one Placemark around a geometry text.

    Attributes named like a text element of a Placemark (``PLAIN``) become that element,
    in the order that the format asks for. ``color`` fills and outlines the geometry by
    a style of the Placemark's own. The rest is extended data. Nulls are left out.
    """
    texts = {key: _escaped(F.trim(value.cast("string"))) for key, value in attributes.items()}
    plain = [_element(key, texts[key]) for key in PLAIN if key in texts]
    paint = [_element(kind, _element("color", texts["color"])) for kind in ("LineStyle", "PolyStyle") if "color" in texts]
    style = [_element("Style", *paint)] if paint else []
    others = [_element(f'Data name="{key}"', _element("value", text)) for key, text in texts.items() if key not in (*PLAIN, "color")]
    extended = [_element("ExtendedData", F.concat_ws("", *others))] if others else []
    mark = _element("Placemark", F.concat_ws("", *plain, *style, *extended, geometry))
    return F.concat(F.lit(HEADER), mark, F.lit(FOOTER)) if document else mark


def polygon_text(ring: Column) -> Column:
    """KML polygon of a ring, vertices in ring order."""
    triples = F.transform(
        ring, lambda v: F.concat(v["lon"].cast("string"), F.lit(","), v["lat"].cast("string"), F.lit(",0.0"))
    )
    return F.concat(
        F.lit("<Polygon><outerBoundaryIs><LinearRing><tessellate>0</tessellate><coordinates>"),
        F.array_join(triples, " "),
        F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon>"),
    )


def point_text(lon: Column, lat: Column) -> Column:
    """KML point."""
    return F.concat(
        F.lit("<Point><coordinates>"), lon.cast("string"), F.lit(","), lat.cast("string"), F.lit("</coordinates></Point>")
    )


def roi_kml(rois: DataFrame, attributes: list[str] = (), document: bool = False) -> DataFrame:
    """KML text per region; ``attributes`` names further columns to carry along."""
    fields = {"name": F.col("poi"), **{c: F.col(c) for c in attributes}}
    return rois.select("poi", placemark(polygon_text(F.col("ring")), fields, document).alias("kml"))


def write_points_kml(
    points: DataFrame, path: str, attributes: list[str] = (), document: bool = False, mode: str = "errorifexists"
) -> None:
    """Write points ``poi, lon, lat`` like regions, one Placemark or document per line."""
    fields = {"name": F.col("poi"), **{c: F.col(c) for c in attributes}}
    text = placemark(point_text(F.col("lon"), F.col("lat")), fields, document)
    points.select(text.alias("value")).write.mode(mode).text(path)


def write_roi_kml(
    rois: DataFrame, path: str, attributes: list[str] = (), document: bool = False, mode: str = "errorifexists"
) -> None:
    """Write one Placemark (or one whole document) per line, in parallel files."""
    roi_kml(rois, attributes, document).select(F.col("kml").alias("value")).write.mode(mode).text(path)
