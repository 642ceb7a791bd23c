"""Post readers, the JSON to Parquet conversion, term lists and result tables.

Every reader returns the canonical columns ``post_id, latitude, longitude,
accuracy, username, date_posted, tags`` of valid posts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.functions.grid import curve_position

POST_FIELDS = T.StructType(
    [
        T.StructField(
            "geoData",
            T.StructType(
                [
                    T.StructField("latitude", T.DoubleType()),
                    T.StructField("longitude", T.DoubleType()),
                    T.StructField("accuracy", T.DoubleType()),
                ]
            ),
        ),
        T.StructField("owner", T.StructType([T.StructField("username", T.StringType())])),
        T.StructField("datePosted", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StructType([T.StructField("value", T.StringType())]))),
    ]
)
# Both shapes in one schema, so that a folder may mix plain and wrapped records
# and reading needs no inference pass.
RAW_SCHEMA = T.StructType([*POST_FIELDS.fields, T.StructField("EXTRA", POST_FIELDS)])

DATE_PATTERN = "MMM d, yyyy h:mm:ss a"
# Small row groups, so that a box reads little more than itself.
ROW_GROUP_BYTES = 16 << 20
STORED_COLUMNS = ["latitude", "longitude", "accuracy", "username", "datePosted", "value"]


def post_key() -> Column:
    """Content key of a post; posts equal in every field share it."""
    return F.xxhash64("latitude", "longitude", "username", "date_posted", F.array_join("tags", "\u0001"))


def normalise_posts(raw: DataFrame) -> DataFrame:
    """Project nested posts, plain or under ``EXTRA``, to the canonical columns."""
    prefixes = [p for p in ("", "EXTRA.") if p == "" and "geoData" in raw.columns or p and "EXTRA" in raw.columns]
    if not prefixes:
        raise ValueError("input has neither a geoData nor an EXTRA field")

    def pick(path: str) -> Column:
        return F.coalesce(*[F.col(prefix + path) for prefix in prefixes])

    flat = raw.select(
        pick("geoData.latitude").alias("latitude"),
        pick("geoData.longitude").alias("longitude"),
        pick("geoData.accuracy").alias("accuracy"),
        pick("owner.username").alias("username"),
        pick("datePosted").alias("date_posted"),
        pick("tags.value").alias("tags"),
    )
    return flat.select(post_key().alias("post_id"), "*")


def valid_posts(posts: DataFrame, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Keep located posts with tags.

    Coordinates must be numbers on the globe. The default keeps its north-eastern
    quarter (latitude and longitude above zero); ``bounds = (lat_lo, lon_lo, lat_hi, lon_hi)`` keeps a
    chosen box instead, borders included.
    """
    if bounds is None:
        located = (F.col("latitude") > 0) & (F.col("longitude") > 0)
    else:
        lat_lo, lon_lo, lat_hi, lon_hi = bounds
        located = F.col("latitude").between(lat_lo, lat_hi) & F.col("longitude").between(lon_lo, lon_hi)
    # NaN compares as larger than any number, so the upper bounds drop it too.
    real = F.col("latitude").between(-90.0, 90.0) & F.col("longitude").between(-180.0, 180.0)
    return posts.filter(real & located & (F.size("tags") > 0))


def read_posts_json(spark: SparkSession, path: str, bounds=None) -> DataFrame:
    """Read raw JSON posts; a missing path fails with Spark's own error."""
    return valid_posts(normalise_posts(spark.read.schema(RAW_SCHEMA).json(path)), bounds)


def read_posts_parquet(spark: SparkSession, path: str, bounds=None) -> DataFrame:
    """Read normalised posts, by name; columns in another order are fine."""
    stored = spark.read.parquet(path)
    missing = [c for c in STORED_COLUMNS if c not in stored.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    flat = stored.select(
        "latitude",
        "longitude",
        F.col("accuracy").cast("double"),
        "username",
        F.col("datePosted").alias("date_posted"),
        F.col("value").alias("tags"),
    )
    return valid_posts(flat.select(post_key().alias("post_id"), "*"), bounds)


def read_posts(spark: SparkSession, path: str, bounds=None) -> DataFrame:
    """Choose the reader by the extension of ``path``, whatever its case."""
    readers = {"json": read_posts_json, "parquet": read_posts_parquet}
    extension = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if extension not in readers:
        raise ValueError(f"cannot tell the format of {path}: expected .json or .parquet")
    return readers[extension](spark, path, bounds)


def write_posts_parquet(
    posts: DataFrame, path: str, mode: str = "errorifexists", clustered: bool = True, row_group_bytes: int = ROW_GROUP_BYTES
) -> None:
    """Write canonical posts in the stored column layout.

    ``clustered`` lays them out along a space-filling curve, so that the coordinates of a
    file and of a row group cover a small box, and a filter on a box passes over the
    others by their statistics. That costs one shuffle, and a second pass over the
    posts for a sample; the post's key cuts up a spot that holds very many of them.
    """
    if clustered:
        along = posts.withColumn("_z", curve_position(F.col("longitude"), F.col("latitude")))
        posts = along.repartitionByRange("_z", "post_id").sortWithinPartitions("_z", "post_id")
    posts.select(
        "latitude",
        "longitude",
        "accuracy",
        "username",
        F.col("date_posted").alias("datePosted"),
        F.col("tags").alias("value"),
    ).write.mode(mode).option("parquet.block.size", row_group_bytes).parquet(path)


def write_posts_json(posts: DataFrame, path: str, wrapped: bool = False, mode: str = "errorifexists") -> None:
    """Write canonical posts as raw nested JSON, optionally under ``EXTRA``."""
    post = F.struct(
        F.struct("latitude", "longitude", "accuracy").alias("geoData"),
        F.struct("username").alias("owner"),
        F.col("date_posted").alias("datePosted"),
        F.transform("tags", lambda t: F.struct(t.alias("value"))).alias("tags"),
    ).alias("EXTRA")
    nested = posts.select(post)
    (nested if wrapped else nested.select("EXTRA.*")).write.mode(mode).json(path)


def json_to_parquet(spark: SparkSession, json_path: str, parquet_path: str, bounds=None) -> None:
    """Convert raw JSON posts to the layout that :func:`read_posts_parquet` reads."""
    write_posts_parquet(read_posts_json(spark, json_path, bounds), parquet_path)


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lines of a stop-word or keyword file, as column ``term``."""
    return spark.read.text(path).select(F.col("value").alias("term")).distinct()


def write_results(tables: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Write result tables (keywords, regions, rules...) below one folder."""
    for name, table in tables.items():
        table.write.mode(mode).parquet(f"{path.rstrip('/')}/{name}")
