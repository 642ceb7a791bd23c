"""Geotagged posts derived from the ``events`` and ``part`` tables.

Test data has no coordinates, so posts are computed from event ids by integer
arithmetic. The derivation is narrow: one scan of three event columns and a
lookup of the part names, which takes them all in turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.geo import rectangle
from footfall.operators.joins import lookup_join
from footfall.sources.posts import DATE_PATTERN, valid_posts

# Fixed values of the test data: place names by id, and its one stop word.
PLACES = (
    "colosseo pantheon navona trevi vaticano trastevere gianicolo campidoglio aventino testaccio "
    "esquilino quirinale"
).split()
STOP_WORDS = ["foto"]


def _spread(table: DataFrame) -> DataFrame:
    """Use all cores for a file too small to be split; larger input is not shuffled."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores, "event_id") if table.rdd.getNumPartitions() < cores // 2 else table


def derive_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All derived posts, the invalid ones included, plus ``posted_ts``."""
    events = _spread(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts"))
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    n_names = names.count()
    mixed = events.selectExpr(
        "event_id",
        "user_id",
        "ts",
        "(((event_id + 1) * 1103515245 + 12345) % 2147483648) div 65536 AS a",
        "(((event_id + 7) * 22695477 + 1) % 2147483648) div 65536 AS b",
    )
    placed = mixed.selectExpr(
        "*",
        "(user_id * 3 + (a % 5)) % 12 AS poi_id",
        "(a % 31) + (b % 29) - 29 AS jy",
        "((a div 31) % 31) + ((b div 29) % 29) - 29 AS jx",
        "event_id % 10 = 3 AS is_noise",
    )
    located = placed.selectExpr(
        "*",
        "CASE WHEN is_noise THEN 41870000 + (a * 7 + b) % 50000"
        " ELSE 41875000 + (poi_id % 4) * 12000 + jy * 50 END AS lat_u",
        "CASE WHEN is_noise THEN 12440000 + (b * 5 + a) % 70000"
        " ELSE 12450000 + (poi_id div 4) * 22000 + jx * 60 END AS lon_u",
    ).withColumn("poi", F.element_at(F.array(*[F.lit(p) for p in PLACES]), (F.col("poi_id") + 1).cast("int")))
    keyed = located.withColumn("p_partkey", F.col("event_id") % F.lit(n_names))
    named = lookup_join(keyed, names, ["p_partkey"], ["event_id"], small_rows=n_names)
    tag_text = """CASE WHEN event_id % 97 = 13 THEN '' ELSE concat_ws(' ',
        'rome', p_name,
        CASE WHEN NOT is_noise THEN poi END,
        CASE WHEN NOT is_noise AND event_id % 9 = 4 THEN poi END,
        CASE WHEN event_id % 7 = 2 THEN 'foto' END,
        CASE WHEN event_id % 5 = 1 THEN concat('img', CAST(event_id AS STRING)) END,
        CASE WHEN event_id % 50 = 8 THEN '罗马' END,
        CASE WHEN event_id % 40 = 6 THEN 'new-york' END) END"""
    return named.selectExpr(
        "event_id AS post_id",
        "CASE WHEN event_id % 101 = 50 THEN -1.0D ELSE 1.0D END * (CAST(lat_u AS DOUBLE) / 1000000.0D)"
        " AS latitude",
        "CAST(lon_u AS DOUBLE) / 1000000.0D AS longitude",
        "CAST(NULL AS DOUBLE) AS accuracy",
        "concat('user', CAST(user_id AS STRING)) AS username",
        f"date_format(ts, '{DATE_PATTERN}') AS date_posted",
        "ts AS posted_ts",
        f"split({tag_text}, ' ') AS tags",
    ).withColumn("tags", F.filter("tags", lambda t: t != ""))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid derived posts."""
    return valid_posts(derive_posts(spark, sf_dir))


def terms(spark: SparkSession, words: list[str]) -> DataFrame:
    """A word list as the one-column table that :func:`read_terms` returns.

    As a literal its size is known to the planner.
    """
    return spark.range(1).select(F.explode(F.array(*[F.lit(w) for w in words])).alias("term"))


def place_regions(spark: SparkSession) -> DataFrame:
    """A rectangle of ±0.0008° by ±0.0010° about each place centre: ``poi, ring``."""
    centres = spark.createDataFrame(
        [(name, 41875000 + (k % 4) * 12000, 12450000 + (k // 4) * 22000) for k, name in enumerate(PLACES)],
        "poi string, lat_u bigint, lon_u bigint",
    )
    return centres.select(
        "poi",
        rectangle(
            (F.col("lon_u") - 1000) / F.lit(1000000.0),
            (F.col("lat_u") - 800) / F.lit(1000000.0),
            (F.col("lon_u") + 1000) / F.lit(1000000.0),
            (F.col("lat_u") + 800) / F.lit(1000000.0),
        ).alias("ring"),
    )
