"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

_local_dirs: dict[str, tempfile.TemporaryDirectory] = {}


def get_session(app_name: str = "footfall", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session with the package defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def stage_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, taken from ``spark.checkpoint.dir``.

    Only a local session may run without one; it then gets a folder that is
    removed when the Python process ends.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.TemporaryDirectory(prefix="footfall-", ignore_cleanup_errors=True)
        spark.sparkContext.setCheckpointDir(_local_dirs[app].name)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stage_path(spark: SparkSession, label: str) -> str:
    """A fresh path for one intermediate table, in the folder of this application."""
    return f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _own_folder(spark: SparkSession) -> str:
    return f"{stage_root(spark)}/footfall/{spark.sparkContext.applicationId}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and continue from the written table.

    The table cuts the lineage, survives the loss of executors, and gives later
    readers column pruning and a row count from the file footers. A frame that is
    such a table already is returned as it is.
    """
    if "_footfall_stage" in vars(df):
        return df
    path = stage_path(df.sparkSession, label)
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._footfall_stage = path
    return written


def drop_stage(df: DataFrame) -> None:
    """Delete a table that :func:`stage` wrote, once its last reader is done."""
    _delete(df.sparkSession, vars(df)["_footfall_stage"])


def clear_stages(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; those of others stay."""
    _delete(spark, _own_folder(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
