"""Session construction and the few runtime settings the library relies on."""

from __future__ import annotations

import atexit
import os
import posixpath

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "pulseline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and skew-join splitting switched on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings that results depend on, on a session someone else made."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's own checkpoint folder, or the
    session's warehouse where none is set. Never a folder of one machine's own choice."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared
    warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
    if not warehouse:
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return posixpath.join(warehouse, "_scratch")


_MADE: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder below the shared folder; `release` or the driver's end deletes it."""
    path = posixpath.join(checkpoint_dir(spark), f"{name}-{os.urandom(6).hex()}")
    if not _MADE:
        atexit.register(release, spark)
    _MADE.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """A written copy in the shared folder: lineage ends here and survives the loss of executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *paths: str) -> None:
    """Delete scratch folders: the given ones, or all that this driver has made."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc
    if jvm is None or conf is None:  # the session is stopped
        return
    for path in paths or tuple(_MADE):
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf.hadoopConfiguration()).delete(place, True)
        if path in _MADE:
            _MADE.remove(path)
