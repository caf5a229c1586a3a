"""Sessions, and frames that two jobs can read alike."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def session(app: str = "rillframe", **conf: str) -> SparkSession:
    """A session with the settings that the library expects: UTC, adaptive plans, last-wins map keys."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def stable(df: DataFrame) -> DataFrame:
    """df as it is now, for plans that read it more than once and need the same partitions each time.

    With spark.checkpoint.dir it is a reliable checkpoint, which survives lost executors; else it is kept by Spark's cache, whose lost
    blocks are made again from the same shuffle, until release_stable().
    """
    context = df.sparkSession.sparkContext
    if context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir():
        return df.checkpoint(eager=True)
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    _kept.append(kept)
    return kept


_kept: list[DataFrame] = []


def release_stable() -> int:
    """Give back the memory and disk of all frames that stable() has kept in Spark's cache; frames that use them are computed anew. Their number."""
    n = len(_kept)
    while _kept:
        _kept.pop().unpersist()
    return n


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> SparkSession:
    """Give the Python workers this package, wherever they run; once for each Spark application."""
    context = spark.sparkContext
    if getattr(context, "_rillframe_shipped", False):
        return spark
    top = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(top):  # else the package is in an archive that Spark has distributed
        archive = os.path.join(tempfile.mkdtemp(prefix="rillframe-code-"), "rillframe_code.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.join("rillframe", os.path.relpath(path, top)))
        context.addPyFile(archive)
    context._rillframe_shipped = True
    return spark


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: under spark.checkpoint.dir, or a local one on a single machine."""
    import uuid

    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="rillframe-")
    return f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"
